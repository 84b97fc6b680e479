"""How a join is carried out where the user, or its size, asks for more than Catalyst's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leftdeep.operators.keys import Key
from leftdeep.shared import stored

HINTS = {"merge": "merge", "shuffle_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
#: A forced broadcast is refused beyond this many bytes (Spark's own limit is 8 GB).
BROADCAST_LIMIT = 512 << 20
#: The smaller side of a join of many pairs is broadcast within this many bytes.
SMALL_SIDE = 32 << 20
#: Sides whose bytes have a product of less are joined as they lie; beyond, the larger one is
#: dealt out in one piece for each PIECE of it, and in so many pieces a core at most.
MANY_PAIRS, PIECE, PIECES_A_CORE = 1 << 33, 1 << 30, 8
#: A table with more bytes a core has row groups enough for all cores.
ROW_GROUP = 128 << 20
#: ``ranged_join`` finds a key's block in so many steps; there are 2 to this power of them.
BLOCK_STEPS = 9
TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; nothing runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast this plan."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return 0 <= plan_bytes(df) <= conf.autoBroadcastJoinThreshold()


def hinted(right: DataFrame, strategy: str | None) -> DataFrame:
    """The right side with the strategy's hint. A broadcast is only asked for within
    BROADCAST_LIMIT; beyond it the planner chooses, which shuffles both sides."""
    if strategy is None:
        return right
    if strategy == "broadcast":
        return F.broadcast(right) if plan_bytes(right) <= BROADCAST_LIMIT else right
    return right.hint(HINTS[strategy])


def pieces(left: DataFrame, right: DataFrame) -> int:
    """In how many pieces the larger side is dealt out; 0: the sides are too small for that."""
    product = plan_bytes(left) * plan_bytes(right)
    cores = left.sparkSession.sparkContext.defaultParallelism
    return min(PIECES_A_CORE * cores, product // PIECE) if product >= MANY_PAIRS else 0


def _left_is_few(left: DataFrame, right: DataFrame, derived: bool) -> bool:
    return not derived and plan_bytes(left) < plan_bytes(right)


def dealt_join(left: DataFrame, right: DataFrame, cond: Column, derived: bool = False) -> DataFrame:
    """An inner join by equal keys that repeat on both sides, so that its pairs far outnumber
    the rows. As its tables lie, the few keys, or the larger table's row groups, say how many
    tasks share the pairs; here the larger side is dealt out over all cores and the smaller one
    broadcast. Where that one is too large, both are shuffled by key, as Spark chooses."""
    n = pieces(left, right)
    many, few = (right, left) if _left_is_few(left, right, derived) else (left, right)
    if not n or plan_bytes(few) > SMALL_SIDE:
        return left.join(right, cond, "inner")
    if derived or plan_bytes(many) < ROW_GROUP * many.sparkSession.sparkContext.defaultParallelism:
        many = many.repartition(n)
    return many.join(F.broadcast(few), cond, "inner")


def rangeable(left: T.DataType, right: T.DataType) -> bool:
    """Whether the two types compare in the order that each has by itself, and have percentiles."""
    if isinstance(left, T.NumericType):
        return isinstance(right, T.NumericType)
    return left == right and isinstance(left, (T.DateType, T.TimestampType, T.TimestampNTZType))


def ranged_join(left: DataFrame, right: DataFrame, cond: Column, op: str, keys: tuple[Key, Key], derived: bool = False) -> DataFrame:
    """An inner join by ``<``, ``>``, ``<=`` or ``>=`` on all cores, which tests few pairs in vain.

    Spark deals such a join out as the larger table's row groups lie, which for a table of one
    row group is a single task, and tests every pair. Here the larger side is dealt out evenly.
    The smaller side falls into blocks between percentiles of its key, and a row of the
    larger one meets the blocks that its own key reaches, so that pairs without a result are
    tested within one block only. Blocks only say which pairs are tested; ``cond`` decides.
    Rows of the smaller side beyond the other's least or greatest key are left out first.

    The smaller side is broadcast within SMALL_SIDE; beyond, both are shuffled by block. A left
    side that is ``derived`` is used once: it is the one that is dealt out, and the right side
    keeps the rows that have no partner there.
    """
    turn = _left_is_few(left, right, derived)
    many, few, (key, _), (few_key, kind) = (right, left, *reversed(keys)) if turn else (left, right, *keys)
    op = TURNED[op] if turn else op
    small = plan_bytes(few) <= SMALL_SIDE
    if not derived:
        few = _with_partner(few, few_key, many, key, TURNED[op])
    blocks = 2**BLOCK_STEPS
    known = F.when(~F.isnan(few_key), few_key) if isinstance(kind, (T.FloatType, T.DoubleType)) else few_key
    shares = [i / blocks for i in range(1, blocks)]
    edges = F.broadcast(few.agg(F.array_sort(F.percentile_approx(known, shares)).alias("_edges")))

    def block(k: Column) -> Column:
        """How many edges lie below ``k``, by halving."""
        steps = F.array(*[F.lit(2**i) for i in reversed(range(BLOCK_STEPS))])
        return F.aggregate(steps, F.lit(0), lambda at, more: at + F.when(F.element_at("_edges", at + more) < k, more).otherwise(0))

    few = few.where(few_key.isNotNull()).crossJoin(edges).withColumn("_few_block", block(few_key)).drop("_edges")
    own = block(key)
    reach = F.sequence(F.lit(0), own) if op in (">", ">=") else F.sequence(own, F.lit(blocks - 1))
    many = many.where(key.isNotNull()).repartition(pieces(left, right)).crossJoin(edges).withColumn("_block", F.explode(reach)).drop("_edges")
    met = many.join(F.broadcast(few) if small else few, (F.col("_block") == F.col("_few_block")) & cond, "inner")
    return met.drop("_block", "_few_block")


def _with_partner(df: DataFrame, key: Column, other: DataFrame, other_key: Column, op: str) -> DataFrame:
    """The rows of ``df`` that have a partner in ``other``."""
    ends, lone = _without_partner(key, _ends(other, other_key), op, False)
    return df.crossJoin(F.broadcast(ends)).where(~lone).drop(*ends.columns)


def theta_join(left: DataFrame, right: DataFrame, cond: Column, how: str, op: str, keys: tuple[Column, Column], null_safe: bool, nested_loop: bool = False, derived: bool = False) -> DataFrame:
    """A join by ``<``, ``>``, ``<=``, ``>=`` or ``!=`` that broadcasts no large side.

    Spark runs an outer join without an equality by broadcasting a whole side, at any
    size. Where neither side is small (or ``nested_loop`` asks for it), it becomes an inner
    join: whether a row has a partner at all is read off the other side's least and greatest
    key, which is one row (``l < r`` has a partner exactly if ``l < max(r)``), and rows
    without one are paired with one row of nulls that is added to the other side.

    So a left join uses its left side once. A right or full one needs the left side's least
    and greatest key as well; a left side that is ``derived``, itself a result of joins, is
    written first, so that a chain doubles no work and both uses see the same rows.
    """
    if how == "inner" or (not nested_loop and (small_enough(right) or small_enough(left))):
        return left.join(right, cond, how)
    if derived and how in ("right", "full"):
        left = stored(left, "left-side")
    turned = TURNED.get(op, op)
    lone_left = _without_partner(keys[0], _ends(right, keys[1]), op, null_safe) if how in ("left", "full") else None
    lone_right = _without_partner(keys[1], _ends(left, keys[0]), turned, null_safe) if how in ("right", "full") else None
    a = _tagged(left, "_l", lone_left, how in ("right", "full"))
    b = _tagged(right, "_r", lone_right, how in ("left", "full"))
    pair = (~F.col("_l_none") & ~F.col("_r_none") & cond) | (F.col("_l_lone") & F.col("_r_none")) | (F.col("_l_none") & F.col("_r_lone"))
    return a.join(b, pair, "inner").drop("_l_none", "_r_none", "_l_lone", "_r_lone")


def _ends(df: DataFrame, key: Column) -> DataFrame:
    """One row: the least and greatest key, and how many rows and keys there are."""
    return df.agg(F.min(key).alias("_least"), F.max(key).alias("_most"), F.count(F.lit(1)).alias("_rows"), F.count(key).alias("_keys"))


def _without_partner(key: Column, ends: DataFrame, op: str, null_safe: bool) -> tuple[DataFrame, Column]:
    """The other side's ends, and whether a row has no partner there."""
    least, most = F.col("_least"), F.col("_most")
    has = {
        "<": key < most,
        "<=": key <= most,
        ">": key > least,
        ">=": key >= least,
        "!=": (key != least) | (key != most),
    }[op]
    if op == "!=" and null_safe:
        has = F.coalesce(has, F.lit(False)) | (key.isNotNull() & (F.col("_rows") > F.col("_keys"))) | (key.isNull() & (F.col("_keys") > 0))
    return ends, ~F.coalesce(has, F.lit(False))


def _tagged(df: DataFrame, tag: str, lone: tuple[DataFrame, Column] | None, add_none: bool) -> DataFrame:
    """``df`` with ``{tag}_lone`` and ``{tag}_none``, which is true of the row of nulls only."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if lone is None:
        out = df.select(*columns, F.lit(False).alias(f"{tag}_lone"), F.lit(False).alias(f"{tag}_none"))
    else:
        out = df.crossJoin(F.broadcast(lone[0])).select(*columns, lone[1].alias(f"{tag}_lone"), F.lit(False).alias(f"{tag}_none"))
    if add_none:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
        out = out.union(df.sparkSession.range(1).select(*nulls, F.lit(False).alias(f"{tag}_lone"), F.lit(True).alias(f"{tag}_none")))
    return out
