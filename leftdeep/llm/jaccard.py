"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct 5-word shingles (fewer words: the whole sequence
as one shingle). Two documents link when their sets' Jaccard similarity is at least
``percent`` percent. The steps:

1. Documents of equal sets form one class, known by its least doc_id.
2. Shingles get one global order, frequent ones last: a sketch of fixed size counts all
   shingles of all documents and only shapes the order, so its errors cost time but no
   links. Sets that are similar enough share a shingle among their first
   ``n - ceil(t n) + 1`` ones, their prefixes.
3. Classes of identical prefix and size collapse into one group; a group stands in the
   posting list of each shingle of its prefix.
4. Two rounds that merge: every group picks the partner that is most often the most
   central of its posting lists (the one with the greatest share of its prefix in lists of
   more than one), and that which most often precedes it by size; these pairs, and each
   member of a group with the group's first, are verified, and verified pairs form
   components. The second round picks among partners of other components. A crowd of near
   copies thus becomes few components through about as many pairs as members.
5. All pairs of groups that share a prefix shingle at places from which they can still
   reach the overlap, are of compatible size and aren't yet in one component are expanded
   to their members and verified exactly, as are the members of one group that are still
   apart. In each list the groups of its largest component meet those outside it only. So
   no link between different components is missed, and pairs inside a component, which
   can't change the result, are not made.

Pairs are verified in two steps: by 16 bits of each shingle, whose common ones are at least
as many as the shingles', and then by the texts, for the few that are left. Only what
belongs to candidate pairs is moved: a filter of bounded size picks it out of the scan.

Shingles that the sketch finds frequent have their posting lists dealt out under SALTS
salts; all others are in lists no longer than a counter's mean. What a list has to know of
itself (its centre, its components) is aggregated before it is shuffled.

doc_id is an integer and names a document: rows that share one are linked. Null texts and
texts without words have an empty set and no links. Repeated rows are in one class. A row
whose doc_id is null takes the component of its class, if any other row names it. A text of
any length is taken whole. Of the input's columns only the two named ones are read, so that
no other can clash. Shingles are compared by 64-bit hashes. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leftdeep.llm.components import components
from leftdeep.llm.exchange import pack, unpack
from leftdeep.llm.filters import may_hold
from leftdeep.llm.hashing import NOT_SPACE, batches, mix, ranges, shingles, word_hashes
from leftdeep.llm.session import give_back, giving_back
from leftdeep.shared import stored

SHINGLE, PERCENT = 5, 80
#: Counters of the sketch: 2**SKETCH_BITS, whatever the corpus (a byte of each to a worker).
SKETCH_BITS = 22
CHUNK = 1 << 14
#: Levels of the order go up by this many for each doubling of a counter over the mean.
STEPS = 2
#: Text that a worker hashes at once. Its arrays take some 50 times as much.
TEXT_BYTES = 1 << 18
#: Sublists of a frequent shingle's posting list, and groups whose prefix a task remembers.
SALTS, REMEMBERED = 64, 100_000
U = np.uint64


def sets_of(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted by hash."""
    for _, part in batches(texts, TEXT_BYTES):
        words, begins = word_hashes(part, NOT_SPACE)
        grams = shingles(words, k)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                yield shingles(words[a:b], b - a) if b > a else np.empty(0, U)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n needs with any partner."""
    return -(-percent * n // 100)


def _sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often shingles fall on each counter, over all documents."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in parts:
            for _, some in batches(part[text_col].tolist(), TEXT_BYTES):
                words, begins = word_hashes(some, NOT_SPACE)
                grams = shingles(words, SHINGLE)
                whole = np.ones(len(grams), bool)  # in one text
                for back in range(1, SHINGLE):
                    cut = begins[1:-1] - back
                    whole[cut[(cut >= 0) & (cut < len(whole))]] = False
                np.add.at(own, (grams[whole] >> U(64 - SKETCH_BITS)).astype(np.int64), 1)
        if own.any():
            for i in range(0, len(own), CHUNK):
                yield pd.DataFrame({"chunk": [i // CHUNK], "counts": [pack(own[i : i + CHUNK])]})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for c, b in zip(part["chunk"], part["counts"], strict=True):
                sums[c] = sums.get(c, U(0)) + unpack(b)[0]
        if sums:
            yield pd.DataFrame({"chunk": list(sums), "counts": [pack(x) for x in sums.values()]})

    schema = "chunk int, counts binary"
    rows = docs.select(text_col).mapInPandas(giving_back(count), schema).repartition("chunk").mapInPandas(giving_back(add), schema)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.toLocalIterator():  # 2**SKETCH_BITS numbers in all
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = unpack(bytes(r["counts"]))[0]
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for counters that chance explains; then STEPS more for each doubling."""
    mean = counts.mean()
    over = counts / (mean + 4 * np.sqrt(mean) + 2)
    return np.minimum(np.ceil(STEPS * np.log2(np.maximum(over, 1))), 31).astype(np.uint8)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of consecutive runs of values, modulo 2**64."""
    total = np.concatenate(([U(0)], np.cumsum(values, dtype=U)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _prefixes(docs: DataFrame, text_col: str, id_col: str, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2: a signature of the set, grp: one of the prefix, prefix, short: the
    sorted 16-bit hashes of the set). A group's prefix is left out where the same task has
    just had it."""
    order = docs.sparkSession.sparkContext.broadcast(levels(_sketch(docs, text_col)))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = order.value
        had: set[int] = set()
        for part in parts:
            sets = list(sets_of(part[text_col].tolist()))
            n = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            spread = mix(flat)
            s1, s2 = _sums(spread, n), _sums(mix(flat ^ U(0x5851F42D4C957F2D)), n)
            ranked, short, ends = (level[flat >> U(64 - SKETCH_BITS)].astype(U) << U(58)) | (spread >> U(6)), flat.astype(np.uint16), np.cumsum(n)
            keep = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
            prefixes = [np.sort(ranked[e - k : e])[:m] for e, k, m in zip(ends.tolist(), n.tolist(), keep.tolist(), strict=True)]
            place = ranges(np.zeros(len(n), np.int64), keep).astype(U)
            grp = _sums(mix(np.concatenate(prefixes) + place), keep) ^ np.where(n > 0, mix(n.astype(U)), U(0))
            if len(had) > REMEMBERED:
                had.clear()
            for i, g in enumerate(grp.tolist()):
                if g in had:
                    prefixes[i] = prefixes[i][:0]
                had.add(g)
            yield pd.DataFrame(
                {
                    "doc_id": part[id_col].astype("Int64").array,
                    "n": n.astype(np.int32),
                    "s1": s1.view(np.int64),
                    "s2": s2.view(np.int64),
                    "grp": grp.view(np.int64),
                    "prefix": [x.view(np.int64) for x in prefixes],
                    "short": [np.sort(short[e - k : e]).tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)],
                }
            )

    schema = "doc_id long, n int, s1 long, s2 long, grp long, prefix array<long>, short binary"
    return docs.select(id_col, text_col).mapInPandas(giving_back(look), schema)


def _similar(percent: int):
    @F.pandas_udf("boolean")
    def similar(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            out = []
            for x, y in zip(sets_of(a.tolist()), sets_of(b.tolist()), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                out.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pd.Series(out)
        give_back()

    return similar


def common_at_most(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted lists of 16-bit numbers have in common, repeats included."""
    both = np.concatenate((x, y))
    value, count = np.unique(both, return_counts=True)
    ours = np.searchsorted(x, value, side="right") - np.searchsorted(x, value)
    return int(np.minimum(ours, count - ours).sum())


def _may_be_similar(percent: int):
    """Of 16 bits of each shingle; never false for similar sets."""

    @F.pandas_udf("boolean")
    def may(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            out = []
            for p, q in zip(a, b, strict=True):
                x, y = np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16)
                low, high = sorted((len(x), len(y)))
                fits = 0 < low and low * 100 >= high * percent
                common = common_at_most(x, y) if fits else 0
                out.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pd.Series(out)
        give_back()

    return may


def _marked(table: DataFrame, ids: DataFrame) -> DataFrame:
    """About the rows of ``table`` whose doc_id is in ``ids``, found without a shuffle."""
    held = may_hold(table, ids.select(F.xxhash64(ids.columns[0]).alias("id")))
    return table.where("doc_id IS NOT NULL").where(held(F.xxhash64("doc_id")))


def _where_both(pairs: DataFrame, table: DataFrame, column: str, test) -> DataFrame:
    """The (a, b) of ``pairs`` whose ``column`` in ``table`` passes ``test``."""
    own = _marked(table.select("doc_id", column), pairs.select("a").union(pairs.select("b")))
    one = lambda c, t: own.select(F.col("doc_id").alias(c), F.col(column).alias(t))
    both = pairs.join(one("a", "_ta"), "a").join(one("b", "_tb"), "b")
    return both.where(test(F.col("_ta"), F.col("_tb"))).select("a", "b").distinct()


def _verified(pairs: DataFrame, found: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are similar."""
    likely = stored(_where_both(stored(pairs, "pairs"), found, "short", _may_be_similar(percent)), "likely")
    return _where_both(likely, docs, "text", _similar(percent))


def _fits(one: Column, other: Column, percent: int) -> Column:
    """Whether the sizes allow the similarity."""
    return F.least(one, other) * 100 >= F.greatest(one, other) * percent


def _postings(found: DataFrame, percent: int) -> DataFrame:
    """(token, salt, grp, n, pos) of all tokens that several groups of fitting sizes have in
    their prefixes, and perhaps of others."""
    frequent = F.shiftrightunsigned("token", 58) > 0
    rows = found.where("n > 0").select("grp", "n", F.posexplode("prefix").alias("pos", "token"))
    salt = F.when(frequent, F.pmod(F.xxhash64("grp", "token"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.select("token", salt.alias("salt"), "grp", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("place")).repartition("token", "salt")
    lists = rows.groupBy("token", "salt").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("of"), F.min("place").alias("small"), F.max("place").alias("large"))
    size = lambda place: F.shiftright(place, 32)
    useful = frequent | ((F.col("lo") != F.col("hi")) & ((F.col("of") > 2) | _fits(size("small"), size("large"), percent)))
    # An inner join by a unique key: a semi-join would be pushed below the exchange that both sides share.
    rows = rows.join(lists.where(useful).select("token", "salt").hint("shuffle_hash"), ["token", "salt"]).dropDuplicates(["token", "salt", "grp"])
    return rows.select("token", "salt", "grp", size("place").cast("int").alias("n"), F.pmod("place", F.lit(1 << 32)).cast("int").alias("pos"))


def _likely(posting: DataFrame, groups: DataFrame, percent: int, comps: DataFrame | None = None) -> DataFrame:
    """For each group the partners it shares most posting lists with: of the most central of
    each list, and of those next to it by size. ``comps``: partners of the same component
    don't count."""
    rows = posting.withColumn("c", F.col("grp")) if comps is None else posting.join(comps, "grp")
    me = F.struct("central", "n", "grp", "c")
    lists = rows.groupBy("token").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.max(me).alias("one")).where("_lo != _hi")
    sub = Window.partitionBy("token", "salt").orderBy("n", "grp")
    near = rows.withColumn("lag", F.lag(me).over(sub)).join(lists.select("token", "one"), "token")
    near = near.select("grp", "n", "c", F.posexplode(F.array("one", "lag")).alias("way", "p"))
    near = near.where((F.col("c") != F.col("p.c")) & _fits(F.col("n"), F.col("p.n"), percent))
    count = near.groupBy("way", "grp", F.col("p.grp").alias("_grp")).count()
    best = count.groupBy("way", "grp").agg(F.max_by("_grp", F.struct("count", "_grp")).alias("_grp"))
    best = best.select(F.least("grp", "_grp").alias("grp"), F.greatest("grp", "_grp").alias("_grp")).distinct()
    head = groups.select("grp", "gid")
    return best.join(head.withColumnRenamed("gid", "a"), "grp").join(head.select(F.col("grp").alias("_grp"), F.col("gid").alias("b")), "_grp").select("a", "b")


def _possible(posting: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that may be similar.

    Take the first shingle in the common order that two similar sets share: it is in both
    prefixes, and what follows it in either set, itself included, holds the whole overlap."""
    spread = named.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = posting.select("token", "grp", "n", "pos").join(spread, "grp")
    largest = rows.where("lo = hi").groupBy("token", "lo").count().groupBy("token").agg(F.max_by("lo", F.struct("count", "lo")).alias("_main"))
    lists = rows.groupBy("token").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).where("_lo != _hi").join(largest, "token", "left")
    rows = rows.join(lists.select("token", "_main"), "token")
    main = F.coalesce((F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("_main")), F.lit(False))
    rows = stored(rows.select("token", "grp", "n", "pos", "lo", "hi", main.alias("main")), "open")
    other = rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    apart = (F.col("lo") != F.col("hi")) | (F.col("_lo") != F.col("_hi")) | (F.col("lo") != F.col("_lo"))
    once = F.col("_main") | (F.col("grp") < F.col("_grp"))
    reach = F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) * (100 + percent) >= (F.col("n") + F.col("_n")) * percent
    shared = rows.where("NOT main").join(other, (F.col("token") == F.col("_token")) & once & apart & reach & _fits(F.col("n"), F.col("_n"), percent))
    shared = shared.select("grp", "_grp").distinct()
    shared = shared.union(spread.where("lo != hi").select("grp", F.col("grp").alias("_grp")))
    left = named.select("grp", F.col("rep").alias("a"), F.col("component").alias("ca"))
    right = named.select(F.col("grp").alias("_grp"), F.col("rep").alias("b"), F.col("component").alias("cb"))
    same = F.col("grp") == F.col("_grp")
    return shared.join(left, "grp").join(right, "_grp").where((F.col("ca") != F.col("cb")) & (~same | (F.col("a") < F.col("b")))).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Returns doc_id, n_shingles and component_id for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(_prefixes(docs, "text", "doc_id", percent), "prefixes")
    key = ["s1", "s2", "n"]
    heads = found.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("grp").alias("grp"))
    classes = stored(heads.where("rep IS NOT NULL"), "classes")
    groups = stored(classes.groupBy("grp").agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")

    posting = stored(_postings(found, percent), "postings")
    central = posting.groupBy("grp", "n").agg((F.count(F.lit(1)) * 1000 / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).cast("int").alias("central"))
    central_posting = posting.join(central.select("grp", "central"), "grp")

    crowded = groups.where("members > 1")
    in_group = classes.join(crowded.select("grp", "gid"), "grp").where("rep != gid").select(F.col("rep").alias("a"), F.col("gid").alias("b"))
    links = stored(_verified(_likely(central_posting, groups, percent).union(in_group), found, docs, percent), "links")
    comps = stored(components(links), "components").withColumnRenamed("node", "rep")
    of_group = groups.join(comps.withColumnRenamed("rep", "gid"), "gid", "left").select("grp", F.coalesce("component", "gid").alias("c"))
    links = stored(links.union(_verified(_likely(central_posting, groups, percent, of_group), found, docs, percent)), "links")
    comps = stored(components(links), "components").withColumnRenamed("node", "rep")

    wanted = posting.select("grp").union(crowded.select("grp")).distinct()
    named = classes.select("grp", "rep").join(wanted, "grp", "left_semi").join(comps, "rep", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "rep")), "named")
    comps = components(links.union(_verified(_possible(posting, named, percent), found, docs, percent)))

    of_class = classes.select(*key, "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select(*key, F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", *key).join(of_class, key, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
