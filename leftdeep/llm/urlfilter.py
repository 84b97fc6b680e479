"""URL filters whose lists change over time.

A list is a table of dated entries (kind, value, action, category, since): from that time
on the entry is added to or removed from the list. Consecutive entries of one (kind,
value, category) become validity intervals [since, until); of entries of one time a
removal wins. A capture (url, fetched) is joined as of its fetch time with the
intervals that held then: by its host and each parent domain (``domain``), by its exact
host (``host``), and by its host with each leading part of its path (``prefix``).

Each capture asks for a few keys by equality, so the join is an equi-join that needs no
range scan: its host, and of its parent domains and leading parts of the path those with a
number of labels or steps that the list has, so that a URL of any length asks for no more
keys than that, in time in proportion to its length. Within LIST_LIMIT estimated bytes the
list is broadcast; beyond, both sides are shuffled by a key that carries a salt of SALTS
values, since one host may have a third of all captures: the list's rows are repeated for
each salt, the captures are not.

Hosts are compared in lower case, without user, port and final dots; an IPv6 address keeps
its brackets and is one label. Paths are compared in lower case, without empty steps.

A capture has the hit of most specific kind (prefix, host, domain), then longest value,
then latest entry, then least category. A null or malformed URL, or a null fetch time,
has no hit. Repeated captures are judged alike, once for all; repeated entries count once;
entries with a null in kind, value, action or since are left out. Empty tables give no hits
or no rows. Existing columns with an output's name are replaced; all others, whatever their
names, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leftdeep.llm.session import unused
from leftdeep.operators.strategy import plan_bytes

KINDS = ("domain", "host", "prefix")
LIST_LIMIT, SALTS = 64 << 20, 16
#: Host and path of a URL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)"
PATH = r"^[^:/?#]+://[^/?#]*(/[^?#]*)"
FOREVER = "9999-12-31 00:00:00"


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, category, since, until) of the times at which an entry held."""
    rows = entries.where("kind IS NOT NULL AND value IS NOT NULL AND action IS NOT NULL AND since IS NOT NULL")
    key = ["kind", normal(F.col("value")).alias("value"), F.coalesce("category", F.lit("")).alias("category"), F.col("since").cast("timestamp_ntz").alias("since")]
    rows = rows.groupBy(*key).agg(F.max(F.col("action") == "remove").alias("removed"))
    after = Window.partitionBy("kind", "value", "category").orderBy("since")
    rows = rows.withColumn("until", F.coalesce(F.lead("since").over(after), F.lit(FOREVER).cast("timestamp_ntz")))
    return rows.where("NOT removed").select("kind", "value", "category", "since", "until")


def normal(value: Column) -> Column:
    """A host, or a host and path, as they are compared."""
    host, path = F.substring_index(value, "/", 1), F.regexp_extract(value, "^[^/]*(/.*)", 1)
    return F.lower(F.concat(F.regexp_replace(host, r"\.+$", ""), F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, HOST, 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def path_of(url: Column) -> Column:
    """Steps that each begin with a slash."""
    path = F.regexp_extract(url, PATH, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", ""))


def lengths(spans: DataFrame) -> tuple[list[int], list[int]]:
    """How many labels domains of the list have, and how many steps its prefixes."""
    sign = F.when(F.col("kind") == "domain", ".").otherwise("/")
    count = F.length("value") - F.length(F.replace("value", sign))
    found = spans.where("kind != 'host'").select("kind", count.alias("n")).distinct().collect()  # distinct lengths only
    return sorted(r["n"] + 1 for r in found if r["kind"] == "domain"), sorted(r["n"] for r in found if r["kind"] == "prefix")


def keys_of(url: Column, labels: list[int], steps: list[int]) -> Column:
    """array<struct<kind, value>>: all that entries of these lengths could call this URL."""
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    many = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign)))
    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")

    def keys(host: Column, path: Column) -> Column:
        last = lambda n: entry("domain", F.call_function("substring_index", host, F.lit("."), -n))
        first = lambda n: entry("prefix", F.concat(host, F.call_function("substring_index", path, F.lit("/"), n + 1)))
        domains = F.transform(F.filter(numbers(labels), lambda n: n <= many(host, ".") + 1), last)
        prefixes = F.transform(F.filter(numbers(steps), lambda n: n <= many(path, "/")), first)
        return F.when(host != "", F.concat(domains, F.array(entry("host", host)), prefixes)).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    both = F.array(F.struct(host_of(url).alias("host"), path_of(url).alias("path")))
    return F.transform(both, lambda x: keys(x["host"], x["path"]))[0]


def hits(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", salts: int = SALTS, limit: int = LIST_LIMIT) -> DataFrame:
    """(url, fetched, hit) of each distinct capture that an entry of its time calls."""
    spans = intervals(entries)
    seen = captures.select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").cast("timestamp_ntz").alias("fetched"))
    seen = seen.where("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    asked = seen.select("url", "fetched", F.explode(keys_of(F.col("url"), *lengths(spans))).alias("k")).select("url", "fetched", "k.kind", "k.value")
    key = ["kind", "value"]
    if plan_bytes(entries) <= limit:
        spans = F.broadcast(spans)
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(salts)))
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        key.append("salt")
    held = asked.join(spans, key).where("fetched >= since AND fetched < until")
    rank = F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
        F.length("value"),
        F.col("since"),
        F.concat(F.transform(F.split("category", ""), lambda c: -F.ascii(c)), F.array(F.lit(1))),  # the least, a shorter one before a longer
    )
    hit = F.struct("kind", "value", "category", "since")
    return held.groupBy("url", "fetched").agg(F.max_by(hit, rank).alias("hit"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", salts: int = SALTS, limit: int = LIST_LIMIT) -> DataFrame:
    """``captures`` with blocked, kind, value, category and since of the entry that holds."""
    url, at, hit = (unused(captures, x) for x in ("url", "at", "hit"))
    found = hits(captures, entries, url_col, time_col, salts, limit).withColumnsRenamed({"url": url, "fetched": at, "hit": hit})
    own_url, own_at = F.col(f"`{url_col}`"), F.col(f"`{time_col}`").cast("timestamp_ntz")
    whole = own_url.isNotNull() & own_at.isNotNull()
    out = captures.where(whole).join(found, (own_url == F.col(url)) & (own_at == F.col(at)), "left")
    new = {"blocked": F.col(hit).isNotNull(), **{c: F.col(f"{hit}.{c}") for c in ("kind", "value", "category", "since")}}
    kept = [F.col(f"`{c}`") for c in captures.columns if c not in new]
    out = out.select(*kept, *[c.alias(k) for k, c in new.items()])
    none = [F.lit(False).alias("blocked"), *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in list(new)[1:]]]
    return out.union(captures.where(~whole).select(*kept, *none))  # without a key they'd all meet in one task


#: The query's list, by rule: digits of the MD5 of a name say whether it is listed, as what, from
#: when, and for how long. Names are the hosts of all pages, and hosts with their first step.
FIRST_FETCH, DAYS = "2024-01-01", 730


def listed(pages: DataFrame) -> DataFrame:
    """The query's dated list, from a column url."""
    found = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    step = F.substring_index("path", "/", 2)
    names = found.select("host", F.col("host").alias("value"), F.lit(False).alias("step")).union(found.where("path != ''").select("host", F.concat("host", step), F.lit(True))).distinct()
    digits = lambda a: F.conv(F.substring(F.md5("value"), a, 2), 16, 10).cast("int")
    names = names.select("value", "step", digits(1).alias("a"), digits(3).alias("b"), digits(5).alias("c"))
    kind = F.when(F.col("step"), F.when(F.col("a") % 4 == 0, "prefix")).when(F.col("a") % 4 == 0, "domain").when(F.col("a") % 4 == 1, "host")
    names = names.withColumn("kind", kind).where("kind IS NOT NULL")
    first = F.col("b") * 2
    day = lambda n: F.date_add(F.lit(FIRST_FETCH).cast("date"), n).cast("timestamp_ntz").alias("since")
    row = lambda action, category, n: names.select("kind", "value", F.lit(action).alias("action"), category.alias("category"), day(n), "a", "b", "c")
    category = F.when(F.col("b") % 2 == 0, "ad").otherwise("spam")
    rows = row("add", category, first).union(row("add", F.lit("adult"), first).where("b % 4 = 0"))
    rows = rows.union(row("remove", category, first + 30 + F.col("c")).where("c % 2 = 0")).union(row("add", category, first + 60 + 2 * F.col("c")).where("c % 4 = 0"))
    return rows.drop("a", "b", "c")


def fetched(page_id: Column) -> Column:
    """Pages carry no fetch time: they count as fetched on DAYS days in turn."""
    return F.date_add(F.lit(FIRST_FETCH).cast("date"), F.pmod(page_id, F.lit(DAYS)).cast("int"))


def sql() -> str:
    """The query's rows over a table ``pages``."""
    digits = lambda a: f"CAST('0x' || substr(md5(value), {a}, 2) AS INTEGER)"
    day = lambda n: f"CAST(DATE '{FIRST_FETCH}' + CAST({n} AS INTEGER) AS DATE)"
    category = "CASE WHEN b % 2 = 0 THEN 'ad' ELSE 'spam' END"
    return f"""
WITH p AS (SELECT page_id, url, {day(f"((page_id % {DAYS}) + {DAYS}) % {DAYS}")} AS fetched, lower(regexp_replace(regexp_extract(url, '{HOST}', 1), '[.]+$', '')) AS host,
      lower(regexp_replace(regexp_replace(regexp_extract(url, '{PATH}', 1), '/+', '/', 'g'), '/$', '')) AS path FROM pages),
n AS (SELECT host AS value, false AS step FROM p WHERE host <> '' UNION SELECT host || '/' || split_part(path, '/', 2), true FROM p WHERE host <> '' AND path <> ''),
d AS (SELECT value, step, {digits(1)} AS a, {digits(3)} AS b, {digits(5)} AS c FROM n),
k AS (SELECT *, CASE WHEN step THEN CASE WHEN a % 4 = 0 THEN 'prefix' END WHEN a % 4 = 0 THEN 'domain' WHEN a % 4 = 1 THEN 'host' END AS kind FROM d),
l AS (SELECT kind, value, {category} AS category, {day("b * 2")} AS since, false AS removed FROM k UNION ALL SELECT kind, value, 'adult', {day("b * 2")}, false FROM k WHERE b % 4 = 0
      UNION ALL SELECT kind, value, {category}, {day("b * 2 + 30 + c")}, true FROM k WHERE c % 2 = 0 UNION ALL SELECT kind, value, {category}, {day("b * 2 + 60 + 2 * c")}, false FROM k WHERE c % 4 = 0),
g AS (SELECT kind, value, category, since, bool_or(removed) AS removed FROM l WHERE kind IS NOT NULL GROUP BY ALL),
s AS (SELECT *, lead(since, 1, DATE '9999-12-31') OVER (PARTITION BY kind, value, category ORDER BY since) AS until FROM g),
m AS (SELECT page_id, url, fetched, s.*, row_number() OVER (PARTITION BY page_id ORDER BY list_position(['domain', 'host', 'prefix'], kind) DESC, length(value) DESC, since DESC, category) AS r
      FROM p JOIN s ON NOT removed AND host <> '' AND fetched >= since AND fetched < until AND CASE kind WHEN 'host' THEN host = value
           WHEN 'domain' THEN host = value OR ends_with(host, '.' || value) ELSE starts_with(host || path || '/', value || '/') END)
SELECT p.page_id, p.url, p.fetched, kind IS NOT NULL AS blocked, kind, value, category, since FROM p LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (page_id)"""
