"""Quality rules: how far a document's character classes and common words lie from its language.

Each document gets two histograms: characters by class, and words by a list of common
ones (all others in one last bin). A language's reference is the mean of the histograms
of all its documents that have at least ``min_words`` words, so no document outweighs
another. A document is rejected if the Jensen-Shannon distance (base 2, 0 to 1) to the
reference of its language exceeds the limit. Documents under ``min_words`` words (for
common words: ``min_words_common``), and languages whose documents have under
``min_reference_words`` words in all, are not judged: their histograms say too little.

Base rules reject before that: fewer than ``min_words_kept`` words, or over
``max_repeated`` percent of words in 8-word windows that occur twice in the text.

Everything is a native expression. The features are computed in one scan and written
beside the columns that the result carries; references and verdicts come from that table.
Only the references, one row a language of the list plus one for all others, are broadcast. Null and empty texts have
no words and fail the base rules; a text of any length is judged whole. A null or unlisted
language is judged as "other". Rows are independent of their repetitions; an empty table
gives an empty result. Existing columns with an output's name are replaced; all others,
whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leftdeep.shared import stored

# Frequent words of the four languages, in order of frequency.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as this by at are from or an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch er",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como",
}
LANGUAGES = tuple(COMMON_WORDS)
SPACE = r"\x20\x09-\x0D"
#: Character classes as what is left of a text when all others are removed; white space,
#: other ASCII and non-ASCII characters follow from the lengths.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digits": "0-9", "stops": ".,;:!?'\"()-", "symbols": "#*$%&|<>"}
#: Bins of histograms are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    min_words_kept: int = 20
    max_repeated: int = 30
    min_words: int = 80
    min_words_common: int = 150
    min_reference_words: int = 2_000
    max_class_distance: float = 0.26
    max_word_distance: float = 0.27


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice, the first occurrence included."""

    def covered(windows: Column) -> Column:
        def runs(s: Column) -> Column:
            n = F.size(s)
            same = lambda i, j: F.get(s, i)["h"].eqNullSafe(F.get(s, j)["h"])
            twice = F.filter(s, lambda x, i: same(i - 1, i) | same(i, i + 1))
            at = F.array_sort(F.transform(F.when(n > 0, twice), lambda x: x["i"]))
            return _let(at, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"]))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(pairs, runs))

    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(words, lambda w: _let(hashes(w), covered)))


def _features(df: DataFrame, text_col: str, lang_col: str, prefix: str = "_q_") -> DataFrame:
    """Adds the document's counts and its two histograms."""
    name = lambda x: f"{prefix}{x}"
    text = F.col(name("text"))
    df = df.withColumn(name("text"), F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(name("words"), words_of(text))
    left = {k: F.char_length(F.regexp_replace(text, f"[^{v}]+", "")) for k, v in CLASSES.items()}
    df = df.withColumns(
        {
            name("lang"): F.when(F.col(lang_col).isin(*LANGUAGES), F.col(lang_col)).otherwise("other"),
            name("n_words"): F.size(name("words")),
            name("chars"): F.char_length(text),
            name("bytes"): F.octet_length(text),
            name("spaces"): F.char_length(F.regexp_replace(text, f"[^{SPACE}]+", "")),
            name("wide"): F.char_length(F.regexp_replace(text, r"[\x00-\x7F]+", "")),
            **{name(k): c for k, c in left.items()},
        }
    )
    known = [F.col(name(k)) for k in (*CLASSES, "spaces", "wide")]
    rest = F.col(name("chars")) - sum(known[1:], known[0])
    listed = sorted({w for v in COMMON_WORDS.values() for w in v.split()})
    longest = max(len(x.encode()) for x in listed) + 4  # longer ones aren't worth a look
    lower = F.transform(F.filter(name("words"), lambda w: F.octet_length(w) <= longest), F.lower)
    found = F.filter(lower, lambda w: w.isin(listed))  # a look-up in a hash set
    codes = F.array_join(F.transform(found, lambda w: F.array_position(F.array(*[F.lit(x) for x in listed]), w).cast("int")), ",")
    df = df.withColumn(name("codes"), F.concat(F.lit(","), F.replace(codes, F.lit(","), F.lit(",,")), F.lit(",")))
    hits = [
        ((F.octet_length(name("codes")) - F.octet_length(F.replace(F.col(name("codes")), F.lit(f",{i},"), F.lit("")))) / (len(str(i)) + 2)).cast("long")
        for i in range(1, len(listed) + 1)
    ]
    df = df.withColumn(name("hits"), F.array(*hits))
    others = F.col(name("n_words")) - F.aggregate(name("hits"), F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda counts, total: F.transform(counts, lambda x: F.floor(x * F.lit(UNIT) / F.greatest(total, F.lit(1))).cast("long"))
    return df.withColumns(
        {
            name("class_bins"): share(F.array(*[c.cast("long") for c in (*known, rest)]), F.col(name("chars"))),
            name("word_bins"): share(F.concat(name("hits"), F.array(others.cast("long"))), F.col(name("n_words"))),
        }
    )


def references(features: DataFrame, limits: Limits, prefix: str = "_q_") -> DataFrame:
    """One row a language: the summed bins of its documents, and their words. At most
    len(LANGUAGES) + 1 rows."""
    name = lambda x: f"{prefix}{x}"
    found = features.where(F.col(name("n_words")) >= limits.min_words)
    n_class, n_word = len(CLASSES) + 3, len({w for v in COMMON_WORDS.values() for w in v.split()}) + 1
    bins = {f"c{i}": F.col(name("class_bins"))[i] for i in range(n_class)} | {f"w{i}": F.col(name("word_bins"))[i] for i in range(n_word)}
    sums = found.groupBy(name("lang")).agg(F.sum(F.col(name("n_words")).cast("long")).alias(name("ref_words")), *[F.sum(c).alias(k) for k, c in bins.items()])
    return sums.select(
        name("lang"),
        name("ref_words"),
        F.array(*[f"c{i}" for i in range(n_class)]).alias(name("ref_class")),
        F.array(*[f"w{i}" for i in range(n_word)]).alias(name("ref_word")),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Of two arrays of weights, each scaled to 1; base 2."""
    total = lambda a: F.greatest(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1).cast("long"))
    scaled = lambda a: _let(total(a), lambda t: F.transform(a, lambda x: x / t))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(scaled(p), scaled(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(df: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang", carried: Sequence[str] | None = None) -> DataFrame:
    """The ``carried`` columns of ``df`` (all, if None) with n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed and kept."""
    columns = df.columns if carried is None else list(carried)
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    own = lambda x: F.col(f"{prefix}{x}")
    out = _features(df, text_col, lang_col, prefix)
    lines = F.filter(F.split(own("text"), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumns({f"{prefix}repeat": repeated_words(own("words")), f"{prefix}dup": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))})
    used = ("lang", "n_words", "chars", "spaces", "symbols", "dup", "repeat", "class_bins", "word_bins")
    out = stored(out.select(*[F.col(f"`{c}`") for c in columns], *[f"{prefix}{c}" for c in used]), "features")
    out = out.join(F.broadcast(references(out, limits, prefix)), f"{prefix}lang", "left")
    out = out.withColumns(
        {
            f"{prefix}class_distance": js_distance(own("class_bins"), own("ref_class")),
            f"{prefix}word_distance": js_distance(own("word_bins"), own("ref_word")),
            f"{prefix}failed": (own("n_words") < limits.min_words_kept) | (own("repeat") * 100 > own("n_words") * limits.max_repeated),
        }
    )
    judged = (own("n_words") >= limits.min_words) & (F.coalesce(own("ref_words"), F.lit(0)) >= limits.min_reference_words)
    common = own("n_words") >= limits.min_words_common
    far = (own("class_distance") > limits.max_class_distance) | (common & (own("word_distance") > limits.max_word_distance))
    results = {
        "n_words": own("n_words").cast("long"),
        "word_chars": (own("chars") - own("spaces")).cast("long"),
        "n_symbols": own("symbols").cast("long"),
        "n_dup_lines": own("dup").cast("long"),
        "n_repeat_words": own("repeat").cast("long"),
        "class_distance": own("class_distance"),
        "word_distance": own("word_distance"),
        "base_failed": own("failed"),
        "kept": ~own("failed") & ~(judged & F.coalesce(far, F.lit(False))),
    }
    return out.select(*[F.col(f"`{c}`") for c in columns if c not in results], *[c.alias(k) for k, c in results.items()])


def sql(limits: Limits = Limits()) -> str:
    """The same verdicts as ANSI SQL with list functions, over a table ``documents``."""
    listed = sorted({w for v in COMMON_WORDS.values() for w in v.split()})
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"length(regexp_replace(t, {quote(f'[^{v}]+')}, '', 'g'))" for v in CLASSES.values())
    spaces, wide = f"length(regexp_replace(t, '[^{SPACE}]+', '', 'g'))", r"length(regexp_replace(t, '[\x00-\x7F]+', '', 'g'))"
    share = lambda a, n: f"list_transform({a}, lambda x: CAST(floor(x * {UNIT} / greatest({n}, 1)) AS BIGINT))"
    scaled = lambda a: f"list_transform({a}, lambda x: x / greatest(list_sum({a}), 1))"
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({scaled(p)}, {scaled(q)}), lambda z: {term('z[1]', 'z[2]')} + {term('z[2]', 'z[1]')})) / 2))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({", ".join(map(quote, LANGUAGES))}) THEN lang ELSE 'other' END AS g FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l,
      [{known}, {spaces}, {wide}] AS k FROM d),
h AS (SELECT *, len(w) AS n, list_transform(w, lambda x: lower(x)) AS lw FROM w),
c AS (SELECT *, list_transform([{", ".join(map(quote, listed))}], lambda x: len(list_filter(lw, lambda y: y = x))) AS hits FROM h),
f AS (SELECT *, {share("list_append(k, length(t) - list_sum(k))", "length(t)")} AS cb, {share("list_append(hits, n - list_sum(hits))", "n")} AS wb FROM c),
r AS (SELECT g, sum(n) AS words FROM f WHERE n >= {limits.min_words} GROUP BY g),
rc AS (SELECT g, list(s ORDER BY i) AS rc FROM (SELECT g, i, sum(cb[i]) AS s FROM f, range(1, {len(CLASSES) + 4}) q(i) WHERE n >= {limits.min_words} GROUP BY g, i) GROUP BY g),
rw AS (SELECT g, list(s ORDER BY i) AS rw FROM (SELECT g, i, sum(wb[i]) AS s FROM f, range(1, {len(listed) + 2}) q(i) WHERE n >= {limits.min_words} GROUP BY g, i) GROUP BY g),
win AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, n - {WINDOW - 2})) AS i FROM h WHERE n >= {WINDOW})),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS m FROM win) WHERE m > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS m FROM twice, range(0, {WINDOW}) q(j) GROUP BY doc_id),
v AS (SELECT f.doc_id, n, length(t) - k[{len(CLASSES) + 1}] AS chars, k[{len(CLASSES)}] AS symbols, len(l) - len(list_distinct(l)) AS dup, coalesce(m, 0) AS rep,
      n >= {limits.min_words} AND coalesce(words, 0) >= {limits.min_reference_words} AS judged, {js("cb", "rc")} AS cd, {js("wb", "rw")} AS wd
      FROM f LEFT JOIN r USING (g) LEFT JOIN rc USING (g) LEFT JOIN rw USING (g) LEFT JOIN rep ON rep.doc_id = f.doc_id),
b AS (SELECT *, n < {limits.min_words_kept} OR 100 * rep > {limits.max_repeated} * n AS failed FROM v)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines,
       CAST(rep AS BIGINT) AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT (judged AND coalesce(cd > {limits.max_class_distance} OR (n >= {limits.min_words_common} AND wd > {limits.max_word_distance}), false)) AS kept
FROM b"""
