r"""Personal data replaced by keyed pseudonyms of the same format.

Numbers that pass their check, and valid dates, go through a Feistel network over their
own domain: a bijection that depends on a key. So a card number becomes another number
with a right check digit, a date another date, and equal values become equal values in
whatever document they stand; whoever has the key can invert it. Separators stay.

- card: 13 to 19 digits, plain or in groups, with a right Luhn digit; the other digits are
  permuted and the check digit follows.
- IBAN: right modulo-97 check; the account part is permuted, the check digits follow.
- social security number ddd-dd-dddd: permuted among the valid ones.
- phone: + and a country code, or (ddd) ddd-dddd, or ddd-ddd-dddd, of 10 to 15 digits in all;
  digits after the country code are permuted.
- IPv4 address: permuted among the 32-bit addresses.
- date: yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy, existing and from 1900 to 2099: permuted
  among the days of these years.
- e-mail: the part before @, letters and digits each among themselves.
- hex: a run of 32 to 64 hexadecimal digits, as in access tokens.

Numbers that fail their check are left alone. All of it is native expressions, without a
shuffle. Rounds are HMAC-SHA256 under the key; the keyed blocks come from a subquery of one
row, so that no plan, and so no event log, shows them. A match of any length takes time in
proportion to it: a round hashes each half once, and no pattern repeats a group without a
bound. A null text stays null with no replacement; an empty one stays empty; rows don't
depend on each other, so repeats stay repeats; an empty table stays empty. Existing columns
with an output's name are replaced; all others, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leftdeep.llm.session import unused

ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In order of precedence where they begin at the same place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "hex": r"(?<!\w)(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{32,64}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w.])(?:\d{13,19}|\d{4}(?:(?: \d{4}){2} |(?:-\d{4}){2}-)\d{1,7}|\d{4}(?: \d{6} |-\d{6}-)\d{5})(?!\w)",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\w)",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match has in it.
SIGN = "[0-9@]"
#: Days from 1900-01-01 on that dates are permuted among, as a product.
DAYS = (17, 4297)
FIRST_DAY = "1900-01-01"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def keyed(key: str) -> tuple[bytes, bytes]:
    """HMAC-SHA256's two keyed blocks."""
    raw = key.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _key_column(spark: SparkSession, key: str) -> Column:
    """struct<i, o> of the keyed blocks, as a scalar subquery: a plan shows only its name."""
    inner, outer = keyed(key)
    row = spark.sql("SELECT named_struct('i', unhex(a), 'o', unhex(b)) AS k FROM VALUES (:a, :b) AS v(a, b)", args={"a": inner.hex(), "b": outer.hex()})
    return row.scalar()


def _mac(key: Column, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as hexadecimal digits."""
    message = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
    return F.sha2(F.concat(key["o"], F.unhex(F.sha2(F.concat(key["i"], message), 256))), 256)


def _number(key: Column, *parts: Column) -> Column:
    """60 bits that depend on the key and the parts."""
    return F.conv(F.substring(_mac(key, *parts), 1, 15), 16, 10).cast("long")


def permuted_pair(key: Column, kind: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """(a, b) of [0, size_a) x [0, size_b), permuted: struct<a, b>."""
    add = lambda x, other, i, size: (x + _number(key, F.lit(kind), i, other) % size) % size
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")),
        lambda s, i: F.when(i % 2 == 0, F.struct(add(s["a"], s["b"], i, size_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), add(s["b"], s["a"], i, size_b).alias("b"))
        ),
    )


def permuted_text(key: Column, kind: str, text: Column, letters: int = 26) -> Column:
    """Digits and ASCII letters permuted in place, each within its class; the halves of the
    text take turns in moving the other's characters."""
    last = chr(96 + letters)

    def moved(half: Column, other: Column, i: Column) -> Column:
        """Character j moves by 16 bits of block j / 16: the first is a hash of the other half,
        the next ones are hashes of the first."""

        def by_blocks(blocks: Column) -> Column:
            def one(c: Column, j: Column) -> Column:
                by = F.conv(F.substring(F.get(blocks, F.floor(j / 16).cast("int")), j % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int")
                turn = lambda low, size: F.char(F.lit(low) + (F.ascii(c) - low + by) % size)
                return (
                    F.when(c.between("0", "9") & (F.octet_length(c) == 1), turn(48, 10))
                    .when(c.between("a", last) & (F.octet_length(c) == 1), turn(97, letters))
                    .when(c.between("A", last.upper()) & (F.octet_length(c) == 1), turn(65, letters))
                    .otherwise(c)
                )

            return F.transform(half, one)

        def by_first(first: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(half) - 1, F.lit(0)) / 16).cast("int"))
            return _let(F.transform(numbers, lambda b: F.when(b == 0, first).otherwise(F.sha2(F.concat(first, b.cast("string")), 256))), by_blocks)

        return _let(_mac(key, F.lit(kind), i, F.size(half), F.array_join(other, "")), by_first)

    def run(chars: Column) -> Column:
        n = F.length(text)
        cut = F.floor(n / 2).cast("int")
        halves = F.struct(F.slice(chars, F.lit(1), cut).alias("l"), F.slice(chars, cut + 1, n - cut).alias("r"))
        swap = lambda s, i: F.struct(s["r"].alias("l"), moved(s["l"], s["r"], i).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, swap, lambda s: F.array_join(F.concat(s["l"], s["r"]), ""))

    return _let(F.split(text, ""), run)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _refilled(shape: Column, content: Column, kept: str = "0-9") -> Column:
    """``shape`` with its ``kept`` characters replaced by those of ``content``, in order."""

    def add(s: Column, c: Column) -> Column:
        taken = F.struct(F.concat(s["out"], F.substring(content, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        return F.when(c.rlike(f"[{kept}]"), taken).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), add, lambda s: s["out"])


def _luhn(digits: Column, odd_first: int) -> Column:
    """The Luhn sum; ``odd_first`` is 1 if the last digit counts once (a whole number), 0 if
    it counts twice (a number without its check digit)."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == odd_first, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The number that a text of digits and capitals (A is 10) stands for, modulo 97."""

    def add(s: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c < 58, (s * 10 + c - 48) % 97).otherwise((s * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card(key: Column, m: Column) -> Column:
    def body(d: Column) -> Column:
        new = permuted_text(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        checked = lambda p: F.concat(p, ((10 - _luhn(p, 0) % 10) % 10).cast("string"))
        return F.when(_luhn(d, 1) % 10 == 0, _refilled(m, _let(new, checked))).otherwise(m)

    return _let(_digits(m), body)


def _iban(key: Column, m: Column) -> Column:
    def body(t: Column) -> Column:
        country, account = F.substring(t, 1, 2), F.substring(t, F.lit(5), F.length(t))
        right = _mod97(F.concat(account, F.substring(t, 1, 4))) == 1

        def made(a: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
            return _refilled(m, F.concat(country, check, a), "0-9A-Z")

        return F.when(right, _let(permuted_text(key, "iban", account), made)).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), body)


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    right = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def made(s: Column) -> Column:
        p = F.floor(s["a"] / 99)
        new = F.when(p >= 665, p + 2).otherwise(p + 1)
        return F.format_string("%03d-%02d-%04d", new, s["a"] % 99 + 1, s["b"] + 1)

    return F.when(right, _let(permuted_pair(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999), made)).otherwise(m)


def _phone(key: Column, m: Column) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=\D)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    right = F.length(_digits(m)).between(10, 15)
    return F.when(right, F.concat(code, _let(permuted_text(key, "phone", _digits(rest)), lambda p: _refilled(rest, p)))).otherwise(m)


def _ip(key: Column, m: Column) -> Column:
    part = F.split(m, r"\.")
    half = lambda i: part[i].cast("long") * 256 + part[i + 1].cast("long")
    octets = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _let(permuted_pair(key, "ip", half(0), half(2), 65536, 65536), lambda s: F.concat_ws(".", *octets(s["a"]), *octets(s["b"])))


def _date(key: Column, m: Column) -> Column:
    def body(d: Column) -> Column:
        number = F.date_diff(d, F.lit(FIRST_DAY).cast("date"))

        def made(s: Column) -> Column:
            new = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS[1] + s["b"]).cast("int"))
            shown = lambda f: F.date_format(new, f)
            return F.when(m.contains("-"), shown("yyyy-MM-dd")).when(m.contains("."), shown("dd.MM.yyyy")).otherwise(shown("MM/dd/yyyy"))

        inside = (number >= 0) & (number < DAYS[0] * DAYS[1])
        return F.when(inside, _let(permuted_pair(key, "date", F.floor(number / DAYS[1]), number % DAYS[1], *DAYS), made)).otherwise(m)

    y, mo, d = (
        F.when(m.contains("-"), F.substring(m, a, n)).when(m.contains("."), F.substring(m, b, n)).otherwise(F.substring(m, c, n))
        for a, b, c, n in ((1, 7, 7, 4), (6, 4, 1, 2), (9, 1, 4, 2))
    )
    return _let(F.concat_ws("-", y, mo, d).try_cast("date"), body)


def _email(key: Column, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_text(key, "email", F.substring(m, F.lit(1), at - 1)), F.substring(m, at, F.length(m)))


MAKERS = {
    "email": _email,
    "hex": lambda key, m: permuted_text(key, "hex", m, 6),
    "iban": _iban,
    "card": _card,
    "ip": _ip,
    "date": _date,
    "ssn": _ssn,
    "phone": _phone,
}


def pseudonym(key: Column, match: Column) -> Column:
    """What a match of ANY becomes: itself if it fails its check."""
    out = None
    for kind, make in MAKERS.items():
        is_kind = match.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(is_kind, make(key, match)) if out is None else out.when(is_kind, make(key, match))
    return F.coalesce(out.otherwise(match), match)


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """``df`` with ``text_col`` rewritten in place and ``count_col``, how many values changed."""
    name, key_name = unused(df, "pseudonymized"), unused(df, "key")
    text, secret = F.col(f"`{text_col}`"), F.col(key_name)
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))

    def joined(parts: Column) -> Column:
        made = F.transform(parts["found"], lambda m: pseudonym(secret, m))
        return _let(
            made,
            lambda new: F.struct(
                F.concat(
                    F.array_join(F.transform(new, lambda x, i: F.concat(F.get(parts["gaps"], i), x)), ""),
                    F.element_at(parts["gaps"], -1),
                ).alias("text"),
                F.size(F.filter(F.zip_with(new, parts["found"], lambda a, b: a != b), lambda x: x)).cast("long").alias("n"),
            ),
        )

    parts = F.struct(found.alias("found"), F.split(text, ANY, -1).alias("gaps"))
    whole = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(text.rlike(SIGN) & text.rlike(ANY), _let(parts, joined)).otherwise(whole)
    out = df.withColumn(key_name, _key_column(df.sparkSession, key)).withColumn(name, done)
    new = {text_col: F.col(f"{name}.text"), count_col: F.col(f"{name}.n")}
    kept = [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]
    return out.select(*kept, *[v.alias(k) for k, v in new.items() if k not in df.columns])
