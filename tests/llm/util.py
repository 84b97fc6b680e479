"""Small corpora with the awkward cases: nulls, empties, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random
import re

WORDS = "the of and to in a is der die und de la le les que für año naïve état 12 x-y, end. stop! a|b #tag 3.5 ÀÉ".split()


def corpus(n: int = 40, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(k))
    out = [text(rng.choice([1, 5, 30, 90, 200])) for _ in range(n)]
    out += [None, "", " \n\t ", "  ", out[0], out[0], out[1], (out[2] + "\n") * 3, "x" * 5000, text(3000), "😀 emoji 漢字 \x00 nul"]
    return list(enumerate(out))


def frame(spark, rows, extra: bool = True):
    """Columns that clash with outputs and with internal names come along."""
    data = [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t or ""), -1, "old", i) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids int, kept string, n_words long"
    df = spark.createDataFrame(data, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def ascii_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
