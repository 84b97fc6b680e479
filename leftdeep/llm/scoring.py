"""Language-model scores from a weighted backoff automaton.

The model is interpolated over words (lower case, cut at white space) and an end token,
for n-grams of up to ``order`` tokens. As an automaton: each history of up to order - 1
tokens that occurs in the training texts is a state, the root is the empty one; an n-gram
of the training texts is an arc from its history's state, weighted with log10 of its
smoothed probability; every state has a failure arc, weighted with log10 of its backoff
weight, to the state without its oldest token. The root has an arc for each word and one
for unknown ones. A text is scored by one traversal from left to right that carries the
state: it follows failure arcs until the state has an arc for the token, takes it, adds all
weights on the way, and goes on from the longest state that the tokens read so far end in.

    root(w)       = (c(w) - DISCOUNT) / N, unknown words together DISCOUNT * V / N
    backoff of h  = max(LEAST_BACKOFF, RARE / (c(h) + RARE))          (called b)
    arc (h,w)     = (1 - b) * c(hw) / c(h) + b * p(w after h without its oldest token)

Probabilities of all words after any h add up to 1. As the state before a token is made of
the tokens before it, all of a chunk's traversals advance together, level by level.

Counts cover all training documents and nothing is pruned. No task holds the whole
automaton: chunks of documents ask for the counts of their own n-grams (see exchange), so
what is gathered grows with the corpus and memory doesn't. Keys are 56-bit hashes.

Ids are integers. Null and empty texts hold just the end token. A null id counts as a
training one. Repeated rows count each time. A text of any length is scored whole. Only
the two named columns are read, so that no other can clash. Without training texts all
words are unknown and every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leftdeep.llm import exchange
from leftdeep.llm.hashing import NOT_SPACE, mix, word_hashes
from leftdeep.shared import stored

U = np.uint64
END, START = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179)
DISCOUNT, LEAST_BACKOFF, RARE = 0.75, 0.6, 4.0
FOLDS, HELD_OUT = 5, 1
#: Longest n-grams.
ORDER = 3
UNIT = 1 << 20
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, ends included, and the text of each."""
    out, counts, part, held = [], [], [], 0

    def flush() -> None:
        words, begins = word_hashes(part, NOT_SPACE)
        out.append(np.insert(words, begins[1:], END))
        counts.append(np.diff(begins) + 1)

    for t in texts:
        part.append(t)
        held += len(t)
        if held >= UNIT:
            flush()
            part, held = [], 0
    if part:
        flush()
    counts = np.concatenate(counts)
    return np.concatenate(out), np.repeat(np.arange(len(counts)), counts)


def grams(tokens: np.ndarray, text: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``order``: the key of the n-gram that ends at each token, and whether
    there is one. START stands before each text and begins n-grams, but is none."""
    new = np.concatenate(([True], text[1:] != text[:-1]))
    place = np.arange(len(tokens)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    drop = U(64 - exchange.KEY_BITS)
    yield tokens >> drop, np.ones(len(tokens), bool)
    run = tokens
    for n in range(2, order + 1):
        back = np.roll(tokens, n - 1)
        back[place == n - 2] = START
        run = mix(back * U(0x9E3779B97F4A7C15) + run + U(n))
        yield run >> drop, place >= n - 2


class Automaton:
    """The part of the automaton that some texts touch, by the counts of their n-grams."""

    def __init__(self, n: int, v: int, starts: int):
        self.n, self.v, self.starts = n, v, starts

    def root(self, count: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.ones(len(count))
        return np.where(count > 0, count - DISCOUNT, DISCOUNT * self.v) / self.n

    @staticmethod
    def failure(state: np.ndarray) -> np.ndarray:
        """Backoff weights of states by their count; 1 where there is no state."""
        return np.where(state > 0, np.maximum(LEAST_BACKOFF, RARE / (state + RARE)), 1.0)

    def traverse(self, counts: list[np.ndarray], states: list[np.ndarray]) -> np.ndarray:
        """log10 weights of tokens. ``counts``: of the n-grams that end at each token, for n
        from 1 on; ``states``: of the histories of one token, two and so on before it."""
        arc = self.root(counts[0])
        weight = np.log10(arc)
        for count, state in zip(counts[1:], states, strict=True):
            b = self.failure(state)
            arc = (1 - b) * count / np.maximum(state, 1) + b * arc
            # With an arc here the failure arcs below aren't followed; else this one is as well.
            weight = np.where(count > 0, np.log10(arc), np.log10(b) + weight)
        return weight


def _ask(parts: int, order: int):
    def of_chunk(name: str, ids: list, texts: list[bytes]) -> Iterator[pd.DataFrame]:
        tokens, text = tokens_of(texts)
        trains = np.array([not is_held_out(i) for i in ids], float)[text]
        for level, (keys, real) in enumerate(grams(tokens, text, order), 1):
            distinct, at = np.unique(keys[real], return_inverse=True)
            yield exchange.asked(level, name, distinct, parts, np.bincount(at, trains[real], len(distinct)).astype(U))

    return of_chunk


def _count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Total counts for each chunk's keys; and a row with their sum and how many are above 0."""
    given = [exchange.unpacked(b, 1) for b in rows["blob"]]
    distinct, at = np.unique(np.concatenate([g[0] for g in given]), return_inverse=True)
    total = np.bincount(at, np.concatenate([g[1] for g in given]).astype(float)).astype(U)
    cut = np.cumsum([0, *(len(g[0]) for g in given)])
    end = END >> U(64 - exchange.KEY_BITS)
    starts = int(total[distinct == end].sum()) if key[0] == 1 else 0
    stats = np.array([total.sum(), np.count_nonzero(total), starts], U)
    blobs = [exchange.answered(total[at[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame({"level": key[0], "part": key[1], "chunk": [*rows["chunk"], ""], "blob": [*blobs, exchange.pack(stats)]})


def _counts(found: pd.DataFrame, level: int, keys: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The answers for each token's n-gram; 0 where there is none."""
    distinct, at = np.unique(keys[real], return_inverse=True)
    answer = exchange.in_order(found, level)
    if len(answer) != len(distinct):
        raise RuntimeError("the answers don't fit the chunk")
    out = np.zeros(len(keys))
    out[real] = answer[at]
    return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = exchange.CHUNK_BYTES, part_bytes: int = exchange.PART_BYTES
) -> DataFrame:
    """Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    parts = exchange.parts_for(docs, text_col, part_bytes)
    chunked = exchange.held(docs, id_col, text_col, chunk_bytes)
    asked = exchange.ask(chunked, _ask(parts, order))
    answers = stored(asked.repartition(exchange.tasks(parts * order), "level", "part").groupBy("level", "part").applyInPandas(_count, exchange.ASKED), "counts")
    n = v = starts = 0
    for r in answers.where("chunk = '' AND level = 1").toLocalIterator():  # three numbers of each part
        a, b, c = exchange.unpack(bytes(r["blob"]))[0].tolist()
        n, v, starts = n + a, v + b, starts + c

    def of_chunk(name: str, ids: list, texts: list[bytes], found: pd.DataFrame) -> Iterator[pd.DataFrame]:
        tokens, text = tokens_of(texts)
        begins = np.concatenate(([True], text[1:] != text[:-1]))
        counts = [_counts(found, level, *g) for level, g in enumerate(grams(tokens, text, order), 1)]
        states = []
        for k, count in enumerate(counts[:-1]):
            state = np.concatenate(([0.0], count[:-1]))
            state[begins] = 0 if k else starts
            states.append(state)
        weights = Automaton(n, v, starts).traverse(counts, states)
        word = counts[0]
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        sums = lambda x: np.bincount(text, x, len(ids))
        yield pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "held_out": [is_held_out(i) for i in ids],
                "n_tokens": np.bincount(text, minlength=len(ids)),
                "n_known": sums(word > 0).astype(np.int64),
                "train_tokens": n,
                "base_score": sums(base),
                "score": sums(weights),
            }
        )

    return exchange.meet(chunked, answers.where("chunk != ''"), of_chunk, SCORED)
