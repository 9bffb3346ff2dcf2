"""Tasks that read texts where they lie: words counted, questions scored, passages looked for.

What goes on from a task doesn't grow with the texts' words: counts of the
vocabulary, each question's best k, and the pairs of a passage and a text that
contains it.  Words are those of `functions.text.tokens`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import patterns as P

Batches = Iterator[pa.RecordBatch]

_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Lower case of ASCII letters and digits, a space for any other byte.
_WORD_BYTES = bytes(c if c in _ALNUM else 32 for c in range(256)).lower()
_NO_WORDS = frozenset([*(w.encode() for w in P.STOP_WORDS), *(bytes([c]) for c in _ALNUM.lower())])

#: Words that a task counts before it passes them on; texts read at once.
VOCABULARY, TEXTS = 250_000, 512
#: Pairs of a document and a question, and their shared tokens, that are held at once.
CELLS = 2_000_000


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for at in range(0, batch.num_rows, TEXTS):
        part = batch.slice(at, TEXTS)
        yield part, part.column(name).cast(pa.binary()).to_pylist()


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def vocabulary(batches: Batches) -> Batches:
    """(text) to (token, df, length): partial counts of the texts that have a token; a row without one has the number of words."""
    counts, length = Counter(), 0

    def out() -> pa.RecordBatch:
        for word in _NO_WORDS:
            counts.pop(word, None)
        tokens = pa.array([*counts, None], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([tokens, pa.array([*counts.values(), 0], pa.int64()), pa.array([None] * len(counts) + [length], pa.int64())], names=["token", "df", "length"])

    for batch in batches:
        for _, texts in _texts(batch):
            for text in texts:
                words = _words(text)
                length += len(words) - sum(map(_NO_WORDS.__contains__, words))
                counts.update(set(words))
                if len(counts) >= VOCABULARY:
                    yield out()
                    counts, length = Counter(), 0
    yield out()


@dataclass
class Asked:
    """What questions ask for: tokens, and of token i the askers and their weights in `at[i]` to `at[i + 1]`."""

    qids: pa.Array
    tokens: list[bytes]
    at: np.ndarray
    askers: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Asked:
        """From (qid, token, weight)."""
        rows = rows.combine_chunks().sort_by("token")
        qids = pc.unique(rows.column("qid")) if rows.num_rows else pa.array([], rows.schema.field("qid").type)
        askers = pc.index_in(rows.column("qid"), qids).to_numpy()
        tokens, sizes = np.unique(np.array(rows.column("token").cast(pa.binary()).to_pylist(), object), return_counts=True)
        return cls(qids, tokens.tolist(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), askers.astype(np.int64), rows.column("weight").to_numpy().astype(float))


class _Best:
    """Each question's best k so far, by rounded score and then identifier."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.held, self.rows = k, np.full(n, -np.inf), [], 0

    def add(self, question: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        self.held.append(pa.table({"q": question, "doc_id": ids, "score": score}))
        self.rows += len(question)
        if self.rows > max(4 * self.k * len(self.least), 10_000):
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        rows = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        q = rows.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = rows.column("score").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        self.held, self.rows = [rows], rows.num_rows
        return rows


def _rounded(score: np.ndarray, places: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(score) * 10.0**places + 0.5) / 10.0**places, score)


def scored(asked: Asked, avgdl: float, k: int, *, k1: float, b: float, places: int) -> Callable[[Batches], Batches]:
    """(doc_id, text, dl, counts) to (qid, doc_id, score): each question's best k of a task's documents that share a token with it.

    A document has a text, or its length and the counts of its asked tokens.
    """
    n, size = len(asked.qids), len(asked.tokens)
    positive = bool((asked.weights > 0).all())

    def counted(index: dict[bytes, int], texts: list[bytes | None], part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, token and count of what is asked, and the documents' lengths."""
        own = [[*map(index.get, _words(text), repeat(size))] for text in texts]
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        flat = np.fromiter(chain.from_iterable(own), np.int64, len(row))
        dl = np.bincount(row[flat >= 0], minlength=len(own)).astype(float)
        use = (flat >= 0) & (flat < size)
        key, tf = np.unique(row[use] * size + flat[use], return_counts=True)
        if part.column("counts").null_count < part.num_rows:
            for i, (length, counts) in enumerate(zip(part.column("dl").to_pylist(), part.column("counts").to_pylist(), strict=True)):
                if counts is not None:
                    dl[i], counts = length, [x for x in counts if x["token"].encode() in index]
                    key = np.concatenate([key, [i * size + index[x["token"].encode()] for x in counts]]).astype(np.int64)
                    tf = np.concatenate([tf, [x["tf"] for x in counts]])
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
        return key // size, key % size, tf.astype(float), dl

    def run(batches: Batches) -> Batches:
        index = {w: -1 for w in _NO_WORDS} | {w: i for i, w in enumerate(asked.tokens)}
        best, askers_of = _Best(n, k), np.diff(asked.at)
        for batch in batches:
            for part, texts in _texts(batch):
                ids = part.column("doc_id")
                row, token, tf, dl = counted(index, texts, part)
                share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                # as many documents at once as there is room for
                room = np.cumsum(np.maximum(np.bincount(row, askers_of[token], minlength=len(texts)), n))
                starts = np.searchsorted(row, np.arange(len(texts) + 1))
                at = 0
                while at < len(texts):
                    to = max(at + 1, int(np.searchsorted(room, (room[at - 1] if at else 0) + CELLS, "right")))
                    here = slice(starts[at], starts[to])
                    times = askers_of[token[here]]
                    ends = np.cumsum(times)
                    asks = np.repeat(asked.at[token[here]] - ends + times, times) + np.arange(int(times.sum()))
                    cell = np.repeat(row[here] - at, times) * n + asked.askers[asks]
                    score = np.bincount(cell, np.repeat(share[here], times) * asked.weights[asks], minlength=(to - at) * n)
                    shared = score > 0 if positive else np.bincount(cell, minlength=(to - at) * n) > 0
                    score = np.where(shared, score, -np.inf).reshape(to - at, n)
                    least = best.least
                    if to - at > k:
                        least = np.maximum(least, np.partition(score, to - at - k, axis=0)[to - at - k])
                    doc, question = np.nonzero((score >= least - 2 * 10.0**-places) & np.isfinite(score))
                    if len(doc):
                        best.add(question, ids.take(pa.array(doc + at)), _rounded(score[doc, question], places))
                    at = to
        if (rows := best.cut()) and rows.num_rows:
            doc_id = rows.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([asked.qids.take(pa.array(rows.column("q").to_numpy())), doc_id, pa.array(rows.column("score").to_numpy())], names=["qid", "doc_id", "score"])

    return run


def containing(qids: pa.Array, passages: list[bytes]) -> Callable[[Batches], Batches]:
    """(doc_id, text) to (qid, doc_id): the passages that a text contains.

    The words between a passage's first and last one are whole in any text that
    contains it; so only texts that have its longest inner word are searched,
    and all for a passage of fewer than three words.
    """
    by_word: dict[bytes, list[int]] = {}
    anywhere = []
    for i, passage in enumerate(passages):
        inner = [w for w in passage.split(b" ") if w][1:-1]
        (by_word.setdefault(max(inner, key=len), []) if inner else anywhere).append(i)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part, texts in _texts(batch):
                doc, question = [], []
                for d, text in enumerate(texts):
                    if text is not None:
                        tried = [i for w in by_word.keys() & set(text.split(b" ")) for i in by_word[w]] + anywhere
                        found = [i for i in tried if passages[i] in text]
                        doc += [d] * len(found)
                        question += found
                if doc:
                    yield pa.RecordBatch.from_arrays([qids.take(pa.array(question)), part.column("doc_id").take(pa.array(doc))], names=["qid", "doc_id"])

    return run
