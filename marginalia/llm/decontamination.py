"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick four words out of a window and ignore the rest, so a hash
still agrees where ignored words were substituted.  The masks' hashes of all
benchmark passages are joined with the hashes at every position of every
document; each hit names a document, a passage and an alignment, and the
words around it are compared one by one.

A document overlaps a passage when at least `overlap` of some `window`
consecutive passage words (of all words in a shorter passage) are found in
place along the alignment.  Runs of three or more words on alignments shifted
by up to `band` words also count, so an inserted or lost word doesn't hide
the rest.

Passages come in blocks of about `BLOCK_WORDS` words.  One block is sent to all
tasks; more are staged and read by the tasks that scan for them, so neither
driver nor executors hold more than one.  Documents are scanned once for each
block and never shuffled.  Hashes only propose; words are compared by 64-bit
hashes.  Where words recur in both a passage and a text, so that hits would
name most alignments over and over, all alignments are swept instead, in
bounded stretches, with the same result.

Passages of fewer than five words are found where they stand word for word.

Defined results: passages without words or with null text or identifier are
left out; null or empty documents overlap nothing; very long texts are
compared whole, their words hashed in bounded stretches; of alignments with
equally many matches the first stays; repeated rows are judged alike; an empty
table of either kind gives an empty table, or all documents; the input record
travels as a struct, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged_path, text_bytes, word_count
from .textkeys import mix, word_hashes

#: Fixed masks: offsets of the four words that count.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 4, 5), (0, 2, 3, 5), (0, 2, 5, 7), (0, 2, 3, 4), (0, 1, 2, 4))
MIN_WORDS = 5
#: For passages of one to four words: all of their words count.
WHOLE = tuple(tuple(range(n)) for n in range(1, MIN_WORDS))
OVERLAP, WINDOW, BAND = 0.8, 50, 8
#: Passage words, and their characters, in a block: with seven masks some 70 MB.
BLOCK_WORDS, BLOCK_CHARS = 500_000, 32 << 20
#: Alignments proposed for a pair are looked at one by one up to so many, or what costs no more than sweeping over all; and cells swept at a time.
SPARSE, STRETCH = 256, 1 << 20
_FACTORS = tuple(np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64)) for k in range(4))


def mask_hashes(words: np.ndarray, number: int) -> np.ndarray:
    """The hash of mask `number` at every position where it fits."""
    offsets = (MASKS + WHOLE)[number]
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(number + 1), dtype=np.uint64)
    for factor, at in zip(_FACTORS, offsets):
        out = (out ^ words[at : at + n]) * factor
    return mix(out)


class SeedIndex:
    """All mask hashes of a block of passages."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        words, counts = word_hashes([t for _, t in items])
        stops = np.cumsum(counts)
        self.items = [(i, words[e - c : e]) for (i, _), e, c in zip(items, stops, counts) if c]
        keys, owners, places, used = [], [], [], set()
        for k, (_, own) in enumerate(self.items):
            for number in range(len(MASKS)) if len(own) >= MIN_WORDS else [len(MASKS) + len(own) - 1]:
                used.add(number)
                h = mask_hashes(own, number)
                keys.append(h), owners.append(np.full(len(h), k, dtype=np.int32)), places.append(np.arange(len(h), dtype=np.int32))
        keys, owners, places = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((keys, np.uint64), (owners, np.int32), (places, np.int32)))
        self.numbers = sorted(used)
        # a passage's places of one hash follow each other; a posting is a hash in a passage
        order = np.lexsort((places, owners, keys))
        keys, owners, self.places = keys[order], owners[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.keys, self.owners, self.first = keys[first], owners[first], first
        self.many = np.diff(np.append(first, len(keys)))
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.keys >> np.uint64(44)] = True

    def overlaps(self, texts: list[bytes], *, overlap: float, window: int, band: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item identifier, place of the passage's first word, matched words, share) of each overlapping pair."""
        if not len(self.keys):
            return
        words, counts = word_hashes(texts)
        stops = np.cumsum(counts)
        found = []
        for number in self.numbers:
            offsets = (MASKS + WHOLE)[number]
            h = mask_hashes(words, number)
            at = np.flatnonzero(self.bits[h >> np.uint64(44)])
            lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
            many = hi - lo
            at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
            text = np.searchsorted(stops, at, "right")
            fits = at + offsets[-1] < stops[text]
            at, lo, many, text = at[fits], lo[fits], many[fits], text[fits]
            if not len(at):
                continue
            posting = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            found.append(np.stack([np.repeat(text, many), self.owners[posting], np.repeat(at, many), posting]))
        if not found:
            return
        hits = np.concatenate(found, axis=1)
        hits = hits[:, np.lexsort((hits[1], hits[0]))]
        pairs = np.flatnonzero(np.concatenate([[True], np.any(hits[:2, 1:] != hits[:2, :-1], axis=0), [True]]))
        for a, b in zip(pairs[:-1], pairs[1:]):
            text, item = int(hits[0, a]), int(hits[1, a])
            start = stops[text] - counts[text]
            doc, (item_id, passage) = words[start : stops[text]], self.items[item]
            if len(passage) < MIN_WORDS:
                # the first place of a short passage says all
                shifts = np.array([hits[2, a:b].min() - start])
                best = _aligned(doc, passage, shifts, window, band)
            elif self.many[hits[3, a:b]].sum() <= max(SPARSE, len(passage) * (len(passage) + len(doc)) // 8000):
                best = _aligned(doc, passage, np.unique(self._shifts(hits[2, a:b] - start, hits[3, a:b])), window, band)
            else:
                best = _swept(doc, passage, window, band)
            if best[0] >= overlap * min(window, len(passage)):
                yield text, item_id, best[1], int(best[2]), best[0] / min(window, len(passage))

    def _shifts(self, at: np.ndarray, posting: np.ndarray) -> np.ndarray:
        """The alignments that hits propose, one for each place of a hash in the passage."""
        many = self.many[posting]
        place = np.repeat(self.first[posting] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.repeat(at, many) - self.places[place]


def _runs(same: np.ndarray) -> np.ndarray:
    """What of the matches along the last axis is in runs of three or more."""
    runs = np.zeros_like(same)
    if same.shape[-1] >= 3:
        three = same[..., :-2] & same[..., 1:-1] & same[..., 2:]
        runs[..., :-2] |= three
        runs[..., 1:-1] |= three
        runs[..., 2:] |= three
    return runs


def _aligned(doc: np.ndarray, passage: np.ndarray, shifts: np.ndarray, window: int, band: int) -> tuple[int, int, int]:
    """(most matched words in a window of the passage, its shift, matched words in all) over given alignments."""
    n = len(passage)
    match = {}
    for shift in shifts.tolist():
        lo, hi = max(0, -shift), min(n, len(doc) - shift)
        same = np.zeros(n, dtype=bool)
        same[lo:hi] = passage[lo:hi] == doc[lo + shift : hi + shift]
        match[shift] = (same, _runs(same))
    best = (0, 0, 0)
    ordered = sorted(match)
    w = min(window, n)
    for k, shift in enumerate(ordered):
        same = match[shift][0].copy()
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(ordered) and abs(ordered[j] - shift) <= band:
                same |= match[ordered[j]][1]
                j += step
        total = np.concatenate([[0], np.cumsum(same)])
        most = int((total[w:] - total[:-w]).max())
        if most > best[0]:
            best = (most, shift, int(total[-1]))
            if most == w:
                break
    return best


def _swept(doc: np.ndarray, passage: np.ndarray, window: int, band: int) -> tuple[int, int, int]:
    """As `_aligned` over all alignments that a mask proposes, by a sweep over stretches of diagonals.

    For words that recur in the passage and in the text, where hits would name
    nearly every alignment many times.
    """
    n, w = len(passage), min(window, len(passage))
    # words that are nobody's stand around the text, so that every alignment is a whole one
    other = np.uint64(0)
    while (passage == other).any():
        other += np.uint64(1)
    edge = np.full(n + band, other, dtype=np.uint64)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, doc, edge]), n)
    lowest = -n - band  # the alignment of the first view
    best = (0, 0, 0)
    step = max(64, STRETCH // n)
    for at in range(band, len(views) - band, step):
        stop = min(at + step, len(views) - band)
        same = views[at - band : stop + band] == passage
        proposed = np.zeros(len(same), dtype=bool)
        for mask in MASKS:
            if n > mask[-1]:
                whole = np.ones((len(same), n - mask[-1]), dtype=bool)
                for offset in mask:
                    whole &= same[:, offset : offset + n - mask[-1]]
                proposed |= whole.any(axis=1)
        runs = np.cumsum(_runs(same) & proposed[:, None], axis=0, dtype=np.int32)
        runs = np.concatenate([np.zeros((1, n), np.int32), runs])
        own = np.flatnonzero(proposed[band : len(same) - band])
        if not len(own):
            continue
        matched = same[own + band] | (runs[own + 2 * band + 1] > runs[own])
        total = np.concatenate([np.zeros((len(own), 1), np.int32), np.cumsum(matched, axis=1, dtype=np.int32)], axis=1)
        most = (total[:, w:] - total[:, :-w]).max(axis=1)
        k = int(np.argmax(most))
        if most[k] > best[0]:
            best = (int(most[k]), lowest + at + int(own[k]), int(total[k, -1]))
            if best[0] == w:
                break
    return best


class _Blocks:
    """The passages in blocks of bounded size, each made into an index by the tasks that scan for it.

    A benchmark of one block is sent to all tasks.  A larger one is staged as
    Parquet, a folder a block, which tasks read; the driver holds its size only.
    """

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> None:
        rows = benchmark.select(benchmark[id_col].cast("long").alias("item"), benchmark[text_col].alias("text")).filter("item is not null and text is not null")
        words, size = rows.agg(F.sum(word_count(F.col("text"))), F.sum(F.length("text"))).first()
        self.n = max(1, -(-(words or 0) // block_words), -(-(size or 0) // BLOCK_CHARS))
        self.empty, self.path, self.sent = not words, None, None
        if self.empty:
            return
        if self.n == 1:
            items = [(r["item"], r["text"].encode()) for r in rows.collect()]
            self.sent = benchmark.sparkSession.sparkContext.broadcast(SeedIndex(items))
        else:
            self.path = staged_path(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(self.n)).cast("int")).repartition("block"), "passages", "block")

    def loader(self, block: int) -> Callable[[], SeedIndex]:
        sent, path = self.sent, self.path
        return (lambda: sent.value) if sent is not None else (lambda: _loaded(f"{path}/block={block}"))

    def __iter__(self) -> Iterator[Callable[[], SeedIndex]]:
        return iter([] if self.empty else [self.loader(b) for b in range(self.n)])


#: The index that this worker made last, by its folder.
_LAST: dict[str, SeedIndex] = {}


def _loaded(path: str) -> SeedIndex:
    if path not in _LAST:
        _LAST.clear()
        system, place = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
        files = [f.path for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=system, columns=["item", "text"], partitioning=None) for f in files]
        _LAST[path] = SeedIndex([(i, t.encode()) for table in tables for i, t in zip(table.column("item").to_pylist(), table.column("text").to_pylist())])
    return _LAST[path]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, overlap: float = OVERLAP, window: int = WINDOW, band: int = BAND, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, place, matched_words, overlap): one row for each overlapping pair."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("place", pa.int64()), ("matched_words", pa.int64()), ("overlap", pa.float64())])
    spark_schema = "doc_id long, item_id long, place long, matched_words long, overlap double"
    out = None
    for load in _Blocks(benchmark, item_col, item_text_col, block_words):

        def scan(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            index = load()
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[t], item, max(0, place), matched, share) for t, item, place, matched, share in index.overlaps(text_bytes(batch, "text"), overlap=overlap, window=window, band=band)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        part = rows.mapInArrow(scan, spark_schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], spark_schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, overlap: float = OVERLAP, window: int = WINDOW, band: int = BAND, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that overlap no passage, with all their columns; one narrow pass for each block."""
    spark = prepare(docs.sparkSession)
    out, columns = docs, docs.columns
    for load in _Blocks(benchmark, item_col, item_text_col, block_words):
        rows = out.select(F.struct(*[out[c] for c in columns]).alias("record"), out[text_col].alias("text"))

        def scan(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            index = load()
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for hit in index.overlaps(text_bytes(batch, "text"), overlap=overlap, window=window, band=band):
                    clean[hit[0]] = False
                yield batch.select(["record"]).filter(pa.array(clean))

        out = rows.mapInArrow(scan, rows.select("record").schema).select("record.*")
    return out
