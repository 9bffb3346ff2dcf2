"""Large JSON files read by byte ranges (SC10, SC11): one array a file, on one line or many, or one value a line.

Spark reads a file whose array spans lines in one task.  Here every file is cut
into byte ranges and read twice.  First each range says, for each state in which
it may begin (outside strings, inside one, inside one after a backslash), in
which it ends and how much deeper.  A scan over these rows, a range each, tells
every range its state and depth; then ranges emit the values that begin in
them, reading on past their end to finish the last one.  Bytes are judged in
numpy, a range at a time; a value is as large as it is, a file of any size.

A file is an array if its first byte that is no white space is an opening
bracket; else its values are parted by line breaks outside strings and
brackets.  Files that end early yield what they hold, the last value cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled
from .markdown import opened

RANGE_BYTES = 16 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_BLANK = b" \t\r\n"
_MARK = np.zeros(256, np.int8)
_MARK[list(b'"\\,\n')] = 2
_MARK[list(b"[{")] = 1
_MARK[list(b"]}")] = -1


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, depth changes, state at the end) of what stands outside strings: brackets, commas, line breaks."""
    skip = int(state == ESCAPED and len(data) > 0)
    if state == ESCAPED and not skip:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), ESCAPED
    raw = np.frombuffer(data, np.uint8)[skip:]
    at = np.flatnonzero(_MARK[raw])
    kind = raw[at]
    slash = kind == 92
    # a byte is escaped if the run of backslashes just before it is of odd length
    place = at[slash]
    begins = np.concatenate([[True], np.diff(place) > 1]) if len(place) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0)) if len(place) else np.zeros(0, np.int64)
    odd = (np.arange(len(place)) - start) % 2 == 0
    last = np.concatenate([begins[1:], [True]]) if len(place) else begins
    escaped = place[odd & last] + 1
    quote = at[(kind == 34) & ~np.isin(at, escaped, assume_unique=True)]
    inside = (np.searchsorted(quote, at, side="right") + (state != OUTSIDE)) % 2 == 1
    keep = ~inside & (kind != 34) & ~slash
    ends = (len(quote) + (state != OUTSIDE)) % 2
    if ends and len(escaped) and escaped[-1] == len(raw):
        ends = ESCAPED
    return at[keep] + skip, np.where(np.abs(_MARK[kind[keep]]) == 1, _MARK[kind[keep]], 0), int(ends)


def _read(system: fs.FileSystem, path: str, start: int, size: int) -> bytes:
    with system.open_input_file(path) as file:
        file.seek(start)
        return file.read(size)


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("first", pa.string()), *[(f"end{s}", pa.int64()) for s in range(3)], *[(f"deeper{s}", pa.int64()) for s in range(3)]])
_PLACED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("lines", pa.bool_()), ("state", pa.int64()), ("depth", pa.int64())])
_VALUES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("value", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["file"])
            data = _read(system, path, row["start"], row["size"])
            found = [structure(data, state) for state in range(3)]
            first = data.lstrip(_BLANK)[:1].decode("latin-1")
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([row["file"], row["start"], row["size"], first, *[f[2] for f in found], *[int(f[1].sum()) for f in found]], _SUMMARY.types)], schema=_SUMMARY)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States and depths of the ranges, in order; a file that opens with no bracket has values by line."""
    file, state, depth = None, OUTSIDE, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["file"] != file:
                file, state, depth = r["file"], OUTSIDE, 0
            out.append((file, r["start"], r["size"], r["first"] != "[", state, depth))
            state, depth = r[f"end{state}"], depth + r[f"deeper{state}"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PLACED.types)], schema=_PLACED)


def _borders(data: bytes, state: int, depth: int, lines: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(where values may begin, where they end, state and depth after the data); both are positions of the mark that parts them."""
    at, deeper, state_after = structure(data, state)
    after = depth + np.cumsum(deeper, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)[at]
    if lines:
        both = at[(raw == 10) & (after == 0)]
        return both, both, state_after, int(after[-1]) if len(after) else depth
    comma = (raw == 44) & (after == 1)
    opens, closes = (deeper == 1) & (after == 1), (deeper == -1) & (after == 0)
    return at[comma | opens], at[comma | closes], state_after, int(after[-1]) if len(after) else depth


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["file"])
            base, lines = row["start"], row["lines"]
            data = _read(system, path, base, row["size"])
            begin, end, state, depth = _borders(data, row["state"], row["depth"], lines)
            begin = begin + 1
            if lines and base == 0:
                begin = np.concatenate([[0], begin])  # the first value has no line break before it
            if not len(begin):
                continue
            # the last value may go on behind the range: read until its end, or the file's
            pieces, size, ends = [data], len(data), [end]
            while not (len(ends[-1]) and ends[-1][-1] >= begin[-1]):
                more = _read(system, path, base + size, row["size"])
                if not more:
                    break
                _, further, state, depth = _borders(more, state, depth, lines)
                ends.append(further + size)
                pieces.append(more)
                size += len(more)
            data, end = b"".join(pieces), np.concatenate(ends)
            out: list[tuple] = []
            held = 0
            for a, k in zip(begin, np.searchsorted(end, begin)):
                value = data[a : end[k] if k < len(end) else size].strip(_BLANK)
                if value:
                    out.append((row["file"], base + int(a), value.decode(errors="replace")))
                    held += len(value)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _VALUES.types)], schema=_VALUES)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _VALUES.types)], schema=_VALUES)


def _files(path: str) -> list[tuple[str, int]]:
    """(path or URI, size) of a file, or of a folder's files but for hidden ones and marks."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    own = [i for i in found if i.type == fs.FileType.File and not any(p.startswith((".", "_")) for p in i.path[len(root) :].strip("/").split("/"))]
    return [(path.rstrip("/") + i.path[len(root) :], i.size) for i in own]


def json_values(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, value): the text of every top-level value, with the byte at which its place begins."""
    files = spark.createDataFrame([f for f in _files(path) if f[1]], "file string, bytes long")
    starts = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("file", "start", F.least(F.lit(range_bytes), F.col("bytes") - F.col("start")).cast("long").alias("size"))
    n = int(min(10_000, max(1, sum(-(-b // range_bytes) for _, b in _files(path)))))
    summaries = ranges.repartition(n, "file", "start").mapInArrow(_summaries, _ddl(_SUMMARY))
    # ranges of white space may come before the first value
    opening = F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    summaries = summaries.withColumn("first", opening)
    # a row a range: one thin pass in order
    placed = settled(summaries.repartition(1).sortWithinPartitions("file", "start").mapInArrow(_scanned, _ddl(_PLACED)))
    return placed.repartition(n, "file", "start").mapInArrow(_values, _ddl(_VALUES))
