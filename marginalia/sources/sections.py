"""Long files of many sections read by byte ranges, in pieces that end where a section does.

A section begins at a line `## name`.  A range emits the sections that begin in
it, some PIECE_BYTES at once, and reads on past its end to finish the last one.
A section is as large as it is, a file of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled
from .json_ranges import _files, _read
from .markdown import opened

RANGE_BYTES, PIECE_BYTES, FURTHER_BYTES = 4 << 20, 64 << 10, 64 << 10
#: A heading in a whole line, as the registry has it; one that ends the file begins no piece.
HEAD = re.compile(rb"(?:\A|(?<=[\r\n]))##[ \t]+\S+[ \t]*(?=[\r\n])")
_PIECES = pa.schema([("rel", pa.string()), ("start", pa.int64()), ("content", pa.string())])


def _pieces(file: str, start: int, size: int, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    system, path = opened(file)
    base, end, more = max(start - 1, 0), start + size, FURTHER_BYTES
    data, ended = _read(system, path, base, end - base), False

    def heads() -> list[int]:
        return [base + m.start() for m in HEAD.finditer(data) if base + m.start() >= start and (m.start() or not base)]

    found = heads()
    # headings are told by whole lines, so the last line of the range is read to its end too
    while not ended and not (found and found[-1] >= end):
        further = _read(system, path, base + len(data), more)
        data, ended, more = data + further, not further, 2 * more
        found = heads()
    own = sorted({0, *found} if not start else found)
    stop = next((at for at in own if at >= end), base + len(data))
    own = [at for at in own if at < end]
    while own:
        begin = own[0]
        own = [at for at in own if at >= begin + piece_bytes]
        until = own[0] if own else stop
        try:
            content = data[begin - base : until - base].decode().replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            content = None
        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(([file], [begin], [content]), _PIECES.types)], schema=_PIECES)


def read_sections(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(rel, start, content): pieces of whole sections of a file or of a folder's files, with the byte at which each begins.

    A file that can't be decoded has none.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _pieces(row["file"], row["start"], row["size"], piece_bytes)

    listed = [f for f in _files(path) if f[1]]
    files = spark.createDataFrame(listed, "file string, bytes long")
    starts = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("file", "start", F.least(F.lit(range_bytes), F.col("bytes") - F.col("start")).cast("long").alias("size"))
    n = int(min(10_000, max(1, sum(-(-b // range_bytes) for _, b in listed))))
    rows = settled(ranges.repartition(n, "file", "start").mapInArrow(pieces, "rel string, start long, content string"))
    return rows.join(rows.filter("content is null").select("rel").distinct(), "rel", "left_anti")
