"""A kept trigram index for line search (PR2, PR3, J18, PF18): a search reads the postings of its trigrams and the blocks they name.

A block is up to BLOCK_LINES lines of one file.  An index is a folder with
three tables, each parted by the batch that was written:

    lines     (block, corpus, rel, folder, line_no, line), sorted by block
              within a file, a file's blocks being its own, so a filter on
              blocks skips files and row groups
    postings  (bucket, tri, segment, piece, blocks): for each trigram and each
              SEGMENT blocks the bitmap of those that have it, compressed;
              parted by a hash of the trigram and sorted by it.  A segment with
              many trigrams is given in pieces of whole blocks
    names     (corpus, rel) of the batch; a later batch replaces a file

Lines are dealt by a hash of their block and numbered there, so texts are
shuffled once for the table and once for the trigrams; a task has whole
segments and sends on bitmaps, never a pair of a block and a trigram.

A literal needs all its trigrams.  A regular expression needs those of the
literals that every match has, for one of its alternatives; what can't be told
is not asked for.  Blocks found are then searched as a full scan would, so
results are equal to a scan.  Queries that give no trigram scan all lines.

Case: lines are indexed in lower case, as literals are compared.  Regular
expressions fold ASCII letters only, so only their ASCII literals are used.
"""

from __future__ import annotations

import re
import re._parser as pattern_parser
import warnings
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_literal
from ..session import settled

BLOCK_LINES, BUCKETS = 256, 64
#: Alternatives of a regular expression that are told apart, and blocks named in a filter that skips row groups.
ALTERNATIVES, NAMED = 32, 2_000
#: Segments of a bucket that share a file.
FILE_SEGMENTS = 8
#: Bytes of a row group of lines: what a search for one block reads.
ROW_GROUP = 2 << 20
#: Blocks of a segment; pairs of a block and a trigram that a task holds; trigrams whose bitmaps are made at once.
SEGMENT, PAIRS, MADE = 4096, 2 << 20, 1024
#: Characters whose trigrams are found at once.
CHARS = 1 << 20
#: Bytes of the bitmaps that Spark's functions read.
BITMAP = 4096
#: Parts by which lines are dealt, for each shuffle partition: more of them are spread more evenly.
PARTS = 8
KEYS = ("corpus", "rel", "folder")


def _bucket(tri: Column) -> Column:
    return F.pmod(F.xxhash64(tri), F.lit(BUCKETS)).cast("int")


def write_index(lines: DataFrame, path: str, batch: int = 0) -> None:
    """Add lines (corpus, rel, folder, line_no, line) as a batch; a batch written again replaces itself."""
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = lines.select(*KEYS, "line_no", "line").filter("line is not null").withColumn("chunk", ((F.col("line_no") - 1) / BLOCK_LINES).cast("long"))
    dealt = kept.withColumn("part", F.pmod(F.xxhash64(*KEYS, "chunk"), F.lit(tasks * PARTS)).cast("int")).repartition(tasks, "part")
    dealt = settled(dealt.withColumn("own", F.dense_rank().over(Window.partitionBy("part").orderBy(*KEYS, "chunk"))).sortWithinPartitions("part", "own", "line_no"))
    # a part's blocks start after those of the parts before it: a row a part
    sizes = dealt.groupBy("part").agg(F.max("own").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = dealt.join(F.broadcast(starts), "part").select((F.col("before") + F.col("own")).cast("int").alias("block"), *KEYS, "line_no", "line")
    placed.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{path}/lines/batch={batch}")
    written = spark.read.parquet(f"{path}/lines/batch={batch}")
    low = written.select("block", ((F.col("block") - 1) / SEGMENT).cast("int").alias("segment"), F.lower("line").alias("low")).repartition(tasks, "segment").sortWithinPartitions("block")
    postings = low.mapInArrow(_bitmaps, "tri string, segment int, piece int, blocks binary")
    # a file for each bucket and some segments, so there are more as the lines grow
    postings = postings.withColumn("bucket", _bucket(F.col("tri"))).repartition("bucket", (F.col("segment") / FILE_SEGMENTS).cast("int")).sortWithinPartitions("bucket", "tri", "segment", "piece")
    postings.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings/batch={batch}")
    written.select("corpus", "rel").distinct().write.mode("overwrite").parquet(f"{path}/names/batch={batch}")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """(blocks, texts) of some CHARS characters; a longer line comes in pieces that share two characters."""
    blocks, texts, size = [], [], 0
    for batch in batches:
        for block, low in zip(batch.column("block").to_pylist(), batch.column("low").cast(pa.binary()).to_pylist()):
            text = low.decode(errors="replace")
            for at in range(0, max(len(text) - 2, 1), CHARS):
                blocks.append(block)
                texts.append(text[at : at + CHARS + 2])
                size += len(texts[-1])
                if size >= CHARS:
                    yield blocks, texts
                    blocks, texts, size = [], [], 0
    if blocks:
        yield blocks, texts


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of the texts as numbers, the text that each is in), with repetitions; none crosses a text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    line = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    inside = line[2:] == line[:-2]
    return ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], line[2:][inside]


def _made(segment: int, piece: int, blocks: list[int], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of the trigrams of whole blocks of a segment."""
    if not blocks:
        return
    place = np.repeat((np.array(blocks) - 1) % SEGMENT, [len(c) for c in codes]).astype(np.int16)
    code = np.concatenate(codes)
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = np.concatenate([first[1:], [len(code)]])
    for at in range(0, len(first), MADE):
        begin, end = first[at : at + MADE], ends[at : at + MADE]
        n = len(begin)
        bits = np.zeros((n, SEGMENT), bool)
        bits[np.repeat(np.arange(n), end - begin), place[begin[0] : end[-1]]] = True
        own = code[begin]
        three = np.stack([own >> 42, (own >> 21) & 0x1FFFFF, own & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        packed = [b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")]
        yield pa.RecordBatch.from_arrays([pa.array([three[i : i + 3] for i in range(0, 3 * n, 3)], pa.string()), pa.array([segment] * n, pa.int32()), pa.array([piece] * n, pa.int32()), pa.array(packed, pa.binary())], names=["tri", "segment", "piece", "blocks"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in the order of their blocks to bitmaps of segments, or of pieces of them, that hold PAIRS pairs or so."""
    segment, piece, held = None, 0, 0
    blocks: list[int] = []
    codes: list[np.ndarray] = []
    for own_blocks, texts in _texts(batches):
        found, line = _coded(texts)
        of = np.array(own_blocks)
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
        for (start, end), (a, b) in zip(pairwise(cuts), pairwise(np.searchsorted(line, cuts))):
            block, own = int(of[start]), np.unique(found[a:b])
            if blocks and blocks[-1] == block:  # goes on from the texts before
                held -= len(codes[-1])
                codes[-1] = np.union1d(codes[-1], own)
                held += len(codes[-1])
                continue
            if (block - 1) // SEGMENT != segment or held > PAIRS:
                yield from _made(segment, piece, blocks, codes)
                piece = piece + 1 if (block - 1) // SEGMENT == segment else 0
                segment, held, blocks, codes = (block - 1) // SEGMENT, 0, [], []
            blocks.append(block)
            codes.append(own)
            held += len(own)
    yield from _made(segment, piece, blocks, codes)


def required(query: str, mode: str = "literal") -> list[set[str]] | None:
    """Sets of trigrams of which a matching line has one whole; None where nothing can be said."""
    alternatives = [{query}] if mode == "literal" else _alternatives(query)
    if alternatives is None:
        return None
    found = [{low[i : i + 3] for text in texts for low in [text.lower()] for i in range(len(low) - 2)} for texts in alternatives]
    return found if all(found) else None


def _alternatives(query: str) -> list[set[str]] | None:
    """Sets of ASCII literals, of which a match has one whole."""
    # other engines read these differently: classes in classes, flags, quotes, named groups
    if re.search(r"\[[^\]]*(\[|&&)|\(\?[^:=!<]|\(\?<[^=!]|\\[QEhHvVRXGkKNzZpPx0cuU]", query):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _needed(pattern_parser.parse(query))
    except (re.error, Warning, OverflowError, RecursionError):
        return None


def _needed(items) -> list[set[str]]:
    found, run = [set()], []

    def both(more: list[set[str]]) -> None:
        nonlocal found
        # either side alone is needed too, so a product that grows too large is left out
        if len(found) * len(more) <= ALTERNATIVES:
            found = [a | b for a in found for b in more]

    def ended() -> None:
        if len(run) >= 3:
            both([{"".join(run)}])
        run.clear()

    for op, value in items:
        name = str(op)
        if name == "LITERAL" and value < 128:
            run.append(chr(value))
        elif name == "AT":
            continue  # takes no character
        else:
            ended()
            if name == "SUBPATTERN":
                both(_needed(value[3]))
            elif name == "ATOMIC_GROUP":
                both(_needed(value))
            elif name.endswith("_REPEAT") and value[0] > 0:
                both(_needed(value[2]))
            elif name == "BRANCH":
                branches = [alternative for branch in value[1] for alternative in _needed(branch)]
                both(branches)
    ended()
    return found


def _set_bits(bitmap: Column) -> Column:
    """Positions from 0 of a bitmap's set bits."""
    one = lambda i: F.substring(bitmap, i, 1)
    filled = F.filter(F.sequence(F.lit(1), F.length(bitmap)), lambda i: one(i) != F.lit(b"\0"))
    bits = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.conv(F.hex(one(i)), 16, 10).cast("int"), k) == 1), lambda k: (i - 1) * 8 + k)
    return F.flatten(F.transform(filled, bits))


def candidates(spark: SparkSession, path: str, needed: list[set[str]]) -> DataFrame:
    """(batch, block) of the blocks that have all trigrams of one set."""
    all_of = sorted(set().union(*needed))
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in all_of], "tri string").select(_bucket(F.col("tri")).alias("b")).distinct().collect()]
    rows = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets) & F.col("tri").isin(all_of))
    sets = spark.createDataFrame([(i, t, len(one)) for i, one in enumerate(needed) for t in sorted(one)], "one int, tri string, n int")
    padded = F.concat("blocks", F.lit(bytes(BITMAP - SEGMENT // 8)))
    joined = rows.join(F.broadcast(sets), "tri").groupBy("batch", "segment", "piece", "one", "n").agg(F.bitmap_and_agg(padded).alias("blocks"), F.count("*").alias("found"))
    whole = joined.filter("found = n").groupBy("batch", "segment").agg(F.bitmap_or_agg("blocks").alias("blocks"))
    return whole.select("batch", (F.col("segment") * SEGMENT + 1).alias("first"), F.explode(_set_bits(F.col("blocks"))).alias("at")).select("batch", (F.col("first") + F.col("at")).cast("int").alias("block"))


def search(spark: SparkSession, path: str, query: str, mode: str = "literal") -> DataFrame:
    """(corpus, rel, folder, line_no, line) of all lines that match, each file as its last batch has it."""
    lines = spark.read.parquet(f"{path}/lines")
    needed = required(query, mode)
    if needed is not None:
        blocks = candidates(spark, path, needed)
        named = blocks.limit(NAMED + 1).collect()
        if len(named) > NAMED:
            lines = lines.join(blocks, ["batch", "block"], "left_semi")
        else:  # named in the filter, so files and row groups without them are skipped
            by_batch = {b: [r["block"] for r in named if r["batch"] == b] for b in {r["batch"] for r in named}}
            wanted = F.lit(False)
            for batch, own in by_batch.items():
                wanted = wanted | ((F.col("batch") == batch) & F.col("block").isin(own))
            lines = lines.filter(wanted)
    found = lines.filter((F.col("line") != "") & contains_literal("line", query, mode))
    names = spark.read.parquet(f"{path}/names")
    newest = names.groupBy("corpus", "rel").agg(F.max("batch").alias("batch"))
    return found.join(newest, ["corpus", "rel", "batch"], "left_semi").select(*KEYS, "line_no", "line")
