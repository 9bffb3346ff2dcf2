"""Conversation prefix trie by a range sort and a stack sweep.

Every conversation becomes the array of its turns' digests, all of one width,
so arrays that share turns share leading characters.  Arrays are range-sorted
over the cluster; a partition takes the longest common prefix (LCP) of
neighbours and sweeps the LCP intervals with a stack of open nodes: a node
closes when a neighbour shares less than its depth, and hands its counts to its
parent.  Nodes that reach a partition's first or last array may go on next
door: they leave as open stack entries, and one thin pass over these (two
stacks a partition) stitches them, closes them, and tells the children in each
partition who their parent is.

Only digests, lengths and identifiers travel.  Equal arrays are ordered by
identifier, so a group of equal conversations spreads over partitions; the
identifiers that end at a node which goes on next door follow as chunks of
text, and the node's hash reads them one after the other.

Defined results: null roles and texts are empty; turns of equal number are
ordered by their digest; rows without a conversation identifier belong to no
conversation and are left out; repeated rows are turns of their own; an empty
table has no nodes; extra columns are not read.  One conversation's array is
one row, so it has fewer than 90 million turns.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, scratch, staged
from .exact import shared_prefix

#: Characters of a turn's digest in the sort key: 132 bits of SHA-256.
WIDTH = 22
#: Turns in one range partition, and identifiers in one chunk.
PARTITION_TURNS, CHUNK_IDS = 250_000, 50_000
#: Up to so many stitched stack entries are sent to all tasks.
BROADCAST_ENTRIES = 200_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [(name.split()[0], pa.string() if name.endswith("string") else pa.int64()) for name in NODE.split(", ")]
#: `kind` of a swept record.
CLOSED, OPEN, CHUNK, PARENT = 0, 1, 2, 3
_SWEPT = pa.schema([*_NODE, ("kind", pa.int64()), ("part", pa.int64()), ("side", pa.int64()), ("chunk", pa.int64()), ("digest", pa.string()), ("chars", pa.int64()), ("ends", pa.string())])
SWEPT = f"{NODE}, kind long, part long, side long, chunk long, digest string, chars long, ends string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as structs of turn, digest and chars."""
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.base64(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))), 1, WIDTH)
    turn = F.struct(turns["turn"].alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(arrays: DataFrame, *, block: int = 100, most: int = 6) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % block in place of its own; h is its CRC-32 modulo `most`."""
    heads = arrays.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    none = F.slice("turns", 1, 0)
    rebuilt = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return own.join(heads, "base", "left").select("conv_id", rebuilt.alias("turns"))


class _Stack:
    """Open nodes from the root down, one entry a depth: what is known of each but for its open child."""

    def __init__(self) -> None:
        self.digest: list = []
        self.chars: list[int] = []
        self.low: list = []
        self.count: list[int] = []
        self.children: list[int] = []
        self.leaves: list[int] = []
        self.saved: list[int] = []
        self.ends: list = []  # hex digest of a complete run, or a hash that goes on
        self.waiting: list[list[tuple]] = []  # closed children, until this node's smallest member is known

    def __len__(self) -> int:
        return len(self.count)

    def push(self, digest: str | None, chars: int) -> None:
        self.digest.append(digest)
        self.chars.append(chars)
        self.low.append(None)
        self.count.append(0)
        self.children.append(0)
        self.leaves.append(0)
        self.saved.append(0)
        self.ends.append(None)
        self.waiting.append([])

    def absorb(self, low: int | None, count: int, children: int, leaves: int, saved: int) -> None:
        """Add to the deepest open node."""
        if low is not None:
            self.low[-1] = low if self.low[-1] is None else min(low, self.low[-1])
        self.count[-1] += count
        self.children[-1] += children
        self.leaves[-1] += leaves
        self.saved[-1] += saved

    def pop(self) -> tuple:
        """(digest, chars, low, count, children, leaves, saved, ends, waiting) of the deepest node, as it stands."""
        return tuple(column.pop() for column in (self.digest, self.chars, self.low, self.count, self.children, self.leaves, self.saved, self.ends, self.waiting))

    def close(self) -> tuple[list[tuple], tuple]:
        """Close the deepest node: its children with their parent, and its own row; its counts go to its parent."""
        depth = len(self) - 1
        _, chars, low, count, children, leaves, saved, ends, waiting = self.pop()
        leaves, saved = leaves or 1, saved + (count - 1) * chars
        if depth:
            self.absorb(low, count, 1, leaves, saved)
        if ends is not None and not isinstance(ends, str):
            ends = ends.hexdigest()
        resolved = [(*row[:2], low, *row[3:]) for row in waiting]
        return resolved, (low, depth, None, count, children, leaves, saved, ends or _NOTHING)


class _Rows:
    """Swept records, by column."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in _SWEPT]

    def add(self, node: tuple, kind: int, part: int | None = None, side: int | None = None, chunk: int | None = None, digest: str | None = None, chars: int | None = None, ends: str | None = None) -> None:
        for column, value in zip(self.columns, (*node, kind, part, side, chunk, digest, chars, ends)):
            column.append(value)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(self.columns, _SWEPT.types)], schema=_SWEPT)
            self.columns = [[] for _ in _SWEPT]


def _joined(ids: array) -> str:
    return ",".join(map(str, ids))


def sweep(batches: Iterator[pa.RecordBatch], part: int, chunk_ids: int = CHUNK_IDS) -> Iterator[pa.RecordBatch]:
    """The nodes of one sorted partition of (conv_id, key, chars), and its open stacks."""
    stack, out = _Stack(), _Rows()
    before = None  # the array before this one
    left = 0  # nodes of at most this depth hold the partition's first array
    run, run_depth = array("q"), 0

    def entry(side: int, depth: int, digest, chars, low, count, children, leaves, saved, ends) -> None:
        out.add((low, depth, None, count, children, leaves, saved, ends), OPEN, part, side, -1, digest, chars)

    def chunks(side: int, depth: int) -> None:
        for k, at in enumerate(range(0, len(run), chunk_ids)):
            out.add((None, depth, *[None] * 6), CHUNK, part, side, k, ends=_joined(run[at : at + chunk_ids]))

    def end_run() -> None:
        """The identifiers that end at the deepest node are complete, but where they hold the partition's first."""
        if run_depth <= left:
            chunks(0, run_depth)
        else:
            stack.ends[-1] = hashlib.sha256(_joined(run).encode()).hexdigest()

    for batch in batches:
        for conv, key, chars in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "key", "chars")]):
            depth = len(key) // WIDTH
            if before is None:
                common, left = -1, depth
            elif key == before:
                run.append(conv)
                stack.absorb(conv, 1, 0, 0, 0)
                continue
            else:
                common = shared_prefix(key, before) // WIDTH
                end_run()
                while len(stack) - 1 > common:
                    at = len(stack) - 1
                    if at <= left:
                        # all that this partition knows of a node that may have begun before it
                        digest, said, low, count, children, leaves, saved, ends, waiting = stack.pop()
                        for row in waiting:
                            out.add(row, CLOSED, part, 0)
                        entry(0, at, digest, said, low, count, children, leaves, saved, ends)
                        continue
                    resolved, row = stack.close()
                    for child in resolved:
                        out.add(child, CLOSED)
                    if at - 1 <= left:
                        out.add(row, CLOSED, part, 0)
                    else:
                        stack.waiting[-1].append(row)
                left = min(left, common)
            for d in range(common + 1, depth + 1):
                stack.push(key[(d - 1) * WIDTH : d * WIDTH].decode() if d else None, chars[d - 1] if d else 0)
            run, run_depth = array("q", [conv]), depth
            stack.absorb(conv, 1, 0, 0, 0)
            before = key
        yield from out.batches(4000)
    if before is not None:
        chunks(0 if run_depth <= left else 1, run_depth)
        while len(stack):
            at = len(stack) - 1
            side = 0 if at <= left else 1
            digest, said, low, count, children, leaves, saved, ends, waiting = stack.pop()
            for row in waiting:
                out.add(row, CLOSED, part, side)
            entry(side, at, digest, said, low, count, children, leaves, saved, ends)
    yield from out.batches()


def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close the open nodes of all partitions: their rows, and for each partition's stacks the nodes' smallest members.

    Records come by partition; in each the stack of its first array from the
    root down, then what its last array adds, every entry before its chunks.
    """
    stack, out = _Stack(), _Rows()
    at: list[list[tuple[int, int]]] = []  # the partitions and sides that know a node

    def close() -> None:
        resolved, row = stack.close()
        for child in resolved:
            out.add(child, CLOSED)
        for part, side in at.pop():
            out.add((row[0], row[1], *[None] * 6), PARENT, part, side)
        if len(stack):
            stack.waiting[-1].append(row)
        else:
            out.add(row, CLOSED)

    for batch in batches:
        for r in batch.to_pylist():
            depth, side = r["depth"], r["side"]
            if r["kind"] == CHUNK:
                text = r["ends"].encode()
                if stack.ends[depth] is None:
                    stack.ends[depth] = hashlib.sha256(text)
                else:
                    stack.ends[depth].update(b"," + text)
                continue
            if side == 1 or len(stack) <= depth or stack.digest[depth] != r["digest"]:
                while len(stack) > depth:
                    close()
                stack.push(r["digest"], r["chars"])
                at.append([])
            add = (r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
            if r["conv_id"] is not None:
                low = stack.low[depth]
                stack.low[depth] = add[0] if low is None else min(low, add[0])
            for column, value in zip((stack.count, stack.children, stack.leaves, stack.saved), add[1:]):
                column[depth] += value
            if r["ends_sha256"] is not None:
                stack.ends[depth] = r["ends_sha256"]
            at[depth].append((r["part"], side))
        yield from out.batches(4000)
    while len(stack):
        close()
    yield from out.batches()


def prefix_trie(arrays: DataFrame, *, partitions: int | None = None, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row a node of the trie over (conv_id, turns), where turns are structs with digest and chars.

    conv_id is the node's smallest member.  Without `partitions` there are as
    many as the count of turns asks for.
    """
    with scratch(arrays.sparkSession):
        return _nodes(arrays, partitions, chunk_ids)


def conversation_trie(turns: DataFrame, *, block: int | None = None, most: int = 6, partitions: int | None = None) -> DataFrame:
    """The trie of a table of turns; with `block`, of the conversations that `with_shared_heads` makes of them."""
    with scratch(turns.sparkSession):
        arrays = turn_arrays(turns)
        return _nodes(with_shared_heads(staged(arrays, "conversations"), block=block, most=most) if block else arrays, partitions)


def _nodes(arrays: DataFrame, partitions: int | None, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    prepare(arrays.sparkSession)

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return sweep(batches, TaskContext.get().partitionId(), chunk_ids)

    key = F.array_join(F.col("turns.digest"), "").cast("binary")
    keyed = staged(arrays.select("conv_id", key.alias("key"), F.col("turns.chars").alias("chars")), "arrays")
    n = partitions or 1 + (keyed.agg(F.sum(F.size("chars") + 1)).first()[0] or 0) // PARTITION_TURNS
    ordered = keyed.repartitionByRange(int(n), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    records = staged(ordered.mapInArrow(swept, SWEPT), "swept", result=True)
    stacks = records.filter(F.col("kind").isin(OPEN, CHUNK)).repartition(1).sortWithinPartitions("part", "side", "depth", "chunk")
    stitched = staged(stacks.mapInArrow(stitch, SWEPT), "stitched", result=True)
    names = [name for name, _ in _NODE]
    closed, whole = records.filter(F.col("kind") == CLOSED), stitched.filter(F.col("kind") == CLOSED)
    parents = stitched.filter(F.col("kind") == PARENT).select("part", "side", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    few = parents.count() <= BROADCAST_ENTRIES
    below = closed.filter("part is not null").join(F.broadcast(parents) if few else parents, ["part", "side", "depth"]).withColumn("parent_conv_id", F.col("parent"))
    return closed.filter("part is null").select(names).unionByName(below.select(names)).unionByName(whole.select(names))
