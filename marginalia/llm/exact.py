"""Exact deduplication by Patricia-trie owners.

Texts are compared whole.  Every partition first collapses its equal texts in
a trie of bounded size, so a group of copies crosses the exchange once for a
partition and not once for a copy; texts with many copies are dealt over
several shares, whose owners are combined at the end.  The exchange goes by
length and content hash; each partition inserts the full byte strings into a
compressed radix trie whose terminal nodes keep the smallest identifier and
the row count.  A trie over
its memory budget spills its heaviest subtree to task-local scratch files and
works through them afterwards.  Owners are joined to the thin rows of all
documents; a hot group is split there by the adaptive skew join.

Equality: each run of space and 0x09-0x0D counts as one space, a null text as
the empty one.  Null identifiers are larger than all others; a group of only
null identifiers has a null owner and its rows count as kept.  Repeated rows
count one by one.  An empty table gives an empty table.  Only the identifier and text columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, prepare, staged, text_bytes

#: Bytes of labels and nodes that a merging trie holds before it spills a subtree, and a collapsing one before it is handed on.
TRIE_BYTES = 48 << 20
#: A text with so many copies in one partition is dealt over so many shares.
HOT, SALTS = 16, 64
NODE_BYTES = 250
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: bytes) -> bytes:
    """Runs of white space become one space; bytes.split() knows exactly these six."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in _BLANK else b"") + b" ".join(words) + (b" " if text[-1] in _BLANK else b"")


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class _Node:
    __slots__ = ("children", "owner", "spill", "weight")

    def __init__(self) -> None:
        self.children: dict[int, tuple[bytes, _Node]] = {}
        self.owner: list | None = None  # [smallest identifier, rows, tag]
        self.spill = None
        self.weight = 0  # bytes in this node and below


class PatriciaTrie:
    """Compressed radix trie over byte strings; terminals own [smallest id, rows, tag]."""

    def __init__(self, budget: int | None = None) -> None:
        self.root, self.budget = _Node(), budget

    def insert(self, key: bytes, doc_id: int | None, rows: int, tag) -> None:
        node, path, rest, added = self.root, [self.root], key, 0
        while True:
            if node.spill is not None:
                pickle.dump((rest, doc_id, rows, tag), node.spill, pickle.HIGHEST_PROTOCOL)
                return
            if not rest:
                if node.owner is None:
                    node.owner = [doc_id, rows, tag]
                    added += NODE_BYTES
                else:
                    node.owner[0] = smaller(node.owner[0], doc_id)
                    node.owner[1] += rows
                break
            edge = node.children.get(rest[0])
            if edge is None:
                leaf = _Node()
                leaf.owner = [doc_id, rows, tag]
                node.children[rest[0]] = (rest, leaf)
                leaf.weight = NODE_BYTES
                added += len(rest) + 2 * NODE_BYTES
                break
            label, child = edge
            if not rest.startswith(label):
                k = shared_prefix(label, rest)
                middle = _Node()
                middle.children[label[k]] = (label[k:], child)
                middle.weight = child.weight + len(label) - k + NODE_BYTES
                node.children[rest[0]] = (label[:k], middle)
                added += NODE_BYTES
                label, child = label[:k], middle
            node, rest = child, rest[len(label) :]
            path.append(node)
        for n in path:
            n.weight += added
        if self.budget and self.root.weight > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Write the heaviest subtree below the first branching to a scratch file."""
        path, node = [self.root], self.root
        while len(node.children) == 1 and node.owner is None:
            child = next(iter(node.children.values()))[1]
            if child.spill is not None or not child.children:
                break
            node = child
            path.append(node)
        held = [(label, child) for label, child in node.children.values() if child.spill is None]
        if not held:
            return
        label, child = max(held, key=lambda x: x[1].weight + len(x[0]))
        out = tempfile.TemporaryFile()
        for record in _records(child):
            pickle.dump(record, out, pickle.HIGHEST_PROTOCOL)
        gone = child.weight
        child.children, child.owner, child.spill, child.weight = {}, None, out, 0
        for n in path:
            n.weight -= gone

    def owners(self) -> Iterator[list]:
        """All terminals' owners; spilled subtrees come after, one at a time."""
        stack, spilled = [self.root], []
        while stack:
            node = stack.pop()
            if node.spill is not None:
                spilled.append(node.spill)
            if node.owner is not None:
                yield node.owner
            stack.extend(child for _, child in node.children.values())
        self.root = _Node()
        for file in spilled:
            below = PatriciaTrie(self.budget)
            for record in _spilled(file):
                below.insert(*record)
            yield from below.owners()


def _spilled(file) -> Iterator[tuple]:
    """The records of a scratch file, which is gone afterwards."""
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            file.close()
            return


def _records(node: _Node) -> Iterator[tuple]:
    """(suffix, id, rows, tag) of a subtree, with what it has spilled before."""
    stack = [(b"", node)]
    while stack:
        prefix, n = stack.pop()
        if n.owner is not None:
            yield (prefix, *n.owner)
        if n.spill is not None:
            for suffix, *rest in _spilled(n.spill):
                yield (prefix + suffix, *rest)
        stack.extend((prefix + label, child) for label, child in n.children.values())


_LOCAL = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("salt", pa.int32()), ("text", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
_THIN = pa.schema([("id", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())])
_OWNER = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _arrays(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, schema.types)], schema=schema)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different texts of a partition, or of as much of it as a trie may hold."""
    from pyspark import TaskContext

    salt = 1 + TaskContext.get().partitionId() % SALTS
    trie = PatriciaTrie()

    def emptied() -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, doc_id, n, digest in _records(trie.root):
            rows.append((len(text), digest, 0 if n < HOT else salt, text, doc_id, n))
            size += len(text)
            if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                yield _arrays(_LOCAL, list(zip(*rows)))
                rows, size = [], 0
        if rows:
            yield _arrays(_LOCAL, list(zip(*rows)))

    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), text_bytes(batch, "text")):
            text = normalised(text)
            trie.insert(text, doc_id, 1, hashlib.sha256(text).digest())
        if trie.root.weight > TRIE_BYTES:
            yield from emptied()
            trie = PatriciaTrie()
    yield from emptied()


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalised(t) for t in text_bytes(batch, "text")]
        yield _arrays(_THIN, [batch.column("id").to_pylist(), [len(t) for t in texts], [hashlib.sha256(t).digest() for t in texts]])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(TRIE_BYTES)
    for batch in batches:
        for digest, text, doc_id, n in zip(*[batch.column(k).to_pylist() for k in ("digest", "text", "id", "n")]):
            trie.insert(text, doc_id, n, (len(text), digest))
    rows: list[tuple] = []
    for doc_id, n, (length, digest) in trie.owners():
        rows.append((length, digest, doc_id, n))
        if len(rows) == 4000:
            yield _arrays(_OWNER, list(zip(*rows)))
            rows = []
    if rows:
        yield _arrays(_OWNER, list(zip(*rows)))


def trie_owners(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, digest, keep_id, n): one row for each different text."""
    prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    local = rows.mapInArrow(_collapse, "length long, digest binary, salt int, text binary, id long, n long")
    merged = local.repartition("length", "digest", "salt").drop("salt").mapInArrow(_merge, "length long, digest binary, keep_id long, n long")
    # the owners of a hot text's shares, one for each salt; written, as the join with all rows is split by skew only where it reads plain exchanges
    return staged(merged.groupBy("length", "digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), "owners")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its owner: (id, length, digest, keep_id, n)."""
    owners = trie_owners(docs, id_col=id_col, text_col=text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_thin, "id long, length long, digest binary").join(owners, ["length", "digest"])
