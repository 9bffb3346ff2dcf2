"""Token identifiers in seekable binary files.

A file holds one zstandard frame for each document (its identifiers as little
endian words of `width` bytes), a skippable frame with the document
identifiers, and at the end the seek table of the public zstd seekable format:
compressed size, decompressed size and the low 32 bits of XXH64 for each
frame.  A reader finds and decompresses only the frames it wants and verifies
each one's checksum.

Documents are written in ascending identifier order (range partitions, sorted
within; nulls first; equal identifiers by text hash).  Each attempt of a task
writes a file of its own name and only the manifest rows of successful
attempts count, so lost executors and retries leave no wrong data.

Defined results: a null or empty text is the end identifier alone; a very long
text is one frame, encoded whole; repeated rows are separate documents; an
empty table gives an empty manifest; only identifier and text are read, so
extra columns cannot clash.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, prepare, release_memory, staged

#: Fixed values of the zstd seekable format and of this file's index frame.
SEEK_FRAME, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_FRAME, INDEX_MAGIC = 0x184D2A50, b"MGTK"
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])
#: Cached words in each of a worker's two cache generations; some 60 MB each.
CACHE_ENTRIES = 300_000
LEVEL = 3

#: The byte-level pre-tokenizer's pattern, over an alphabet in which each class is known exactly.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^ \n0-9{_L}]+|[ \n]+(?![^ \n])|[ \n]+")
_OTHER = re.compile(rf"[^ -~\n{_L}]")
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256 and up in order.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ID = attrgetter("id")
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SELF)}


class _Generations(dict):
    """Words' encodings; what was not asked for in a whole generation is forgotten."""

    def __init__(self, model, kind: str, older: dict[str, bytes]) -> None:
        self.tokenize, self.code, self.older = model.tokenize, "H" if kind == "<u2" else "I", older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word.isascii():
                mapped = word.replace(" ", "\u0120").replace("\n", "\u010a")
            else:
                mapped = word.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = array(self.code, map(_ID, self.tokenize(mapped))).tobytes()
        self[word] = found
        return found


class WordEncoder:
    """Encodes texts word by word with a bounded cache; equal to encoding them whole.

    Texts with characters outside the known alphabet or with a special token's
    string, and all texts of tokenizers that split otherwise, are encoded whole.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made["normalizer"] and not made["truncation"] and not made["padding"]
        self.special = [t["content"] for t in made["added_tokens"]]
        self.cache = _Generations(self.tokenizer.model, self.kind, {})

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bool:
        return not self.by_word or bool(_OTHER.search(text)) or any(t in text for t in self.special)

    def encode(self, text: str) -> bytes:
        if self._whole(text):
            return self._ids([text])[0]
        if len(self.cache) > CACHE_ENTRIES:
            older = dict(self.cache)
            self.cache = _Generations(self.tokenizer.model, self.kind, older)
        return b"".join(map(self.cache.__getitem__, _WORD.findall(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> WordEncoder:
    return WordEncoder(path, special_as_text)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


class FrameWriter:
    def __init__(self, path: str, width: int) -> None:
        self.system, self.path = opened(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.system.open_output_stream(self.path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.width, self.entries, self.ids = width, [], []

    def add(self, doc_id: int | None, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], dtype="u1").tobytes()
        index = INDEX_MAGIC + struct.pack("<BQ", self.width, len(self.ids)) + known + np.array([i or 0 for i in self.ids], dtype="<i8").tobytes()
        table = np.array(self.entries, dtype=ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), CHECKSUM_FLAG, SEEK_MAGIC)
        for magic, body in ((INDEX_FRAME, index), (SEEK_FRAME, table)):
            self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.out.close()


class FrameReader:
    """Random access to one file; only the frames asked for are decompressed."""

    def __init__(self, path: str) -> None:
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        end = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path}: no seek table")
        table = end - 9 - ENTRY.itemsize * count
        self.entries = np.frombuffer(self.file.read_at(ENTRY.itemsize * count, table), dtype=ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        at = int(self.starts[-1])
        frame, size = struct.unpack("<II", self.file.read_at(8, at))
        body = self.file.read_at(size, at + 8)
        if frame != INDEX_FRAME or body[:4] != INDEX_MAGIC:
            raise ValueError(f"{path}: no index")
        self.width, n = struct.unpack("<BQ", body[4:13])
        known, ids = np.frombuffer(body[13 : 13 + n], dtype="u1"), np.frombuffer(body[13 + n :], dtype="<i8")
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids)]
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        entry = self.entries[k]
        plain = self.unpacker.decompress(self.file.read_at(int(entry["packed"]), int(self.starts[k])), max_output_size=int(entry["plain"]) or 1)
        if len(plain) != entry["plain"] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != entry["sum"]:
            raise ValueError(f"frame {k}: checksum differs")
        return np.frombuffer(plain, dtype=f"<u{self.width}")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        wanted = None if wanted is None else set(wanted)
        for k, doc_id in enumerate(self.doc_ids):
            if wanted is None or doc_id in wanted:
                yield doc_id, self.frame(k)


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, *, end_id: int = 0, special_as_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns the manifest (part, file, documents, tokens, start), one row a file."""
    spark = prepare(docs.sparkSession)
    path = path or new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, tokens, part = None, 0, TaskContext.get().partitionId()
        coder = encoder(tokenizer, special_as_text)
        end = np.array([end_id], dtype=coder.kind).tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.mgtk"
                writer = FrameWriter(name, coder.width)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain = coder.encode(text or "")
                writer.add(doc_id, plain + end)
                tokens += len(plain) // coder.width + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((part, name, len(writer.ids), tokens), _MANIFEST.types)], schema=_MANIFEST)
        release_memory()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    manifest = staged(ordered.mapInArrow(write, "part int, file string, documents long, tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def map_files(manifest: DataFrame, each, schema: str) -> DataFrame:
    """Open every file of the manifest in a task; `each(reader, start)` yields tuples of the schema's fields."""
    spark = manifest.sparkSession
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for out in each(FrameReader(row["file"]), row["start"]):
                    rows.append(out)
                    if len(rows) == 4000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(empty)
    return manifest.select("file", "start").repartition(files).mapInArrow(read, schema)
