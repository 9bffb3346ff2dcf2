"""A data source for trees of text files (SC1-SC3, SC6, SC13, SK6, SK10): batch, stream and writer.

Spark's file sources leave out names that start with _ or . without a word;
here hidden folders are pruned, hidden files are read.  Any store that Arrow's
file systems open by URI will do, or a local path.

Reading: the driver lists the first folders only, breadth first; folders below
are listed by the tasks that read them.  An unreadable file has null content
and still counts; a task that doesn't see the tree at all fails.

Streaming: an offset is a time; a batch has the files whose modification time
is after its start and not after its end, so a repeated batch has the same
files as long as nobody writes them again, and what is written again is in a
later batch.  The end stays `settle` seconds behind the clock, as stores round
times and writers need a moment.

Writing: tasks write under a hidden folder, an attempt under a folder of its
own, and note what they wrote beside it.  Only when all tasks are done are the
files of the attempts that count moved to their places, catalog files last; a
task that is killed or repeated leaves nothing, a job that fails likewise.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import patterns as P
from ..functions.text import base_name, folder, skipped, stem

SCHEMA = "corpus string, rel string, content string, mtime timestamp"
#: Files read by one task, and folders that the driver lists before tasks take over.
BATCH, LISTED = 256, 200
#: Characters of files that a reading task passes on at once; a longer file goes alone.
READ_CHARS = 8 << 20
#: Folders of unfinished writes, hidden from readers, and threads that move finished files.
WRITING, MOVERS = ".writing-", 32


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class _Part(InputPartition):
    """Files, and folders to list with all that is below them; of these what was modified in (after, until]."""

    rels: list[str]
    folders: list[str]
    after: float | None = None
    until: float | None = None


class _Tree:
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.corpus = options.get("corpus", self.path.rsplit("/", 1)[-1])
        self.suffix = options.get("suffix", "")
        self.prefixes = tuple(p if p.endswith("/") else p + "/" for p in options.get("skip", "").split(",") if p)
        self.listed = int(options.get("listed", LISTED))
        self.settle = float(options.get("settle", 2))

    def listing(self, system: fs.FileSystem, root: str, rel: str) -> tuple[list[str], list[str]]:
        """(files, folders) directly in a folder, in order."""
        files, folders = [], []
        for info in system.get_file_info(fs.FileSelector(f"{root}/{rel}" if rel else root, allow_not_found=True)):
            own = f"{rel}/{info.base_name}" if rel else info.base_name
            if info.type == fs.FileType.Directory:
                if not info.base_name.startswith(".") and not (self.prefixes and f"{own}/".startswith(self.prefixes)):
                    folders.append(own)
            elif info.base_name.endswith(self.suffix) and not (self.prefixes and own.startswith(self.prefixes)):
                files.append(own)
        return sorted(files), sorted(folders)

    def parts(self, after: float | None = None, until: float | None = None) -> list[_Part]:
        system, root = opened(self.path)
        rels, folders, listed = [], [""], 0
        while folders and listed < self.listed:
            files, below = self.listing(system, root, folders.pop(0))
            rels += files
            folders += below
            listed += 1
        rels.sort()
        return [_Part(rels[at : at + BATCH], [], after, until) for at in range(0, len(rels), BATCH)] + [_Part([], [f], after, until) for f in folders] or [_Part([], [])]

    def found(self, system: fs.FileSystem, root: str, part: _Part) -> Iterator[str]:
        yield from part.rels
        folders = list(part.folders)
        while folders:
            files, below = self.listing(system, root, folders.pop())
            folders += reversed(below)
            yield from files

    def rows(self, part: _Part) -> Iterator[tuple]:
        system, root = opened(self.path)
        if (part.rels or part.folders) and system.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"{self.path}: not visible to this task")
        found = self.found(system, root, part)
        while some := list(islice(found, BATCH)):
            for rel, info in zip(some, system.get_file_info([f"{root}/{rel}" for rel in some])):
                at = info.mtime.timestamp() if info.mtime else 0.0
                if (part.after is not None and at <= part.after) or (part.until is not None and at > part.until):
                    continue
                try:
                    with system.open_input_stream(info.path, compression=None) as file:
                        content = file.read().decode().replace("\r\n", "\n").replace("\r", "\n")
                except (OSError, UnicodeDecodeError):
                    content = None
                yield self.corpus, rel, content, info.mtime


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in batches by their size; Spark's own go by number and could hold a whole part."""
    names, kinds = ("corpus", "rel", "content", "mtime"), (pa.string(), pa.string(), pa.string(), pa.timestamp("us", tz="UTC"))
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), kinds)], names=list(names))

    for row in rows:
        own = len(row[2] or "")
        if held and size + own > READ_CHARS:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.tree = _Tree(options)

    def partitions(self) -> list[InputPartition]:
        return self.tree.parts()

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return _batched(self.tree.rows(partition))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.tree = _Tree(options)

    def initialOffset(self) -> dict:
        return {"mtime": 0.0}

    def latestOffset(self) -> dict:
        return {"mtime": round(time.time() - self.tree.settle, 6)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.tree.parts(start["mtime"], end["mtime"])

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        return _batched(self.tree.rows(partition))


@dataclass
class _Written(WriterCommitMessage):
    """An attempt's folder; its notes are in the file beside it."""

    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool, names: list[str]) -> None:
        if "rel" not in names or "content" not in names:
            raise ValueError("a tree is written from the columns rel and content")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.last = options.get("last", "_MANIFEST.md")
        self.between = options.get("between")
        self.job = WRITING + uuid.uuid4().hex
        system, root = opened(self.path)
        system.create_dir(f"{root}/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> _Written:
        system, root = opened(self.path)
        own = f"{root}/{self.job}/{uuid.uuid4().hex}"
        # folders are made one by one, so a task that outlives its job finds none to write to
        system.create_dir(own, recursive=False)
        made, n, last, out = {own}, 0, None, None
        with system.open_output_stream(f"{own}.notes", compression=None) as notes:
            for row in iterator:
                rel, content = row["rel"], row["content"]
                if content is None:
                    continue
                if rel == last and self.between is not None:
                    out.write((self.between + content).encode())
                    continue
                if not rel or any(p in ("", ".", "..") for p in rel.split("/")):
                    raise ValueError(f"{rel!r} is no path inside a tree")
                if out is not None:
                    out.close()
                for at in range(len(own) + 1, len(own) + 2 + rel.rfind("/")):
                    where = f"{own}/{rel}"[:at]
                    if f"{own}/{rel}"[at] == "/" and where not in made:
                        system.create_dir(where, recursive=False)
                        made.add(where)
                last, out = rel, system.open_output_stream(f"{own}/{rel}", compression=None)
                out.write(content.encode())
                notes.write(json.dumps(rel).encode() + b"\n")
                n += 1
            if out is not None:
                out.close()
        return _Written(own, n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = opened(self.path)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root)):
                if info.base_name != self.job:
                    system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
        made: set[str] = set()

        def move(place: tuple[str, str]) -> None:
            own, rel = place
            target = f"{root}/{rel}"
            if os.path.dirname(target) not in made:
                system.create_dir(os.path.dirname(target), recursive=True)
                made.add(os.path.dirname(target))
            try:
                system.move(f"{own}/{rel}", target)
            except OSError:  # some stores don't move over a file that exists
                system.delete_file(target)
                system.move(f"{own}/{rel}", target)

        def places(last: bool) -> Iterator[tuple[str, str]]:
            for message in messages:
                if message is not None:
                    with system.open_input_stream(f"{message.folder}.notes", compression=None) as file:
                        for line in file.read().splitlines():
                            rel = json.loads(line)
                            if rel.endswith(self.last) == last:
                                yield message.folder, rel

        with ThreadPoolExecutor(MOVERS) as pool:
            for last in (False, True):
                todo = places(last)
                while some := list(islice(todo, 10_000)):
                    list(pool.map(move, some))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Remove what isn't in its place."""
        system, root = opened(self.path)
        for _ in range(20):  # tasks that are being stopped may still put a file there
            if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.Directory:
                return
            with contextlib.suppress(OSError):
                system.delete_dir(f"{root}/{self.job}")


class CorpusSource(DataSource):
    """format("corpus"): options path, corpus, suffix, skip (comma-separated prefixes), listed, settle (seconds), last (name written last), between.

    With `between`, rows of one path that follow each other in a partition are
    pieces of one file, with that text between them; so a file may be longer
    than a row can be.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite, schema.names)


def _options(path: str, corpus: str | None, suffix: str, skip: tuple[str, ...]) -> dict[str, str]:
    return {"path": path, "suffix": suffix, "skip": ",".join(skip)} | ({"corpus": corpus} if corpus else {})


def read_corpus(spark: SparkSession, path: str, *, corpus: str | None = None, suffix: str = "", skip: tuple[str, ...] = (), listed: int = LISTED) -> DataFrame:
    """All files of a tree, with derived name columns."""
    spark.dataSource.register(CorpusSource)
    return with_names(spark.read.format("corpus").options(**_options(path, corpus, suffix, skip), listed=listed).load())


def stream_corpus(spark: SparkSession, path: str, *, corpus: str | None = None, suffix: str = "", skip: tuple[str, ...] = (), settle: float = 2) -> DataFrame:
    """A stream of a tree's files as they are written and changed, with derived name columns."""
    spark.dataSource.register(CorpusSource)
    return with_names(spark.readStream.format("corpus").options(**_options(path, corpus, suffix, skip), settle=settle).load())


def with_names(files: DataFrame) -> DataFrame:
    """folder, base, stem, stem_lc and ext from rel."""
    files = files.withColumn("base", base_name("rel")).withColumn("folder", folder("rel"))
    return files.withColumn("stem", stem("base")).withColumn("stem_lc", F.lower(stem("base"))).withColumn("ext", F.regexp_extract("base", r"(?<=.)(\.[^.]*)$", 1))


def markdown(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """SC2: case-sensitive .md, without the skipped prefixes."""
    return files.filter(F.col("rel").endswith(".md") & ~skipped("rel", skip))


def index_files(files: DataFrame) -> DataFrame:
    """SC6: the root catalog and every facet index with its archive."""
    return files.filter((F.col("rel") == P.CATALOG_FILE) | F.col("base").isin(*P.INDEX_FILES))
