"""What the training-data operators share: session preparation, staged tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; with 3 KB texts 1.5 MB; long texts end a batch at BATCH_BYTES.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


#: Python workers give large freed arrays back to the system at once.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, unless the caller's are smaller, and let Python workers import this package."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not (now and now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a new local one where none is set and all run on this machine."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="marginalia-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders staged in each open scope, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside, but for tables staged with `result=True`, which belong to the scope around."""
    scopes = _SCOPES.get()
    own: list[str] = []
    token = _SCOPES.set((*scopes, own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            dropped(spark, path)


def staged(df: DataFrame, name: str, *, result: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it again: work is done once and lineage is cut."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df, name, result=result))


def staged_path(df: DataFrame, name: str, *by: str, result: bool = False) -> str:
    """As `staged`, in a folder for each value of `by`; the folder of them all."""
    path = new_path(df.sparkSession, name)
    scopes = _SCOPES.get()[: -1 if result else None]
    if scopes:
        scopes[-1].append(path)
    df.write.partitionBy(*by).parquet(path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    """Number of runs of characters outside space and 0x09-0x0D (null: 0)."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.when(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.length(marks)).otherwise(0).cast("long")


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task, for the next operator in the same worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def rows_out(schema: pa.Schema, columns: list, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows from equally long column lists."""
    n = len(columns[0])
    for at in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + rows], type=t) for c, t in zip(columns, schema.types)], schema=schema)
