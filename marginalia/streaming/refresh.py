"""Incremental refresh of the facet index from a stream of file versions.

File versions arrive as rows (collection, stem, mtime, content), from Parquet
files or from a tree of files.  The state is the newest version of each file,
in a folder for each batch and collection; a batch reads only the collections
that it touches, from the batch that wrote each of them last, and writes them
and their index anew.  So work grows with the touched collections, not with
all versions ever seen.

Every batch notes which collections it wrote.  Every COMPACT batches the note is
a manifest of all collections instead; the next batch then deletes the notes
before it and the folders that it doesn't name.  So a batch lists as many
folders as there are collections and batches since the manifest, however many
batches there have been.  Batches are idempotent: a repeated one reads what the
batches before it noted, of which nothing is deleted until the batch after it,
and overwrites its own folders.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.facet_index import paginated

SCHEMA = "collection string, stem string, mtime timestamp, content string"


def newest_versions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("collection", "stem").agg(F.max_by("content", "mtime").alias("content"), F.max("mtime").alias("mtime"))


HEADS = "collection string, at int, batch int"
STATE = "stem string, mtime timestamp, content string, batch int, collection string"
#: Batches from one manifest to the next, and touched collections that are sent to all tasks.
COMPACT, BROADCAST = 16, 100_000


def _heads(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(collection, batch): the batch that wrote each collection last."""
    rows = spark.read.schema(HEADS).option("basePath", f"{target}/heads").parquet(f"{target}/heads")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return rows.groupBy("collection").agg(F.max("at").alias("batch"))


def current_index(spark: SparkSession, target: str) -> DataFrame:
    """The index of all collections as of the last batch."""
    index = spark.read.parquet(f"{target}/index").withColumn("collection", F.col("collection").cast("string"))
    return index.join(_heads(spark, target), ["collection", "batch"], "left_semi").drop("batch")


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Subfolders of a folder by name, with Hadoop's file system and path of each."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return {}
    return {s.getPath().getName(): (system, s.getPath()) for s in system.listStatus(hadoop) if s.isDirectory()}


def _cleaned(spark: SparkSession, target: str, number: int, compact: int) -> None:
    """Delete what the last manifest before batch `number` made superfluous, in the batch right after it."""
    manifest = number - 1
    if manifest < 0 or manifest % compact:
        return
    live: dict[int, set[str]] = {}
    for r in _heads(spark, target, number).collect():  # one row a collection
        live.setdefault(r["batch"], set()).add(r["collection"])
    for name, (system, path) in _folders(spark, f"{target}/heads").items():
        if int(name.removeprefix("batch=")) < manifest:
            system.delete(path, True)
    for kind in ("state", "index"):
        for name, (system, path) in _folders(spark, f"{target}/{kind}").items():
            batch = int(name.removeprefix("batch="))
            if batch > manifest:
                continue
            if batch not in live:
                system.delete(path, True)
                continue
            for own, (_, below) in _folders(spark, path.toString()).items():
                if unquote(own.removeprefix("collection=")) not in live[batch]:
                    system.delete(below, True)


def refresh_batch(batch: DataFrame, number: int, target: str, *, compact: int = COMPACT) -> None:
    """Write the collections that a batch touches: state/batch=N/collection=C, index/batch=N/collection=C, and their names to heads/batch=N."""
    spark = batch.sparkSession
    rows = newest_versions(batch).select("collection", "stem", "mtime", "content")
    touched = batch.select("collection").distinct()
    heads = None
    if number and _folders(spark, f"{target}/heads"):
        _cleaned(spark, target, number, compact)
        heads = _heads(spark, target, number)
        last = heads.join(touched, "collection", "left_semi")
        last = F.broadcast(last) if touched.count() <= BROADCAST else last
        state = spark.read.schema(STATE).option("basePath", f"{target}/state").parquet(f"{target}/state")
        # partition columns: only the folders named by the heads are read
        rows = rows.unionByName(state.join(last, ["collection", "batch"], "left_semi").select("collection", "stem", "mtime", "content"))
    newest_versions(rows).write.mode("overwrite").partitionBy("collection").parquet(f"{target}/state/batch={number}")
    merged = spark.read.schema(STATE).option("basePath", f"{target}/state").parquet(f"{target}/state/batch={number}").drop("batch")
    paginated(merged).write.mode("overwrite").partitionBy("collection").parquet(f"{target}/index/batch={number}")
    noted = touched.withColumn("at", F.lit(number))
    if number % compact == 0 and heads is not None:
        noted = noted.unionByName(heads.join(touched, "collection", "left_anti").select("collection", F.col("batch").alias("at")))
    noted.write.mode("overwrite").parquet(f"{target}/heads/batch={number}")


def stream_refresh(spark: SparkSession, source: str | DataFrame, target: str, checkpoint: str, *, compact: int = COMPACT) -> StreamingQuery:
    """Keep the index of `source`, a folder of Parquet files or a stream of (collection, stem, mtime, content)."""
    rows = source if isinstance(source, DataFrame) else spark.readStream.schema(SCHEMA).parquet(source)
    return rows.writeStream.foreachBatch(lambda batch, number: refresh_batch(batch, number, target, compact=compact)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(files: DataFrame) -> DataFrame:
    """A tree's files, as `stream_corpus` gives them, as versions: a collection is a folder."""
    return files.filter(F.col("content").isNotNull()).select(F.col("folder").alias("collection"), "stem", "mtime", "content")


def event_counts(events: DataFrame, *, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per event type and window with a watermark; the same plan on a batch table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
