"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded
hash (one exchange that moves each record once).  Pass 2 gives every bucket a
Fisher-Yates permutation of its records and lays the shuffled buckets end to
end; the stream is cut into shards of equal row counts and written.

Law: `rows`: the row counts of any two shards differ by at most one.

Defined results: a null text has size 1; null identifiers are scattered by
their texts; repeated rows (equal identifier and text) share a bucket and each
get a slot of their own; ties within a bucket are ordered by a hash of the
record; a very long text is one record of its bucket and is never cut; an
empty table gives an empty table.  The whole input record travels as one struct, so extra
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, prepare, staged

#: Upper bound of the number of buckets, and with it of the broadcast bucket table (24 bytes a row): enough for 256 TB in buckets of 64 MB.
MAX_BUCKETS = 1 << 22


def two_pass_shuffle(docs: DataFrame, *, shards: int = 16, seed: int = 20240229, bucket_bytes: int = 64 << 20, min_buckets: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (record struct, size, shard, slot); slots run from 0 without gaps in each shard."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), docs[id_col].alias("_id"), docs[text_col].alias("_text"), (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1).cast("long").alias("size"))
    cell = F.pmod(F.xxhash64(F.lit(seed), "_id", "_text"), F.lit(MAX_BUCKETS))
    cells = staged(rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "shard-cells")
    rows_all, bytes_all = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = min_buckets
    while buckets < MAX_BUCKETS and buckets * bucket_bytes < bytes_all:
        buckets *= 2
    # one row a bucket: its rows and the rows of all buckets before it, in two levels
    sums = cells.groupBy(F.pmod("cell", F.lit(buckets)).alias("bucket")).agg(F.sum("n").alias("n")).withColumn("block", F.expr("bucket div 1024"))
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("block").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = sums.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(blocks), "block").select("bucket", "n", (F.col("before") + F.col("inner")).alias("offset"))
    # range partitions are the same at every run, so the seeded Fisher-Yates of shuffle() is too
    orders = spark.range(0, buckets, 1, max(64, buckets >> 12)).withColumnRenamed("id", "bucket").join(F.broadcast(placed), "bucket").select("bucket", "offset", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("order"))
    scattered = rows.withColumn("bucket", F.pmod(cell, F.lit(buckets)))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("_id", "size", F.xxhash64("record"))) - 1
    position = F.col("offset") + F.col("order")[F.col("at")]
    n, k = F.lit(max(rows_all, 1)), F.lit(shards)
    return (
        scattered.withColumn("at", at).join(orders, "bucket").select("record", "size", position.cast("long").alias("position"))
        .withColumn("shard", F.floor(F.col("position") * k / n).cast("int"))
        .withColumn("shard", F.when(F.col("position") * k < F.col("shard") * n, F.col("shard") - 1).when(F.col("position") * k >= (F.col("shard") + 1) * n, F.col("shard") + 1).otherwise(F.col("shard")))
        .select("record", "size", "shard", (F.col("position") - F.expr(f"(shard * {max(rows_all, 1)}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"))
    )


def write_shards(shuffled: DataFrame, path: str | None = None) -> DataFrame:
    """Write the shards as Parquet folders shard=0.., each file in slot order, and read them back."""
    spark = shuffled.sparkSession
    path = path or new_path(spark, "shards")
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
