"""Writers (SK2-SK7, SK11): whole-file text, caches, results, run logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

from .markdown import CorpusSource


def write_texts(files: DataFrame, root: str, *, overwrite: bool = False) -> None:
    """Text files of (rel, content) under `root`, a local path or a URI, by the tasks that hold them; catalog files come last.

    Files keep their places until all new ones are written; null contents are
    left out.  A path given twice is refused, as either text might win.
    """
    twice = files.filter("content is not null").groupBy("rel").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{twice['rel']!r} is given {twice['count']} times")
    files.sparkSession.dataSource.register(CorpusSource)
    files.select("rel", "content").write.format("corpus").mode("overwrite" if overwrite else "append").save(root)


def write_pieces(pieces: DataFrame, root: str, *order: str, between: str = "\n", overwrite: bool = False) -> None:
    """Text files of (rel, content, order...): the pieces of a file in order, with `between` between them.

    A file is one stream, so one task writes it, a piece at a time; neither its
    size nor the number of its pieces is held anywhere.
    """
    pieces.sparkSession.dataSource.register(CorpusSource)
    rows = pieces.select("rel", "content", *order).repartition("rel").sortWithinPartitions("rel", *order)
    rows.select("rel", "content").write.format("corpus").option("between", between).mode("overwrite" if overwrite else "append").save(root)


def registry_pieces(registry: DataFrame, rel: str = "sources.md") -> DataFrame:
    """SK3: the whole registry as pieces of one file, to be parted by empty lines."""
    head = registry.sparkSession.createDataFrame([(rel, "", "# Sources")], "rel string, name string, content string")
    block = F.concat_ws("\n", F.concat(F.lit("## "), "name"), F.concat(F.lit("- path: "), "path"), F.concat(F.lit("- registered: "), "registered"), F.concat(F.lit("- searchable: "), F.col("searchable").cast("string")))
    return head.unionByName(registry.select(F.lit(rel).alias("rel"), "name", block.alias("content")))


def registry_text(registry: DataFrame) -> DataFrame:
    """SK3: the whole registry as one text."""
    block = F.concat_ws("\n", F.concat(F.lit("## "), "name"), F.concat(F.lit("- path: "), "path"), F.concat(F.lit("- registered: "), "registered"), F.concat(F.lit("- searchable: "), F.col("searchable").cast("string")))
    return registry.agg(F.concat(F.lit("# Sources\n\n"), F.array_join(F.array_sort(F.collect_list(block)), "\n\n"), F.lit("\n")).alias("content"))


def write_results(rows: DataFrame, path: str) -> None:
    """SK4: results of all strategies, a folder for each."""
    rows.write.mode("overwrite").partitionBy("strategy").parquet(path)


def write_cache(rows: DataFrame, path: str) -> None:
    """SK5, SK6: atomic append of new cache rows; a failed job leaves none."""
    rows.write.mode("append").parquet(path)


def fill_cache(work: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], *, every: int = 100_000, key: str = "session_id") -> int:
    """SK5, ST7: extract what the cache lacks, in steps of some `every` keys that are kept one by one; the number of steps.

    `extract` makes (session_id, text) of a part of `work`.  A run that breaks
    off has lost its last step only: the next one begins with what is missing.
    Parts are by a hash of the key, so all rows of a key are in one.
    """
    spark = work.sparkSession
    try:
        there = spark.read.parquet(path).select("session_id")
    except AnalysisException:
        there = None
    missing = work if there is None else work.join(there.select(F.col("session_id").alias(key)).distinct(), key, "left_anti")
    # the keys are settled, as the cache that they are compared with grows on the way
    keys = settled(missing.select(key).distinct())
    steps = -(-keys.count() // every)
    for step in range(steps):
        own = keys.filter(F.pmod(F.xxhash64(key), F.lit(steps)) == step)
        write_cache(extract(work.join(own, key, "left_semi")), path)
    return steps


def run_line(ts: Column, counters: Column, status: Column) -> Column:
    """SK7: time, counters in key order, status."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(counters)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("  "), pairs, F.lit("  status="), status)


def summary_line(strategy: Column, *values: Column) -> Column:
    """SK11: a markdown table row; shares as percent with one decimal."""
    return F.concat(F.lit("| "), strategy, *[F.concat(F.lit(" | "), F.format_string("%.1f%%", v * 100)) for v in values], F.lit(" |"))
