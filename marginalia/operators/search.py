"""Federated and local search over index lines, and the registry (PR1-PR3, J18, AG5, AG6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_literal
from ..sources.markdown import index_files
from ..sources.parsers import lines

CAP = 20


def hit_lines(files: DataFrame, query: str, mode: str = "literal") -> DataFrame:
    """PF18: (corpus, rel, folder, line_no, line) of the index files' matching lines."""
    return lines(index_files(files), "corpus", "rel", "folder").filter((F.col("line") != "") & contains_literal("line", query, mode))


def federated(registry: DataFrame, files: DataFrame, query: str, mode: str = "literal") -> DataFrame:
    """PR2: hits of searchable sources; a searchable source without files is one row with the note 'path missing'."""
    sources = registry.filter("searchable").select("name")
    there = files.select("corpus").distinct()
    hits = hit_lines(files, query, mode).join(sources, F.col("corpus") == F.col("name")).select("name", "rel", "line_no", "line", F.lit("").alias("note"))
    lost = sources.join(there, F.col("name") == F.col("corpus"), "left_anti").select("name", F.lit("").alias("rel"), F.lit(0).alias("line_no"), F.lit("").alias("line"), F.lit("path missing").alias("note"))
    return hits.unionByName(lost)


def capped(hits: DataFrame, by: str, *order: str, cap: int = CAP) -> DataFrame:
    """WN12, AG5, AG6: the first `cap` hits of each group with the group's total and what is left out."""
    total = hits.groupBy(by).agg(F.count("*").alias("total"))
    shown = hits.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= cap)
    return shown.join(total, by).withColumn("more", F.greatest(F.col("total") - cap, F.lit(0)))


def totals(hits: DataFrame, by: str) -> DataFrame:
    """Hits in all and groups with hits."""
    return hits.agg(F.count("*").alias("total_hits"), F.count_distinct(by).alias("n_groups"))


def follow_up(hits: DataFrame) -> DataFrame:
    """Labels of a local search: several folders, archive only, memory only."""
    return hits.agg((F.count_distinct("folder") > 1).alias("multi_folder"), F.coalesce(F.bool_and(F.col("rel").endswith("-archive.md")), F.lit(False)).alias("archive_only"), F.coalesce(F.bool_and(F.col("folder") == "memory"), F.lit(False)).alias("memory_only"))


def add_source(registry: DataFrame, name: str, path: str, registered: str) -> DataFrame:
    """PR1: a name without spaces, not yet taken."""
    if not name or any(c.isspace() for c in name):
        raise ValueError(f"a source's name has no spaces: {name!r}")
    if not registry.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"source {name!r} is registered")
    return registry.unionByName(registry.sparkSession.createDataFrame([(name, path, registered, True)], "name string, path string, registered string, searchable boolean"), allowMissingColumns=True)


def _required(registry: DataFrame, name: str) -> None:
    if registry.filter(F.col("name") == name).isEmpty():
        raise ValueError(f"no source {name!r}")


def remove_source(registry: DataFrame, name: str) -> DataFrame:
    _required(registry, name)
    return registry.filter(F.col("name") != name)


def set_searchable(registry: DataFrame, name: str, value: bool) -> DataFrame:
    _required(registry, name)
    return registry.withColumn("searchable", F.when(F.col("name") == name, F.lit(value)).otherwise(F.col("searchable")))


def listing(registry: DataFrame) -> DataFrame:
    return registry.select("name", F.concat(F.when(F.col("searchable"), "✓").otherwise("✗"), F.lit(" "), F.rpad("name", 24, " "), F.lit(" "), "path", F.lit("  (registered "), "registered", F.lit(")")).alias("line"))
