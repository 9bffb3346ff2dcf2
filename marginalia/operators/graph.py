"""The typed property graph from front matter (J1, AG1-AG4, SK1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import links
from ..sources.markdown import markdown
from ..sources.parsers import front_matter_fields
from .ordering import numbered


def nodes(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """D3: (stem, rel, type, status, date); any front matter key makes a node, type defaults to other."""
    md = markdown(files, skip)
    rows = front_matter_fields(md).join(md.select("rel", "stem"), "rel")
    value = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    return rows.groupBy("stem", "rel").agg(F.coalesce(value("type"), F.lit("other")).alias("type"), F.coalesce(value("status"), F.lit("")).alias("status"), F.coalesce(value("date"), F.lit("")).alias("date"))


def edges(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(source, rel, type, ordinal, target)."""
    md = markdown(files, skip)
    rows = front_matter_fields(md).filter(F.col("key").isin(*P.EDGE_KEYS)).join(md.select("rel", "stem"), "rel")
    return rows.select(F.col("stem").alias("source"), "rel", F.col("key").alias("type"), F.posexplode(links("value")).alias("ordinal", "target"))


def dangling(edge_rows: DataFrame, files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose lower-cased target is no stem; paths, .md and # parts are not resolved here."""
    stems = markdown(files, skip).select("stem_lc").distinct()
    return edge_rows.join(stems, F.lower("target") == F.col("stem_lc"), "left_anti")


def edge_counts(edge_rows: DataFrame) -> DataFrame:
    """AG1"""
    return edge_rows.groupBy("type").agg(F.count("*").alias("n"))


def stems_by(node_rows: DataFrame, key: str) -> DataFrame:
    """AG2: (key, stems sorted), without empty keys."""
    return node_rows.filter(F.col(key) != "").groupBy(key).agg(F.array_sort(F.collect_list("stem")).alias("stems"))


def edges_by_source(edge_rows: DataFrame) -> DataFrame:
    """AG4: by stem, so files of one stem are merged."""
    return edge_rows.groupBy("source").agg(F.array_sort(F.collect_list(F.concat_ws(" -> ", "type", "target"))).alias("edges"))


def stats(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """AG3"""
    e = edges(files, skip)
    return markdown(files, skip).agg(F.count("*").alias("total_files")).crossJoin(nodes(files, skip).agg(F.count("*").alias("files_with_front_matter"))).crossJoin(e.agg(F.count("*").alias("total_edges"))).crossJoin(dangling(e, files, skip).agg(F.count("*").alias("dangling")))


def degree(edge_rows: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every stem that an edge touches, lower-cased."""
    ends = edge_rows.select(F.lower("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edge_rows.select(F.lower("target"), F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def report(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """SK1: the graph report as (ordinal, line): counts, files by type and status, edges by source, dangling edges."""
    n, e = nodes(files, skip), edges(files, skip)
    linked = lambda stems: F.array_join(F.transform(stems, lambda s: F.concat(F.lit("[["), s, F.lit("]]"))), ", ")
    s = stats(files, skip).select(F.lit(1).alias("part"), F.lit("").alias("k"), F.lit(0).cast("long").alias("i"), F.format_string("Stats: %d files with front matter out of %d markdown files. %d typed edges.", "files_with_front_matter", "total_files", "total_edges").alias("line"))
    parts = [
        edge_counts(e).select(F.lit(2), F.lit(""), -F.col("n"), F.format_string("| `%s` | %d |", "type", "n")),
        stems_by(n, "type").select(F.lit(3), "type", F.lit(0).cast("long"), F.concat(F.lit("### "), "type", F.lit(": "), linked(F.col("stems")))),
        stems_by(n, "status").select(F.lit(4), "status", F.lit(0).cast("long"), F.concat(F.lit("### "), "status", F.lit(": "), linked(F.col("stems")))),
        e.select(F.lit(5), "source", F.col("ordinal").cast("long"), F.concat(F.lit("- [["), "source", F.lit("]] `"), "type", F.lit("` → [["), "target", F.lit("]]"))),
        dangling(e, files, skip).select(F.lit(6), "source", F.col("ordinal").cast("long"), F.concat(F.lit("- [["), "source", F.lit("]] `"), "type", F.lit("` → [["), "target", F.lit("]] (missing)"))),
    ]
    for part in parts:
        s = s.union(part)
    return numbered(s, "part", "k", "i", "line").select("ordinal", "line")


def graph_file(files: DataFrame, skip: tuple[str, ...] = (), rel: str = "memory/.graph.md") -> DataFrame:
    """SK2: the report as one file row (rel, content) for the text writer; the report itself is never an input."""
    rows = report(files.filter(F.col("rel") != rel), skip)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n")
    return rows.agg(text.alias("content")).select(F.lit(rel).alias("rel"), "content")


def check_status(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """SK2: the check mode: exit status 1 with dangling edges."""
    return dangling(edges(files, skip), files, skip).agg(F.count("*").alias("dangling")).withColumn("exit_status", F.when(F.col("dangling") > 0, 1).otherwise(0))
