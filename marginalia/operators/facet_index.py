"""The paginated facet index: windows, fallback, refresh (WN5, WN6, J21, J24, PF24, AG25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

PRIMARY, RECENT = 30, 5


def paginated(entries: DataFrame, *, collection: str = "collection", stem: str = "stem", mtime: str = "mtime", primary: int = PRIMARY, recent: int = RECENT) -> DataFrame:
    """WN5, WN6: place by time, newest first; the first `primary` are the index, the rest its archive, of which `recent` were demoted last."""
    place = F.row_number().over(Window.partitionBy(collection).orderBy(F.desc(mtime), stem))
    return entries.withColumn("place", place).withColumn("is_archive", F.col("place") > primary).withColumn("recently_archived", (F.col("place") > primary) & (F.col("place") <= primary + recent))


def first_page(entries: DataFrame, *, collection: str = "collection", stem: str = "stem", mtime: str = "mtime", primary: int = PRIMARY) -> DataFrame:
    """The index alone; the limit is planned as a window group limit before the shuffle."""
    place = F.row_number().over(Window.partitionBy(collection).orderBy(F.desc(mtime), stem))
    return entries.withColumn("place", place).filter(F.col("place") <= primary)


def with_fallback(primary_hits: DataFrame, archive_hits: DataFrame, collection: str = "collection") -> DataFrame:
    """Archive hits count only for collections without a primary hit."""
    return primary_hits.withColumn("from_archive", F.lit(False)).unionByName(archive_hits.join(primary_hits.select(collection).distinct(), collection, "left_anti").withColumn("from_archive", F.lit(True)))


def field_hits(long_rows: DataFrame, field: str, query: str) -> DataFrame:
    """PF24: matches in one typed field only."""
    return long_rows.filter((F.col("field") == field) & F.contains(F.lower("value"), F.lit(query.lower())))


def to_refresh(files: DataFrame, indexes: DataFrame, *, force: bool = False) -> DataFrame:
    """(collection, stem, mtime, index_mtime, refresh): files newer than their collection's index, or without one."""
    joined = files.join(indexes.select("collection", F.col("mtime").alias("index_mtime")), "collection", "left")
    return joined.withColumn("refresh", F.lit(force) | F.col("index_mtime").isNull() | (F.col("mtime") > F.col("index_mtime")))


def refresh_counters(marked: DataFrame, primary: int = PRIMARY) -> DataFrame:
    """AG25"""
    per = marked.groupBy("collection").agg(F.count("*").alias("n"), F.count_if("refresh").alias("r"))
    return per.agg(F.count("*").alias("hubs"), F.sum("n").alias("files"), F.sum("r").alias("refreshed"), F.sum(F.col("n") - F.col("r")).alias("skipped"), F.sum(F.greatest(F.col("n") - primary, F.lit(0))).alias("archived"))


def _block() -> Column:
    line = lambda f, sep: F.when(F.size(f) > 0, F.concat(F.lit(f"- {f}: "), F.array_join(f, sep)))
    return F.concat_ws("\n", F.concat(F.lit("## [["), "stem", F.lit("]]")), line("subjects", ", "), line("people", ", "), line("claims", ", "), line("decisions", ", "), line("dates", ", "))


def rendered(facet_rows: DataFrame) -> DataFrame:
    """SK6: (collection, is_archive, content) index files of paginated rows (collection, stem, place, is_archive and field arrays)."""
    ordered = F.array_sort(F.collect_list(F.struct("place", _block().alias("block"))))
    return facet_rows.groupBy("collection", "is_archive").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("content"))


def rendered_pieces(facet_rows: DataFrame) -> DataFrame:
    """SK6: (rel, place, content): the same files in pieces for `write_pieces`, an entry each, whatever the size of an archive."""
    name = F.when(F.col("is_archive"), P.INDEX_FILES[1]).otherwise(P.INDEX_FILES[0])
    return facet_rows.select(F.concat(F.col("collection").cast("string"), F.lit("/"), name).alias("rel"), "place", _block().alias("content"))
