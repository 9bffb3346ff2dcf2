"""Start and end of a session, re-indexing and upgrading as plans (PR5, PR6, PR13, PR15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.facets import facets
from ..functions.text import marker, version
from ..operators import audit, facet_index, lifecycle
from ..sources import parsers
from .lint import hubs


def briefing(files: DataFrame, as_of: Column) -> DataFrame:
    """SS1: (part, ordinal, line): status, stale notice, last session, in progress, blocked, decisions, ideas, notices."""
    by = lambda base: files.filter(F.col("base") == base)
    items = parsers.status_items(by("status.md"))
    updated = items.groupBy("rel").agg(F.max("last_updated").alias("last_updated"))
    log = parsers.session_log(by("session-log.md")).filter("ordinal = 1")
    last = lifecycle.newest(parsers.decision_log(by("decisions.md")), None, F.desc("ordinal"), k=lifecycle.LATEST)
    status = files.filter(F.col("base") == "status.md")
    unclean = audit.drift(files.filter(F.col("ext") == ".md"), status).filter("unclean")
    hub = hubs(files)
    bare = hub.select("folder").distinct().join(files.filter(F.col("base") == P.INDEX_FILES[0]).select("folder").distinct(), "folder", "left_anti")
    row = lambda df, part, ordinal, line: df.select(F.lit(part).alias("part"), ordinal.cast("int").alias("ordinal"), line.alias("line"))
    parts = [
        row(updated, "1 status", F.lit(1), F.concat(F.lit("Last updated "), F.coalesce(F.col("last_updated").cast("string"), F.lit("unknown")))),
        row(audit.freshness(updated, as_of).filter("severity = 'WARN'"), "2 stale", F.lit(1), F.concat(F.coalesce(F.col("age_days").cast("string"), F.lit("unknown")), F.lit(" days old"))),
        row(log.select(F.posexplode("bullets")), "3 last session", F.col("pos") + 1, F.col("col")),
        row(items.filter("section like '%Progress%'"), "4 in progress", F.col("ordinal"), F.col("text")),
        row(items.filter("section = 'Blocked'"), "5 blocked", F.col("ordinal"), F.col("text")),
        row(last, "6 decisions", F.col("place"), F.concat(F.col("date").cast("string"), F.lit(" - "), "text")),
        row(parsers.ideas(by("ideas.md")), "7 ideas", F.lit(1), F.concat_ws(" -> ", "title", "route")),
        row(unclean, "8 notices", F.lit(1), F.lit("files changed after the last status update")),
        row(bare, "8 notices", F.lit(2), F.concat(F.lit("no index: "), "folder")),
    ]
    return reduce(DataFrame.unionByName, parts)


def reindexed(turns: DataFrame, placed: DataFrame, primary: int = facet_index.PRIMARY) -> DataFrame:
    """PR13: facets of sessions (session_id ...) placed as (session_id, collection, stem, mtime), paginated and rendered."""
    rows = facet_index.paginated(facets(turns).join(placed, "session_id"), primary=primary)
    return facet_index.rendered(rows)


def upgrade_signals(files: DataFrame) -> DataFrame:
    """UP1-UP5: a row with the corpus's versions, missing and large indexes, and whether the memory index exists."""
    catalog = files.filter(F.col("rel") == P.CATALOG_FILE).groupBy("corpus").agg(F.max(marker("content", "managed")).alias("managed"), F.max(marker("content", "summary-format-version")).cast("int").alias("summary_format"))
    indexes = files.filter(F.col("base") == P.INDEX_FILES[0])
    hub = hubs(files).select("folder").distinct()
    missing = hub.join(indexes.select("folder"), "folder", "left_anti").agg(F.count("*").alias("n_missing"))
    oldest = indexes.withColumn("v", marker("content", "closets")).filter("v is not null").agg(F.min_by("v", version(F.col("v"))).alias("index_format"))
    large = files.filter(F.col("ext") == ".md").groupBy("folder").agg(F.count("*").alias("n")).join(hub, "folder").agg(F.count_if(F.col("n") > facet_index.PRIMARY).alias("n_large"))
    memory = indexes.agg(F.coalesce(F.bool_or(F.col("folder") == "memory"), F.lit(False)).alias("memory_index"))
    return catalog.crossJoin(missing).crossJoin(oldest).crossJoin(large).crossJoin(memory)
