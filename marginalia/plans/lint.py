"""The nine checks of a corpus as one table of findings (PR11, PR12, PR19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import is_index_file, marker
from ..operators import audit, graph, links
from ..operators.audit import finding
from ..sources import parsers
from ..sources.markdown import markdown


def hubs(files: DataFrame) -> DataFrame:
    """(folder, link, head_kind) of the catalog's collections."""
    return parsers.catalog(files.filter(F.col("rel") == P.CATALOG_FILE)).filter("folder is not null").select("folder", "link", "head_kind").distinct()


def checks(files: DataFrame, as_of: Column, infrastructure: tuple[str, ...] = P.INFRASTRUCTURE) -> DataFrame:
    """Findings (check, severity, subject, detail) of all nine checks; a check without findings passes.

    `infrastructure` names root folders that are no collections (LC4); tools of
    one's own add theirs.
    """
    md = markdown(files)
    by_base = lambda base: files.filter(F.col("base") == base)
    status = parsers.status_items(by_base("status.md"))
    fresh = audit.freshness(status.groupBy("rel").agg(F.max("last_updated").alias("last_updated")), as_of).filter("severity = 'WARN'")
    decisions = parsers.decision_log(by_base("decisions.md"))
    stale_pairs = audit.overrides(decisions)
    catalog = parsers.catalog(files.filter(F.col("rel") == P.CATALOG_FILE))
    hub = hubs(files)
    tiers = ~F.col("folder").isin(*P.TIER_ONE_FOLDERS)
    registered = parsers.facet_index(files.filter(is_index_file("base"))).select(F.concat_ws("/", "folder", F.lower("stem")).alias("key"), "folder").join(hub.select("folder"), "folder", "left_semi").filter(tiers)
    disk = md.filter(~is_index_file("base") & ~F.col("stem_lc").endswith("-index")).select(F.concat_ws("/", "folder", "stem_lc").alias("key"), "folder").join(hub.select("folder"), "folder", "left_semi").filter(tiers)
    lost = audit.orphans(disk, registered)
    top = md.filter(F.contains("rel", F.lit("/"))).select(F.substring_index("rel", "/", 1).alias("folder"))
    known = hub.select("folder").union(files.sparkSession.createDataFrame([(f,) for f in tuple(infrastructure) + P.TIER_ONE_FOLDERS], "folder string"))
    folders = audit.untracked(top, known)
    logs = parsers.session_log(by_base("session-log.md")).select("date", F.concat_ws(" ", "title", F.array_join("bullets", " ")).alias("text"))
    items = status.filter((F.col("section") == "Blocked") & (F.lower("text") != "none")).select(F.col("text").alias("item"))
    blocked = audit.blockers(items, logs).filter("stale")
    marks = files.filter(F.col("rel") == P.CATALOG_FILE).select(marker("content", "managed").alias("managed"), marker("content", "summary-format-version").alias("format"))
    indexed = files.filter(F.col("base") == P.INDEX_FILES[0]).select("folder").distinct()
    bare = hub.select("folder").distinct().join(indexed, "folder", "left_anti").crossJoin(marks.filter("managed is not null").select("managed"))
    edges = graph.dangling(graph.edges(files), files)
    unformatted = marks.filter("managed is not null and (format is null or cast(format as int) < 2)")
    entries = catalog.filter("tier = 1 or tier = 3 or folder is not null").select(F.lower(F.regexp_replace(F.col("link"), r"(?i)\.md$", "")).alias("key"), "tier", "link")
    there = files.select(F.explode(F.array("stem_lc", F.regexp_replace(F.lower("rel"), r"\.md$", ""))).alias("key"))
    found = [
        finding(fresh, "freshness", "WARN", F.col("rel"), F.coalesce(F.concat(F.col("age_days"), F.lit(" days")), F.lit("no date"))),
        finding(stale_pairs, "decisions", "WARN", F.col("older"), F.concat(F.lit("superseded by "), F.col("newer"))),
        finding(lost, "orphan_files", F.col("severity"), F.col("key"), F.when(F.col("severity") == "WARN", "not registered").otherwise("no file")),
        finding(folders, "orphan_folders", "WARN", F.col("folder"), F.concat(F.col("n"), F.lit(" files"))),
        finding(blocked, "blockers", "WARN", F.col("item"), F.concat(F.col("n_entries"), F.lit(" entries"))),
        finding(bare, "coverage", "WARN", F.col("folder"), "no index"),
        finding(edges, "typed_edges", "WARN", F.col("source"), F.concat_ws(" ", "type", "target")),
        finding(unformatted, "summary_format", "WARN", P.CATALOG_FILE, F.coalesce("format", F.lit("no marker"))),
        finding(audit.missing_entries(entries, there), "catalog", F.col("severity"), F.col("link"), "no file"),
    ]
    return reduce(DataFrame.unionByName, found)


def consolidation(files: DataFrame) -> DataFrame:
    """PR12: proposals only: duplicates, contradictions, broken links, redundant pairs and weekly clusters of decisions."""
    rows = links.link_rows(files)
    decisions = parsers.decision_log(files.filter(F.col("base") == "decisions.md"))
    outside = markdown(files, P.TIER_ONE_FOLDERS).filter(F.contains("rel", F.lit("/")))
    outside_rows = rows.join(outside.select("rel"), "rel", "left_semi")
    found = [
        finding(audit.duplicate_candidates(outside, outside_rows), "duplicate", "INFO", F.col("a"), F.concat_ws(" ", "b", F.array_join("reasons", ","))),
        finding(audit.overrides(decisions), "contradiction", "WARN", F.col("older"), F.col("newer")),
        finding(links.broken_links(files, rows=rows), "broken_link", "WARN", F.col("rel"), F.col("target")),
        finding(audit.redundant_pairs(decisions), "redundant", "INFO", F.col("old"), F.col("new")),
        finding(audit.week_clusters(decisions), "cluster", "INFO", F.col("week"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, found)


def health(files: DataFrame, as_of: Column) -> DataFrame:
    """PR19: the checks, broken links and folders of three and more files outside the catalog."""
    top = markdown(files).filter(F.contains("rel", F.lit("/"))).select(F.substring_index("rel", "/", 1).alias("folder"))
    loose = audit.untracked(top, hubs(files).select("folder"), least=3)
    return checks(files, as_of).unionByName(finding(links.broken_links(files), "broken_link", "WARN", F.col("rel"), F.col("target"))).unionByName(finding(loose, "untracked", "INFO", F.col("folder"), F.concat(F.col("n"), F.lit(" files"))))
