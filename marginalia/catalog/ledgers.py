"""The corpus's own text formats, its registry and its federated search, over files as large as the tables.

Each format is written from rows of a table, many entries a file, and parsed
again; the SQL twin is the rows themselves, so a parse that loses, merges or
reorders an entry shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import any_phrase
from ..operators import audit, lifecycle, search
from ..session import configured, table
from ..sources import parsers
from ..sources.sinks import run_line
from .corpora import hits, named
from .vault import _FILES, PERSON, vault


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _files(rows: DataFrame, rel: Column, order: str, entry: Column, head: str = "", between: str = "\n") -> DataFrame:
    """A file for each `rel`, its entries in order."""
    entries = rows.select(rel.alias("rel"), F.struct(order, entry.alias("entry")).alias("e")).groupBy("rel").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return entries.select("rel", F.concat(F.lit(head), F.array_join(F.transform("es", lambda e: e["entry"]), between)).alias("content"))


def _place(rows: DataFrame, by: Column, order: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def ledger_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """SC9, D12: all orders as decisions, a log for each customer; every fifth is struck."""
    o = table(spark, sf, "orders")
    day, text = F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    entry = F.when(F.col("o_orderkey") % 5 == 0, _text("- ~~**", day, "** - ", text, "~~ (superseded 2030-01-0", F.col("o_orderkey") % 9 + 1, ")")).otherwise(_text("**", day, "** – ", text))
    files = _files(o, _text("c", F.col("o_custkey"), "/decisions.md"), "o_orderkey", entry, "# Decisions\n\nno entry **2020** - here\n")
    return parsers.decision_log(files).select("rel", "ordinal", F.col("date").cast("string").alias("date"), "text", "struck", F.col("superseded_on").cast("string").alias("superseded_on"))


def ledger_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """SC9, D11: all events as sessions, a log for each user; two points each and a line that is none."""
    e = table(spark, sf, "events")
    entry = _text("## ", F.date_format("ts", "yyyy-MM-dd"), " - ", F.col("event_type"), " ", F.col("event_id"), "\n- ", F.col("event_type"), "\nbetween\n* value ", F.col("event_id") % 7)
    files = _files(e, _text("u", F.col("user_id"), "/log.md"), "event_id", entry, "# Log\n", "\n\n")
    return parsers.session_log(files).select("rel", "ordinal", F.col("date").cast("string").alias("date"), "title", F.array_join("bullets", "|").alias("bullets"))


def ledger_status(spark: SparkSession, sf: str) -> DataFrame:
    """SC9, D10: a status file for each customer nation, with its customers under two headings."""
    c = table(spark, sf, "customer").withColumn("blocked", F.col("c_custkey") % 4 == 0)
    own = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("blocked") == flag, F.struct("c_custkey", F.concat(F.lit("- "), "c_name").alias("x"))))), lambda s: s["x"])
    files = c.groupBy("c_nationkey").agg(own(False).alias("going"), own(True).alias("waiting"))
    content = _text("# Status\n**Last updated:** 2024-01-", F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), "\n\n## In Progress\n", F.array_join("going", "\n"), "\n\n## What's Blocked\n", F.array_join("waiting", "\n"))
    items = parsers.status_items(files.select(_text("n", F.col("c_nationkey"), "/status.md").alias("rel"), content.alias("content"))).filter("text is not null")
    return items.select("rel", F.col("last_updated").cast("string").alias("last_updated"), "section", "ordinal", "text")


def ledger_ideas(spark: SparkSession, sf: str) -> DataFrame:
    """SC9, D13: all parts as ideas, a file for each brand; every third has a route."""
    p = table(spark, sf, "part")
    entry = _text("### Part ", F.col("p_partkey"), " - 2024-02-01\n", F.col("p_name"), "\n\n", F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, _text("\n→ ", F.lower("p_type"))).otherwise(""))
    files = _files(p, _text(F.col("p_brand"), "/ideas.md"), "p_partkey", entry, "# Ideas\n\n", "\n\n")
    return parsers.ideas(files).select("rel", "title", F.col("date").cast("string").alias("date"), "body", "route")


def ledger_runs(spark: SparkSession, sf: str) -> DataFrame:
    """SK7, D15: all events as run lines, a log for each type; counters come back in key order."""
    e = table(spark, sf, "events")
    counters = F.map_from_arrays(F.array(F.lit("seen"), F.lit("made")), F.array((F.col("event_id") % 100).cast("string"), F.col("user_id").cast("string")))
    status = F.when(F.col("event_id") % 2 == 0, "ok").otherwise("partial")
    files = _files(e, _text(F.col("event_type"), ".log"), "event_id", run_line(F.col("ts"), counters, status), "started\n")
    r = parsers.run_log(files)
    return r.groupBy("rel", run_line(F.col("ts"), F.col("counters"), F.col("status")).alias("line")).agg(F.count("*").alias("n"))


def ledger_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """SC8, D8, D9: all suppliers as rows of tier tables, a catalog for each nation; every fourth is a collection's index."""
    s = _place(table(spark, sf, "supplier"), F.col("s_nationkey"), "s_suppkey")
    link = F.when(F.col("s_suppkey") % 4 == 0, _text("s", F.col("s_suppkey"), "/_CLOSETS")).otherwise(_text("s", F.col("s_suppkey")))
    entry = _text("## Tier ", F.col("s_suppkey") % 3 + 1, " - x\n| File | Summary |\n|---|---|\n| [[", link, "]] | ", F.col("s_name"), " |")
    files = _files(s, _text("n", F.col("s_nationkey"), "/_MANIFEST.md"), "s_suppkey", entry, "# Catalog\n", "\n\n")
    return parsers.catalog(files).select("rel", "tier", "link", "summary", "head_kind", "folder")


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """All sources of documents, and one for each supplier that has no files; a third is not searched."""
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("none")).alias("name")).distinct()
    lost = table(spark, sf, "supplier").select(_text("lost-", F.col("s_suppkey")).alias("name"))
    names = d.union(lost)
    return names.select("name", F.concat(F.lit("/srv/"), "name").alias("path"), F.lit("2026-01-01").alias("registered"), (F.crc32(F.col("name").cast("binary")) % 3 > 0).alias("searchable"))


def _federated(spark: SparkSession, sf: str) -> DataFrame:
    """Every folder of the vault is a source of its own."""
    return search.federated(_registry(spark, sf), vault(spark, sf).withColumn("corpus", F.col("folder")), PERSON)


def federated_hits(spark: SparkSession, sf: str) -> DataFrame:
    """PR2, J18, PF17: hits of all searchable sources, and the sources without files."""
    return _federated(spark, sf).select("name", "rel", F.col("line_no").cast("long").alias("line_no"), "line", "note")


def federated_totals(spark: SparkSession, sf: str) -> DataFrame:
    """AG5"""
    return search.totals(_federated(spark, sf).filter("note = ''"), "name")


def registry_kept(spark: SparkSession, sf: str) -> DataFrame:
    """PR1, PR17: a source added, one removed, one switched, of a registry of all customers."""
    c = table(spark, sf, "customer").select(_text("c", F.col("c_custkey")).alias("name"), _text("/srv/", F.col("c_custkey")).alias("path"), F.lit("2026-01-01").alias("registered"), (F.col("c_custkey") % 2 == 0).alias("searchable"))
    return search.set_searchable(search.remove_source(search.add_source(c, "loft", "/srv/loft", "2026-02-01"), "c7"), "c9", True)


def stale_parts(spark: SparkSession, sf: str) -> DataFrame:
    """PF26: parts whose text has a stale marker as whole words."""
    p = table(spark, sf, "part")
    words = F.array(*[F.lit(w) for w in ("outdated", "Deprecated", "undeprecated", "do not  use", "do not use", "archived.", "unarchivedly", "replaced by")])
    text = F.concat_ws(" ", "p_name", F.element_at(words, (F.col("p_partkey") % 8 + 1).cast("int")), "p_type")
    return p.select("p_partkey", text.alias("text")).filter(any_phrase("text", P.STALE_MARKERS)).select("p_partkey", "text")


def redundant_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as decisions; every third is struck by what came on the day ten after it, and stands beside its superseders."""
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    struck = F.col("o_orderkey") % 3 == 0
    d = o.select(F.col("o_orderkey").alias("ordinal"), F.col("day").alias("date"), F.col("o_orderstatus").alias("text"), struck.alias("struck"), F.when(struck, F.date_add("day", 10)).alias("superseded_on"))
    return audit.redundant_pairs(d).groupBy("old").agg(F.count("*").alias("n"), F.min("new").alias("first"))


def customer_states(spark: SparkSession, sf: str) -> DataFrame:
    """PF29: every customer as a workspace with some files, with or without a catalog and a version."""
    k = F.col("c_custkey")
    version = F.when(k % 8 == 2, "2.0.10").when(k % 8 == 4, "2.1.3").when(k % 8 == 6, "2.10.0")
    return table(spark, sf, "customer").select("c_custkey", lifecycle.workspace_state((k % 3).cast("int"), k % 2 == 0, version).alias("state")).groupBy("state").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


QUERIES = {
    "ledger_decisions": ledger_decisions, "ledger_sessions": ledger_sessions, "ledger_status": ledger_status, "ledger_ideas": ledger_ideas, "ledger_runs": ledger_runs, "ledger_catalog": ledger_catalog,
    "federated_hits": federated_hits, "federated_totals": federated_totals, "registry_kept": registry_kept, "stale_parts": stale_parts, "redundant_orders": redundant_orders, "customer_states": customer_states,
}
QUERIES = {k: (lambda q: lambda spark, sf: q(configured(spark), sf))(v) for k, v in QUERIES.items()}

# --- the same in DuckDB ----------------------------------------------------

_ALL = f"SELECT * REPLACE (folder AS corpus) FROM ({named(_FILES)})"
_FOUND = hits(_ALL, PERSON)
_CRC = """(xor(4294967295, list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte:
    list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, bit: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, byte)), 4294967295::BIGINT)) % 3 > 0)"""
_REGISTRY = f"SELECT name FROM (SELECT DISTINCT coalesce(source, 'none') AS name FROM documents UNION ALL SELECT 'lost-' || s_suppkey FROM supplier) WHERE {_CRC}"
_FEDERATED = f"SELECT name, rel, line_no, line, '' AS note FROM ({_FOUND}) JOIN ({_REGISTRY}) ON corpus = name UNION ALL SELECT name, '', 0, '', 'path missing' FROM ({_REGISTRY}) WHERE name NOT IN (SELECT corpus FROM ({_ALL}))"

ORACLES = {
    "ledger_decisions": """SELECT 'c' || o_custkey || '/decisions.md' AS rel, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS ordinal, o_orderdate::DATE::VARCHAR AS date, o_orderstatus || ' ' || o_orderpriority AS text, o_orderkey % 5 = 0 AS struck,
        CASE WHEN o_orderkey % 5 = 0 THEN '2030-01-0' || (o_orderkey % 9 + 1) END AS superseded_on FROM orders""",
    "ledger_sessions": "SELECT 'u' || user_id || '/log.md' AS rel, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS ordinal, ts::DATE::VARCHAR AS date, event_type || ' ' || event_id AS title, event_type || '|value ' || event_id % 7 AS bullets FROM events",
    "ledger_status": "SELECT 'n' || c_nationkey || '/status.md' AS rel, '2024-01-' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') AS last_updated, CASE WHEN c_custkey % 4 = 0 THEN 'Blocked' ELSE 'In Progress' END AS section, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 4 = 0 ORDER BY c_custkey)::INT AS ordinal, c_name AS text FROM customer",
    "ledger_ideas": "SELECT p_brand || '/ideas.md' AS rel, 'Part ' || p_partkey AS title, '2024-02-01' AS date, p_name || chr(10) || p_type AS body, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) END AS route FROM part",
    "ledger_runs": "SELECT event_type || '.log' AS rel, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '  made=' || user_id || ' seen=' || event_id % 100 || '  status=' || CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'partial' END AS line, count(*) AS n FROM events GROUP BY 1, 2",
    "ledger_catalog": "SELECT 'n' || s_nationkey || '/_MANIFEST.md' AS rel, (s_suppkey % 3 + 1)::INT AS tier, 's' || s_suppkey || CASE WHEN s_suppkey % 4 = 0 THEN '/_CLOSETS' ELSE '' END AS link, s_name AS summary, CASE WHEN s_suppkey % 4 = 0 THEN 'closets' ELSE 'file' END AS head_kind, CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey END AS folder FROM supplier",
    "federated_hits": _FEDERATED,
    "federated_totals": f"SELECT count(*) AS total_hits, count(DISTINCT name) AS n_groups FROM ({_FEDERATED}) WHERE note = ''",
    "registry_kept": "SELECT 'c' || c_custkey AS name, '/srv/' || c_custkey AS path, '2026-01-01' AS registered, c_custkey % 2 = 0 OR c_custkey = 9 AS searchable FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'loft', '/srv/loft', '2026-02-01', true",
    "stale_parts": r"""SELECT p_partkey, text FROM (SELECT p_partkey, p_name || ' ' || ['outdated', 'Deprecated', 'undeprecated', 'do not  use', 'do not use', 'archived.', 'unarchivedly', 'replaced by'][p_partkey % 8 + 1] || ' ' || p_type AS text FROM part)
        WHERE regexp_matches(text, '(?i)\b(outdated|deprecated|superseded|archived|do not use|replaced by)\b')""",
    "redundant_orders": "WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d FROM orders) SELECT a.k AS old, count(*) AS n, min(b.k) AS first FROM o a JOIN o b ON a.d + 10 = b.d AND b.k > a.k WHERE a.k % 3 = 0 AND b.k % 3 <> 0 GROUP BY a.k",
    "customer_states": "SELECT CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN 'empty' WHEN c_custkey % 2 = 1 THEN 'files' WHEN c_custkey % 8 = 0 THEN 'compatible' WHEN c_custkey % 8 = 2 THEN 'old' ELSE 'current' END AS state, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1",
}
