"""Queries over conversations, pages, orders, events and the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facets as fx
from ..functions.text import slug, tokens
from ..operators import audit, facet_index, graph, lifecycle, links, search
from ..session import configured, table

AS_OF = "2024-02-01"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")


def _session(column: str):
    return lambda spark, sf: fx.sessions(_turns(spark, sf)).select("session_id", F.col(column).alias("text"))


def role_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).groupBy("role").agg(F.count("*").alias("n_turns"), F.count_distinct("session_id").alias("n_sessions"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def first_sentences(spark: SparkSession, sf: str) -> DataFrame:
    t = _turns(spark, sf).filter("role = 'user'")
    return t.select("session_id", "turn", fx.first_sentence(F.col("text")).alias("sentence"))


def facet_people(spark: SparkSession, sf: str) -> DataFrame:
    return fx.people(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.array_join("people", "; ").alias("people"))


def facet_dates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(fx.dates(F.col("text")), "; ").alias("dates"))


def facet_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The whole facet entry of every conversation (patterns with look-behind and Unicode word ends: no SQL twin)."""
    return fx.facets(_turns(spark, sf)).select("session_id", "entry")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    href = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.posexplode(href).alias("ordinal", "target"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("target").alias("n_targets"))


def page_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    """Hrefs whose path is no page's path, by equality on the path."""
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1), "/+$", "")
    known = table(spark, sf, "pages").select(path.alias("path")).distinct()
    return _pages(spark, sf).withColumn("path", F.regexp_replace("target", "/+$", "")).join(known, "path", "left_anti").groupBy("page_id").agg(F.count("*").alias("n_broken"))


def top_link_targets(spark: SparkSession, sf: str) -> DataFrame:
    top = links.top_targets(_pages(spark, sf).withColumnRenamed("page_id", "rel"))
    return top.select(F.col("rel").alias("page_id"), "target", "n", F.col("place").cast("long").alias("place"))


def _geo_edges(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.lit("blocks").alias("type"), F.col("r_name").alias("target"))


def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree(_geo_edges(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as index entries: the customer's nation is the collection, the date the time of change."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("collection"), F.col("o_orderkey").alias("stem"), F.col("o_orderdate").alias("mtime"), "o_orderstatus")


def facet_paginate(spark: SparkSession, sf: str) -> DataFrame:
    p = facet_index.paginated(_entries(spark, sf))
    return p.select("collection", "stem", F.col("place").cast("long").alias("place"), "is_archive", "recently_archived")


def facet_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return facet_index.first_page(_entries(spark, sf)).select("collection", "stem", F.col("place").cast("long").alias("place"))


def archive_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Failed orders of the first page; of the archive only for nations without one there."""
    hits = facet_index.paginated(_entries(spark, sf)).filter("o_orderstatus = 'F'").select("collection", "stem", "is_archive")
    return facet_index.with_fallback(hits.filter("not is_archive").drop("is_archive"), hits.filter("is_archive").drop("is_archive"))


def incremental_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' newest order against the nation's index time, the median day of its orders by rank."""
    e = _entries(spark, sf)
    index = e.groupBy("collection").agg(F.min("mtime").alias("lo"), F.max("mtime").alias("hi")).select("collection", F.timestamp_seconds(F.expr("(unix_timestamp(lo) + unix_timestamp(hi)) div 2")).alias("mtime"))
    marked = facet_index.to_refresh(e, index)
    return facet_index.refresh_counters(marked)


def log_rotate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    r = lifecycle.rotated(e, "user_id", F.desc("ts"), F.desc("event_id"))
    return r.groupBy("user_id").agg(F.count_if(~F.col("archived")).alias("kept"), F.count_if("archived").alias("archived"), F.min(F.when(~F.col("archived"), F.col("event_id"))).alias("least_kept"))


def latest_entry(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def last_five(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return lifecycle.newest(e, "event_type", F.desc("ts"), F.desc("event_id"), k=lifecycle.LATEST).select("event_type", "event_id", F.col("place").cast("long").alias("place"))


def cadence(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "events").select(F.concat_ws("-", F.lit("user"), F.col("user_id").cast("string")).alias("op"), "ts")
    return audit.last_runs(runs, F.lit(AS_OF).cast("date")).select("op", F.col("days").cast("long").alias("days"), "due")


def cooldown(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("lock_ts"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_ok"))
    return audit.lock_state(e.withColumnRenamed("user_id", "op"), F.to_timestamp(F.lit("2024-01-30 12:00:00"))).select("op", "state", "cooling_down")


def session_drift(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("corpus"), F.col("ts").alias("mtime"), "event_type")
    status = e.filter("event_type = 'purchase'").groupBy("corpus").agg(F.max("mtime").alias("mtime"))
    return audit.drift(e, status).select("corpus", "unclean")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.refresh import event_counts

    return event_counts(table(spark, sf, "events"))


def week_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Weeks of error events whose property texts overlap."""
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("event_id").alias("ordinal"), F.col("ts").alias("date"), F.col("props").alias("text"))
    return audit.week_clusters(e)


def orphan_customers(spark: SparkSession, sf: str) -> DataFrame:
    disk = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    registered = table(spark, sf, "orders").select((F.col("o_custkey") + F.when(F.col("o_orderkey") % 97 == 0, 10_000_000).otherwise(0)).alias("key"))
    return audit.orphans(disk, registered)


def untracked_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of at least three parts without a line item from a supplier of nation 0."""
    p, l, s = (table(spark, sf, n) for n in ("part", "lineitem", "supplier"))
    known = l.join(s.filter("s_nationkey = 0"), l.l_suppkey == s.s_suppkey, "left_semi").join(p, l.l_partkey == p.p_partkey).select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("folder"))
    members = p.select(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("folder"))
    return audit.untracked(members, known, least=3)


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    hubs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("folder"))
    return audit.coverage(hubs, table(spark, sf, "supplier").select(F.col("s_nationkey").alias("folder")))


def catalog_consistency(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 3 + 1).alias("tier"))
    missing = audit.missing_entries(entries, table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("key")))
    return missing.groupBy("tier", "severity").agg(F.count("*").alias("n"))


def near_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of distinct part names within two edits, each name by its least part."""
    p = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    return audit.near_names(p).select("a", "b", F.col("distance").cast("long").alias("distance"))


def blockers(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "events").select(F.col("event_type").alias("item")).distinct()
    log = table(spark, sf, "events").select(F.to_date("ts").alias("date"), F.concat_ws(" ", F.lit("still"), "event_type").alias("text"))
    return audit.blockers(items, log).select("item", "n_entries", F.col("days").cast("long").alias("days"), "stale")


def local_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a text, source by source, twenty shown of each."""
    hits = table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("thing"))).select("source", "doc_id")
    return search.capped(hits, "source", "doc_id").select("source", "doc_id", F.col("place").cast("long").alias("place"), "total", F.col("more").cast("long").alias("more"))


def unique_sessions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return lifecycle.first_of_text(d, "text", "doc_id")


def work_list(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"))
    cached = table(spark, sf, "labels").select(F.col("doc_id").alias("session_id"), F.when(F.col("quality") == 1, "ok").alias("text"))
    return lifecycle.work_list(wanted, cached)


def mirror_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's documents of one length against the first of that length."""
    d = table(spark, sf, "documents").select(F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("name"), "doc_id", F.sha2("text", 256).alias("content"))
    owners = lifecycle.first_of_key(d, "name", "doc_id").select("name", "content")
    return lifecycle.copies_differ(owners, d).select("doc_id", "differs")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", slug("p_name").alias("slug"), slug("p_type").alias("type_slug"))


def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Passages with the share of their words that each document has; only pairs that share a word."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(tokens("text")).alias("wb"))
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("w"))
    shared = b.select("item_id", F.size("wb").alias("n"), F.explode("wb").alias("w")).join(d, "w").groupBy("item_id", "n", "doc_id").agg(F.count("*").alias("k"))
    return shared.select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("share"))


QUERIES = {
    "session_content": _session("content"), "session_summary": _session("summary"), "session_firstmsg": _session("firstmsg"), "transcript_capped": _session("transcript"),
    "role_profile": role_profile, "first_sentences": first_sentences, "facet_people": facet_people, "facet_dates": facet_dates, "facet_entries": facet_entries,
    "page_links": page_links, "page_broken_links": page_broken_links, "top_link_targets": top_link_targets, "graph_degree": graph_degree,
    "facet_paginate": facet_paginate, "facet_first_page": facet_first_page, "archive_fallback": archive_fallback, "incremental_refresh": incremental_refresh,
    "log_rotate": log_rotate, "latest_entry": latest_entry, "last_five": last_five, "cadence": cadence, "cooldown": cooldown, "session_drift": session_drift, "event_windows": event_windows, "week_clusters": week_clusters,
    "orphan_customers": orphan_customers, "untracked_parts": untracked_parts, "coverage": coverage, "catalog_consistency": catalog_consistency, "near_names": near_names, "blockers": blockers,
    "local_search": local_search, "unique_sessions": unique_sessions, "work_list": work_list, "mirror_drift": mirror_drift, "slugs": slugs, "token_overlap": token_overlap,
}
QUERIES = {k: (lambda q: lambda spark, sf: q(configured(spark), sf))(v) for k, v in QUERIES.items()}

from .retrieval import tok  # noqa: E402

_FIRST = "coalesce(arg_min(text, turn) FILTER (role = '{}'), '')"
_TRANSCRIPT = "string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn)"
_PEOPLE = "regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){0,2}\\b')"
_NOT = "[" + ", ".join(f"'{w}'" for w in fx.P.NOT_NAMES) + "]"
_ENTRIES = "SELECT c_nationkey AS collection, o_orderkey AS stem, o_orderdate AS mtime, o_orderstatus, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey"
_HREF = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages"""

ORACLES = {
    "session_content": "SELECT conv_id AS session_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "session_summary": f"SELECT conv_id AS session_id, left({_FIRST.format('user')}, 250) || ' | ' || left({_FIRST.format('assistant')}, 250) AS text FROM conversations GROUP BY conv_id",
    "session_firstmsg": f"SELECT conv_id AS session_id, {_FIRST.format('user')} AS text FROM conversations GROUP BY conv_id",
    "transcript_capped": f"SELECT conv_id AS session_id, CASE WHEN length({_TRANSCRIPT}) > 8000 THEN left({_TRANSCRIPT}, 8000) || '...[truncated]' ELSE {_TRANSCRIPT} END AS text FROM conversations GROUP BY conv_id",
    "role_profile": "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_sessions, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY role",
    "first_sentences": r"SELECT conv_id AS session_id, turn, left(CASE WHEN t = '' THEN '' ELSE regexp_extract(t, '^(?s:.*?[.!?])\s') END, 0) || left(CASE WHEN regexp_matches(t, '[.!?]\s') THEN rtrim(regexp_extract(t, '^(?s:.*?[.!?])\s'), chr(10) || chr(9) || chr(13) || ' ') ELSE t END, 120) AS sentence FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations WHERE role = 'user')",
    "facet_people": f"""WITH p AS (SELECT doc_id, {_PEOPLE} AS a FROM documents), u AS (SELECT doc_id, unnest(a) AS m, generate_subscripts(a, 1) AS i FROM p),
        k AS (SELECT doc_id, m, 2 * count(*) AS w, min(i) AS i FROM u WHERE length(m) >= 3 AND NOT list_contains({_NOT}, regexp_split_to_array(m, '\\s+')[1]) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i) AS rn FROM k)
        SELECT d.doc_id, coalesce(string_agg(m, '; ' ORDER BY rn) FILTER (rn <= 8), '') AS people FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "page_links": f"SELECT page_id, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM ({_HREF}) GROUP BY page_id",
    "page_broken_links": rf"SELECT page_id, count(*) AS n_broken FROM ({_HREF}) WHERE regexp_replace(target, '/+$', '') NOT IN (SELECT regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/+$', '') FROM pages) GROUP BY page_id",
    "top_link_targets": f"SELECT * FROM (SELECT page_id, target, count(*) AS n, row_number() OVER (PARTITION BY page_id ORDER BY count(*) DESC, target) AS place FROM ({_HREF}) GROUP BY page_id, target) WHERE place <= 5",
    "graph_degree": "SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT lower(n_name) AS node, 1 AS o, 0 AS i FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name), 0, 1 FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY node",
    "facet_paginate": f"SELECT collection, stem, place, place > 30 AS is_archive, place > 30 AND place <= 35 AS recently_archived FROM ({_ENTRIES})",
    "facet_first_page": f"SELECT collection, stem, place FROM ({_ENTRIES}) WHERE place <= 30",
    "archive_fallback": f"WITH h AS (SELECT * FROM ({_ENTRIES}) WHERE o_orderstatus = 'F') SELECT collection, stem, place > 30 AS from_archive FROM h WHERE place <= 30 OR collection NOT IN (SELECT collection FROM h WHERE place <= 30)",
    "incremental_refresh": f"WITH e AS ({_ENTRIES}), x AS (SELECT collection, (epoch_us(min(mtime)) // 1000000 + epoch_us(max(mtime)) // 1000000) // 2 AS m FROM e GROUP BY collection), p AS (SELECT collection, count(*) AS n, count(*) FILTER (epoch_us(mtime) > m * 1000000) AS r FROM e JOIN x USING (collection) GROUP BY collection) SELECT count(*) AS hubs, sum(n)::BIGINT AS files, sum(r)::BIGINT AS refreshed, sum(n - r)::BIGINT AS skipped, sum(greatest(n - 30, 0))::BIGINT AS archived FROM p",
    "log_rotate": "SELECT user_id, count(*) FILTER (p <= 10) AS kept, count(*) FILTER (p > 10) AS archived, min(event_id) FILTER (p <= 10) AS least_kept FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) GROUP BY user_id",
    "latest_entry": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1",
    "last_five": "SELECT event_type, event_id, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 5",
    "cadence": f"SELECT 'user-' || user_id AS op, date_diff('day', max(ts)::DATE, DATE '{AS_OF}') AS days, date_diff('day', max(ts)::DATE, DATE '{AS_OF}') > 14 AS due FROM events GROUP BY user_id",
    "cooldown": "WITH e AS (SELECT user_id AS op, max(ts) FILTER (event_type = 'error') AS l, max(ts) FILTER (event_type <> 'error') AS o FROM events GROUP BY user_id), s AS (SELECT op, epoch_us(TIMESTAMP '2024-01-30 12:00:00') // 1000000 - epoch_us(l) // 1000000 AS age, epoch_us(TIMESTAMP '2024-01-30 12:00:00') // 1000000 - epoch_us(o) // 1000000 AS since FROM e) SELECT op, CASE WHEN age IS NULL THEN 'free' WHEN age < 1800 THEN 'held' ELSE 'stale' END AS state, coalesce(since < 86400, false) AS cooling_down FROM s",
    "session_drift": "WITH e AS (SELECT user_id AS corpus, max(ts) AS n, max(ts) FILTER (event_type = 'purchase') AS s FROM events GROUP BY user_id) SELECT corpus, epoch_us(n) // 1000000 - epoch_us(s) // 1000000 > 300 AS unclean FROM e WHERE s IS NOT NULL",
    "event_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "week_clusters": f"WITH d AS (SELECT event_id AS k, date_trunc('week', ts)::DATE AS week, list_distinct({tok('props')}) AS w FROM events WHERE event_type = 'error'), p AS (SELECT DISTINCT a.week, a.k FROM d a JOIN d b ON a.week = b.week AND a.k <> b.k AND len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) >= 0.5) SELECT week, count(*) AS n FROM p GROUP BY week HAVING count(*) >= 3",
    "orphan_customers": "WITH d AS (SELECT DISTINCT c_custkey AS key FROM customer), r AS (SELECT DISTINCT o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 10000000 ELSE 0 END AS key FROM orders) SELECT coalesce(d.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'WARN' ELSE 'INFO' END AS severity FROM d FULL JOIN r ON d.key = r.key WHERE d.key IS NULL OR r.key IS NULL",
    "untracked_parts": "WITH m AS (SELECT p_brand || '/' || p_size AS folder, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3) SELECT * FROM m WHERE folder NOT IN (SELECT p_brand || '/' || p_size FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 0)",
    "coverage": "SELECT count(*) FILTER (c) AS covered, count(*) AS hubs, round(100.0::DOUBLE * count(*) FILTER (c) / count(*), 2) AS percent FROM (SELECT n_nationkey IN (SELECT s_nationkey FROM supplier) AS c FROM nation)",
    "catalog_consistency": "SELECT p_size % 3 + 1 AS tier, CASE WHEN p_size % 3 + 1 = 3 THEN 'INFO' ELSE 'WARN' END AS severity, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45) GROUP BY ALL",
    "near_names": "WITH p AS (SELECT lower(p_name) AS nm, min(p_partkey) AS id FROM part GROUP BY 1) SELECT a.id AS a, b.id AS b, levenshtein(a.nm, b.nm)::BIGINT AS distance FROM p a JOIN p b ON a.id < b.id WHERE levenshtein(a.nm, b.nm) <= 2",
    "blockers": "WITH i AS (SELECT DISTINCT event_type AS item FROM events), l AS (SELECT ts::DATE AS d, 'still ' || event_type AS t FROM events), n AS (SELECT item, count(t) AS n_entries, date_diff('day', min(d), max(d)) AS days FROM i LEFT JOIN l ON contains(t, item) GROUP BY item) SELECT item, n_entries, days, n_entries >= 3 OR coalesce(days, 0) > 7 AS stale FROM n",
    "local_search": "SELECT source, doc_id, place, total, greatest(total - 20, 0) AS more FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS total FROM documents WHERE contains(lower(text), 'thing')) WHERE place <= 20",
    "unique_sessions": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "work_list": "SELECT doc_id AS session_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "mirror_drift": "SELECT doc_id, text <> first_value(text) OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS differs FROM documents",
    "slugs": "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS type_slug FROM part",
    "token_overlap": f"WITH b AS (SELECT item_id, list_distinct({tok('text')}) AS ws FROM benchmark), w AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM b), d AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS w FROM documents) SELECT item_id, doc_id, round(count(*)::DOUBLE / n, 6) AS share FROM w JOIN d USING (w) GROUP BY item_id, n, doc_id",
}
