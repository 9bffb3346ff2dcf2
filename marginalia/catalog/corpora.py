"""Queries over a small markdown corpus, given as literal rows to both engines.

The driver tables hold no markdown, so the corpus stands here; the operators
are the same that read file trees through the corpus source.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facets as fx
from ..functions import patterns as P
from ..functions.text import clean_summary, fields, marker
from ..operators import audit, graph, lifecycle, links, search
from ..plans import briefing, lint
from ..session import configured
from ..sources import parsers
from ..sources.markdown import with_names
from ..sources.sinks import run_line, summary_line

AS_OF = "2026-02-20"

#: (corpus, rel, content, mtime)
FILES = [
    ("garden", "_MANIFEST.md", "# Routing\n<!-- x-managed:2.0.1 -->\n<!-- summary-format-version:1 -->\n\n## Tier 1 - Always\n\n| File | Summary | Volatility |\n|---|---|---|\n| [[status]] | where things stand | VOLATILE |\n| [[glossary]] | words | STABLE |\n\n## Tier 3 - Archive\n\n| File | Reason | Date |\n|---|---|---|\n| [[old-plan]] | replaced | 2026-01-02 |\n\n## Hub Map\n\n| Domain | Hub | Summary |\n|---|---|---|\n| beds | [[beds/_CLOSETS]] | vegetable beds |\n| tools | [[tools-index]] | what we own |\n", "2026-02-01 08:00:00"),
    ("garden", "memory/status.md", "# Status\n\nLast updated: 2026-02-10\n\n## In Progress\n- [[raised-bed]] needs soil\n\n## What's Blocked\n- seed order\n- water pump\n", "2026-02-10 09:00:00"),
    ("garden", "memory/session-log.md", "# Log\n\n## 2026-02-12 - soil day\n\n- moved soil, seed order still open\n- plan in [[raised-bed]]\n\n---\n\n## 2026-02-08 - order\n\n- seed order sent again\n\n---\n\n## 2026-02-01 - start\n\n- seed order drafted\n- tools counted\n", "2026-02-12 18:00:00"),
    ("garden", "memory/decisions.md", "# Decisions\n\n- **2026-01-05** - water the north bed by hand\n- ~~**2026-01-06** - buy plastic pots~~ (superseded 2026-01-20)\n- **2026-01-20** - clay pots instead of plastic pots\n- **2026-02-02** - drip hose replaces water by hand for the north bed\n- **2026-02-03** - north bed gets clover\n- **2026-02-04** - north bed gets compost\n", "2026-02-04 10:00:00"),
    ("garden", "scratch/ideas.md", "# Ideas\n\n### Bee hotel - 2026-02-11\n\nA box for wild bees near the beds.\n\n-> beds\n\n### Night light - 2026-02-12\n\nSolar lamps.\n", "2026-02-12 11:00:00"),
    ("garden", "beds/_CLOSETS.md", "# Index: beds\n\n<!-- x-closets:1.0 -->\n\n## [[raised-bed]]\n- subjects: soil, slope\n- people: [[Ada]], [[Bo]]\n- dates: March 2026\n\n## [[lost-bed]]\n- subjects: rain\n", "2026-02-02 10:00:00"),
    ("garden", "beds/raised-bed.md", "---\ntype: project\nstatus: active\ndate: 2026-01-10\npeople: [[ada]], [[bo]]\nblocks: [[herb-spiral.v2]]\n---\n# Raised bed\n\nSee [[herb-spiral.v2]] and [[beds/raised-bed|itself]] or [[missing-note]].\n\n```\n[[not-a-link]]\n```\nThe old plan of ada mentions the herb spiral too.\n", "2026-02-12 17:00:00"),
    ("garden", "beds/herb-spiral.v2.md", "---\ntype: 'project'\nstatus: done\nsupersedes: [[old-plan]]\n---\nStones from [[raised-bed]], twice [[raised-bed]], and [[ada]]. More at https://example.com/raised-bed now.\n", "2026-01-30 12:00:00"),
    ("garden", "beds/herb-spirals.md", "No front matter. [[raised-bed]] and [[ada]] again.\n", "2026-01-29 12:00:00"),
    ("garden", "people/ada.md", "---\ntype: person\n---\nAda keeps the raised bed.\n", "2026-01-15 12:00:00"),
    ("garden", "people/bo.md", "---\ntags: x\n---\nBo. `[[in-code]]` [[glossary.md]] [[deep/status]]\n", "2026-01-15 12:00:00"),
    ("garden", "memory/glossary.md", "Words.\n", "2026-01-03 12:00:00"),
    ("garden", "tools/rake.md", "---\ntype: tool\nblocked-by: [[shed]]\n---\nRake.\n", "2026-01-04 12:00:00"),
    ("garden", "compost/a.md", "a", "2026-01-04 12:00:00"),
    ("garden", "compost/b.md", "b", "2026-01-04 12:00:00"),
    ("garden", "compost/c.md", "c", "2026-01-04 12:00:00"),
    ("harbor", "_MANIFEST.md", "# Routing\n## Hub Map\n\n| Domain | Hub | Summary |\n|---|---|---|\n| boats | [[boats/_CLOSETS]] | hulls, ada's list |\n", "2026-02-01 08:00:00"),
    ("harbor", "boats/_CLOSETS.md", "<!-- x-closets:1.1 -->\n\n## [[skiff]]\n- people: [[Ada]]\nstatus: active\n", "2026-02-01 08:00:00"),
    ("harbor", "boats/skiff.md", "A skiff.\n", "2026-02-01 08:00:00"),
]
REGISTRY = "# Sources\n\n- path: /nowhere\n\n## garden\n- path: /srv/garden\n- registered: 2026-01-01\n- searchable: yes\n\n## two words\n- path: /srv/lost\n\n## harbor\n- path: /srv/harbor\n- registered: 2026-01-02\n\n## attic\n- path: /srv/attic\n- searchable: true\n\n## cellar\n- path: /srv/cellar\n- searchable: false\n"
RUNS = "started\n2026-02-01T10:00:00  dedup=3 contradictions=1 orphans=0  status=ok\n2026-02-03T11:30:00  hubs=2 files=14 refreshed=5 skipped=9  status=partial\n"
#: (session_id, turn, role, text); plain ASCII, so both dialects agree.
TURNS = [
    (1, 0, "system", "Be brief about the GPT and the API."),
    (1, 1, "user", "I am a teacher in Lisbon. My brother mike loves dogs! I have 3 cats and 2 kids. Meet on Tuesday."),
    (1, 2, "assistant", 'Noted: "green tea set" it is. I chose oolong over sencha because of June 12.'),
    (1, 3, "user", "- buy oat milk\n- call Anna Maria Lopez\nI prefer tea. I'll try running tomorrow at 3:30pm."),
    (2, 0, "user", "I used to live in Oslo. I was born in 1987. My dog's name was Rex."),
    (2, 1, "assistant", "# Travel Plan\nSwitched to trains from planes, 2 weeks ago. We won't fly in May."),
    (2, 2, "user", "Call Anna on 2024-03-05 or 3/5/24. I can't eat nuts. I am allergic to nuts."),
    (3, 0, "assistant", "Hello there. How can I help today?"),
]


def files(spark: SparkSession) -> DataFrame:
    return with_names(spark.createDataFrame([(c, r, t, datetime.fromisoformat(m)) for c, r, t, m in FILES], "corpus string, rel string, content string, mtime timestamp"))


def _one(spark: SparkSession, corpus: str = "garden") -> DataFrame:
    return files(spark).filter(F.col("corpus") == corpus)


def _text(spark: SparkSession, rel: str, content: str) -> DataFrame:
    return spark.createDataFrame([(rel, content)], "rel string, content string")


def _turns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TURNS, "session_id int, turn int, role string, text string")


def _as_of():
    return F.lit(AS_OF).cast("date")


def _decisions(spark: SparkSession) -> DataFrame:
    return parsers.decision_log(_one(spark).filter("base = 'decisions.md'"))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark).select("corpus", "rel", "folder", "base", "stem", "stem_lc", "ext", F.col("mtime").cast("date").cast("string").alias("day"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.catalog(_one(spark).filter(F.col("rel") == P.CATALOG_FILE)).select("section", "tier", "link", "summary", "head_kind", "folder")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.session_log(_one(spark).filter("base = 'session-log.md'")).select("ordinal", F.col("date").cast("string").alias("date"), "title", F.array_join("bullets", "|").alias("bullets"))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.status_items(_one(spark).filter("base = 'status.md'")).select(F.col("last_updated").cast("string").alias("last_updated"), "section", "ordinal", "text")


def _ideas(spark: SparkSession, sf: str) -> DataFrame:
    hubs = spark.createDataFrame([("beds",), ("tools",)], "folder string")
    found = parsers.ideas(_one(spark).filter("base = 'ideas.md'"))
    return lifecycle.routed(found, hubs).select("title", F.col("date").cast("string").alias("date"), "body", "collection")


def _federated(spark: SparkSession, sf: str) -> DataFrame:
    return search.federated(parsers.registry(_text(spark, "sources.md", REGISTRY)), files(spark), "ada")


def _registry_after(spark: SparkSession, sf: str) -> DataFrame:
    r = parsers.registry(_text(spark, "sources.md", REGISTRY)).drop("at")
    r = search.add_source(r, "loft", "/srv/loft", "2026-02-01")
    return search.set_searchable(search.remove_source(r, "attic"), "cellar", True)


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    r = parsers.run_log(_text(spark, "runs.log", RUNS))
    return r.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), run_line(F.col("ts"), F.col("counters"), F.col("status")).alias("line"), "status")


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("a", "2.1.3", 2, 0, "1.1", 0, True), ("b", "2.0.9", 1, 1, "1.0", 2, False), ("c", None, None, 0, None, 0, False), ("d", "2.1.0", 2, 0, "1.1", 4, False), ("e", "10.0.0", 2, 3, "1.0", 0, True)], "corpus string, managed string, summary_format int, n_missing int, index_format string, n_large int, memory_index boolean")
    return audit.upgrade_plan(rows)


def _states(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("a", 0, False, None), ("b", 3, False, None), ("c", 3, True, None), ("d", 3, True, "2.0.10"), ("e", 3, True, "2.1.3"), ("f", 3, True, "2.10.0")], "name string, n int, has boolean, managed string")
    return rows.select("name", lifecycle.workspace_state(F.col("n"), F.col("has"), F.col("managed")).alias("state"))


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    old = spark.createDataFrame([("a", "x\nLast updated: 2026-01-01\ny"), ("b", "x\nLast updated: 2026-01-01\ny")], "rel string, content string")
    new = spark.createDataFrame([("a", "x\nLast updated: 2026-01-02\ny"), ("b", "x\nLast updated: 2026-01-02\nz"), ("c", "new")], "rel string, content string")
    return lifecycle.changed(old, new).select("rel")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    frame = lambda rows: spark.createDataFrame(rows, "name string, path string")
    return lifecycle.resolved_paths(frame([("status", "cfg/status.md")]), frame([("status", "memory/status.md"), ("log", "memory/log.md")]), frame([("ideas", "x/ideas.md"), ("log", "b/log.md"), ("ideas", "a/ideas.md")]))


def _pressure(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(55, 103).select(F.col("id").alias("n_lines"), audit.pressure(F.col("id")).alias("action"))


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "subjects: a; b | people: c |  | dates: d"), (2, "plain"), (3, ""), (4, "a|b"), (5, "Summary: - x"), (6, "One-line summary:  y ")], "id int, t string")
    return rows.select("id", F.array_join(fields("t"), "#").alias("fields"), clean_summary("t").alias("clean"))


def _summary_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("content:bm25", 0.5, 0.9375), ("closets:emax", 1.0, 0.0)], "strategy string, a double, b double")
    return rows.select(summary_line(F.col("strategy"), F.col("a"), F.col("b")).alias("line"))


def _renamed(spark: SparkSession, sf: str) -> DataFrame:
    after = links.renamed(_one(spark), {"raised-bed": "tall-bed", "ada": "ada-l"})
    return links.link_rows(after).groupBy("target").agg(F.count("*").alias("n"))


def _field_hits(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.facet_index(files(spark).filter(F.col("base").isin(*P.INDEX_FILES))).filter((F.col("field") == "people") & F.contains(F.lower("value"), F.lit("ada"))).select("rel", "stem")


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    d = _decisions(spark)
    return audit.annotated(d, audit.overrides(d)).select("ordinal", "struck", F.col("superseded_on").cast("string").alias("superseded_on"))


_FACET = lambda name: lambda spark, sf: fx.facets(_turns(spark)).select("session_id", F.array_join(name, "|").alias(name))

QUERIES = {
    "file_names": _named,
    "link_rows": lambda s, sf: links.link_rows(_one(s)),
    "broken_links": lambda s, sf: links.broken_links(_one(s)),
    "index_issues": lambda s, sf: links.index_issues(files(s)),
    "link_totals": lambda s, sf: links.link_totals(_one(s)),
    "link_targets_top": lambda s, sf: links.top_targets(links.link_rows(_one(s))).select("rel", "target", "n"),
    "mention_suggest": lambda s, sf: links.mentions(_one(s)).select("rel", "line_no", "text", "stem"),
    "links_renamed": _renamed,
    "front_matter": lambda s, sf: parsers.front_matter_fields(_one(s)),
    "graph_nodes": lambda s, sf: graph.nodes(_one(s)),
    "graph_edges": lambda s, sf: graph.edges(_one(s)).select("source", "type", "ordinal", "target"),
    "graph_dangling": lambda s, sf: graph.dangling(graph.edges(_one(s)), _one(s)).select("source", "type", "target"),
    "graph_edge_counts": lambda s, sf: graph.edge_counts(graph.edges(_one(s))),
    "graph_by_type": lambda s, sf: graph.stems_by(graph.nodes(_one(s)), "type").select("type", F.array_join("stems", ",").alias("stems")),
    "graph_by_status": lambda s, sf: graph.stems_by(graph.nodes(_one(s)), "status").select("status", F.array_join("stems", ",").alias("stems")),
    "graph_by_source": lambda s, sf: graph.edges_by_source(graph.edges(_one(s))).select("source", F.array_join("edges", ",").alias("edges")),
    "graph_stats": lambda s, sf: graph.stats(_one(s)),
    "graph_report": lambda s, sf: graph.report(_one(s)),
    "facet_index_lines": lambda s, sf: parsers.facet_index(files(s).filter(F.col("base").isin(*P.INDEX_FILES))).select("rel", "stem", "field", "value"),
    "facet_field_hits": _field_hits,
    "catalog_rows": _catalog,
    "session_log_entries": _log,
    "status_sections": _status,
    "idea_routes": _ideas,
    "decision_rows": lambda s, sf: _decisions(s).select("ordinal", F.col("date").cast("string").alias("date"), "text", "struck", F.col("superseded_on").cast("string").alias("superseded_on")),
    "override_pairs": lambda s, sf: audit.overrides(_decisions(s)),
    "decisions_annotated": _annotated,
    "redundant_pairs": lambda s, sf: audit.redundant_pairs(_decisions(s)).select("old", "new"),
    "decision_clusters": lambda s, sf: audit.week_clusters(_decisions(s)).select(F.col("week").cast("string").alias("week"), "n"),
    "duplicate_candidates": lambda s, sf: audit.duplicate_candidates(_one(s), links.link_rows(_one(s))).select("a", "b", F.array_join("reasons", ",").alias("reasons")),
    "lint_report": lambda s, sf: lint.checks(_one(s), _as_of()),
    "lint_totals": lambda s, sf: audit.report_totals(lint.checks(_one(s), _as_of())),
    "next_actions": lambda s, sf: audit.next_actions(lint.checks(_one(s), _as_of())),
    "health_report": lambda s, sf: lint.health(_one(s), _as_of()),
    "consolidation": lambda s, sf: lint.consolidation(_one(s)),
    "briefing": lambda s, sf: briefing.briefing(_one(s), _as_of()),
    "upgrade_plan": _versions,
    "upgrade_signals": lambda s, sf: briefing.upgrade_signals(_one(s)),
    "workspace_states": _states,
    "compression_pressure": _pressure,
    "registry_rows": lambda s, sf: parsers.registry(_text(s, "sources.md", REGISTRY)).drop("at"),
    "registry_edited": _registry_after,
    "registry_search": _federated,
    "registry_totals": lambda s, sf: search.totals(_federated(s, sf).filter("note = ''"), "name"),
    "search_local": lambda s, sf: search.capped(search.hit_lines(_one(s), "bed"), "folder", "rel", "line_no").select("folder", "rel", "line_no", "total"),
    "run_log_rows": _runs,
    "idempotent_write": _changed,
    "path_resolution": _paths,
    "field_split": _fields,
    "summary_lines": _summary_lines,
    "markers": lambda s, sf: files(s).select("corpus", "rel", marker("content", "managed").alias("managed"), marker("content", "closets").alias("closets"), marker("content", "summary-format-version").alias("format")).filter("coalesce(managed, closets, format) is not null"),
    "links_applied": lambda s, sf: links.applied(_one(s), links.mentions(_one(s))),
    "graph_check": lambda s, sf: graph.check_status(_one(s)),
    "graph_file": lambda s, sf: graph.graph_file(_one(s)),
    "report_lines": lambda s, sf: audit.report_lines(lint.checks(_one(s), _as_of())),
    "stale_texts": lambda s, sf: audit.stale_texts(_one(s)).select("rel"),
    "file_listing": lambda s, sf: lifecycle.listing(_one(s), 5),
    "live_entries": lambda s, sf: audit.without_dead_entries(parsers.facet_index(_one(s).filter(F.col("base").isin(*P.INDEX_FILES))).select(F.lower("stem").alias("key"), "field"), _one(s).select(F.col("stem_lc").alias("key"))),
    "summary_rules": lambda s, sf: audit.summary_rules(parsers.catalog(_one(s).filter(F.col("rel") == P.CATALOG_FILE)).select("link", "summary").unionByName(s.createDataFrame([("x", "Notes about things"), ("y", "z" * 251)], "link string, summary string"))).select("link", "too_long", "vague"),
    "summary_layers": lambda s, sf: lifecycle.summary_layers(parsers.catalog(_one(s).filter(F.col("rel") == P.CATALOG_FILE)), _one(s).filter("folder = 'beds' and base like '%s.md'").select(F.col("stem").alias("link"))),
    "facet_claims": _FACET("claims"), "facet_decisions": _FACET("decisions"), "facet_subjects": _FACET("subjects"), "facet_people_turns": _FACET("people"), "facet_dates_turns": _FACET("dates"),
    "facet_entry": lambda s, sf: fx.facets(_turns(s)).select("session_id", "entry"),
    "facet_long": lambda s, sf: fx.long_facets(fx.facets(_turns(s))),
}
QUERIES = {k: (lambda q: lambda spark, sf: q(configured(spark), sf))(v) for k, v in QUERIES.items()}

# --- the same in DuckDB ----------------------------------------------------


def quote(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, (bool, int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({columns})"


BASE = r"regexp_extract(rel, '[^/]*$')"


def named(rows: str) -> str:
    """(corpus, rel, content, mtime) rows with their names."""
    return f"""SELECT *, regexp_replace(base, '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_replace(base, '(.)\\.[^.]*$', '\\1')) AS stem_lc
    FROM (SELECT corpus, rel, content, mtime::TIMESTAMP AS mtime, {BASE} AS base, CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '/[^/]*$', '') ELSE '.' END AS folder FROM {rows})"""
LINK = r"\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]"


HEAD = r"^\s*##\s+\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]\s*$"
FIELD = r"^\s*-?\s*(subjects|people|claims|decisions|dates|status):\s*(.*)$"
KEYS = ", ".join(f"'{k}'" for k in P.EDGE_KEYS)
NOT_INDEX = "base NOT IN ('_CLOSETS.md', '_CLOSETS-archive.md')"
COMMENT = r"<!--\s*(?:[a-z]+-)?{}:([0-9.]+)"



def unlinked(text: str) -> str:
    for pattern in P.CODE:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return text


def lines_of(source: str, keep: str = "rel") -> str:
    return f"SELECT {keep}, generate_subscripts(a, 1)::INT AS line_no, unnest(a) AS line FROM (SELECT {keep}, string_split(content, chr(10)) AS a FROM ({source}))"


def fill(rows: str, value: str, name: str) -> str:
    return f"SELECT *, last_value({value} IGNORE NULLS) OVER (PARTITION BY rel ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {name} FROM ({rows})"


def hits(source: str, query: str) -> str:
    return f"SELECT corpus, rel, folder, line_no, line FROM ({lines_of(f'''SELECT * FROM ({source}) WHERE rel = '_MANIFEST.md' OR base IN ('_CLOSETS.md', '_CLOSETS-archive.md')''', 'corpus, rel, folder')}) WHERE line <> '' AND contains(lower(line), '{query}')"



def corpus_oracles(ALL: str, corpus: str, query: str, person: str, renames: dict[str, str]) -> dict[str, str]:
    """The queries over one corpus of the files that `ALL` selects, in SQL."""
    ONE = f"SELECT * FROM ({ALL}) WHERE corpus = '{corpus}'"
    MD = f"SELECT * FROM ({ONE}) WHERE rel LIKE '%.md'"
    cases = " ".join(f"WHEN {quote(old)} THEN {quote(new)}" for old, new in renames.items())
    LINKS = f"SELECT rel, generate_subscripts(a, 1) - 1 AS ordinal, trim(unnest(a)) AS target FROM (SELECT rel, regexp_extract_all({unlinked('content')}, '{LINK}', 1) AS a FROM ({MD}) WHERE {NOT_INDEX})"
    LINKS = f"SELECT rel, ordinal::INT AS ordinal, target FROM ({LINKS})"
    PATHS = f"SELECT lower(rel) AS k FROM ({ONE}) UNION SELECT regexp_replace(lower(rel), '([^/])\\.[^./]*$', '\\1') FROM ({ONE})"
    BROKEN = rf"""SELECT rel, ordinal, target FROM ({LINKS}) WHERE NOT (regexp_replace(lower(regexp_extract(target, '[^/]*$')), '\.md$', '') IN (SELECT stem_lc FROM ({ONE})) OR (contains(target, '/') AND (lower(target) IN ({PATHS}) OR lower(target) || '.md' IN ({PATHS}))))"""
    FM_LINES = f"""SELECT rel, stem, i, trim(l) AS line FROM (SELECT rel, stem, generate_subscripts(a, 1) AS i, unnest(a) AS l FROM (SELECT rel, stem, string_split(regexp_extract(content, '^---((?s:.*?))\\n---', 1), chr(10)) AS a FROM ({MD}) WHERE content LIKE '---%'))"""
    FM = f"""SELECT rel, stem, key, arg_max(value, i) AS value FROM (SELECT rel, stem, i, lower(trim(split_part(line, ':', 1))) AS key, regexp_replace(trim(substr(line, strpos(line, ':') + 1)), '^[''"](.*)[''"]$', '\\1') AS value FROM ({FM_LINES}) WHERE contains(line, ':') AND line NOT LIKE '#%') GROUP BY ALL"""
    NODES = f"SELECT stem, rel, coalesce(max(value) FILTER (key = 'type'), 'other') AS type, coalesce(max(value) FILTER (key = 'status'), '') AS status, coalesce(max(value) FILTER (key = 'date'), '') AS date FROM ({FM}) GROUP BY stem, rel"
    EDGES = f"SELECT source, type, (generate_subscripts(a, 1) - 1)::INT AS ordinal, trim(unnest(a)) AS target FROM (SELECT stem AS source, key AS type, regexp_extract_all(value, '{LINK}', 1) AS a FROM ({FM}) WHERE key IN ({KEYS}))"
    DANGLING = f"SELECT source, type, target FROM ({EDGES}) WHERE lower(target) NOT IN (SELECT stem_lc FROM ({MD}))"
    INDEXES = f"SELECT * FROM ({ALL}) WHERE base IN ('_CLOSETS.md', '_CLOSETS-archive.md')"
    INDEX_LINES = f"SELECT rel, regexp_replace(h, '(?i)\\.md$', '') AS stem, regexp_extract(line, '{FIELD}', 1) AS field, trim(regexp_extract(line, '{FIELD}', 2)) AS value FROM ({fill(lines_of(INDEXES), f'''CASE WHEN regexp_matches(line, '{HEAD}') THEN regexp_extract(line, '{HEAD}', 1) END''', 'h')}) WHERE h IS NOT NULL AND regexp_matches(line, '{FIELD}')"
    return {
        "duplicate_candidates": f"""WITH t AS (SELECT rel, list(target) AS ts FROM (SELECT rel, target, row_number() OVER (PARTITION BY rel ORDER BY count(*) DESC, target) AS k FROM ({LINKS}) GROUP BY rel, target) WHERE k <= 5 GROUP BY rel),
        p AS (SELECT a.rel AS a, b.rel AS b, 'links' AS r FROM t a JOIN t b ON a.rel < b.rel WHERE len(list_intersect(a.ts, b.ts))::DOUBLE / least(len(a.ts), len(b.ts)) >= 0.8 UNION ALL SELECT a.rel, b.rel, 'name' FROM ({ONE}) a JOIN ({ONE}) b ON a.rel < b.rel WHERE levenshtein(a.stem_lc, b.stem_lc) <= 2)
        SELECT a, b, string_agg(r, ',' ORDER BY r) AS reasons FROM p GROUP BY a, b""",
        "file_names": rf"SELECT corpus, rel, folder, base, stem, stem_lc, regexp_extract(base, '.(\.[^.]*)$', 1) AS ext, mtime::DATE::VARCHAR AS day FROM ({ALL})",
        "link_rows": LINKS,
        "broken_links": BROKEN,
        "index_issues": f"SELECT rel, 0 AS line_no, 'missing version marker' AS message FROM ({INDEXES}) WHERE NOT regexp_matches(content, '<!-- [a-z]+-closets:') UNION ALL SELECT rel, line_no, 'entry [[' || h || ']] points to a missing file' FROM (SELECT rel, line_no, regexp_extract(line, '{HEAD}', 1) AS h FROM ({lines_of(INDEXES)}) WHERE regexp_matches(line, '{HEAD}')) WHERE lower(h) NOT IN (SELECT stem_lc FROM ({ALL}))",
        "link_totals": f"""WITH b AS (SELECT count(*) AS n FROM ({BROKEN})), x AS (SELECT count(*) AS n FROM ({lines_of(f"SELECT * FROM ({INDEXES}) WHERE corpus = '{corpus}'")}) WHERE regexp_matches(line, '{HEAD}') AND lower(regexp_extract(line, '{HEAD}', 1)) NOT IN (SELECT stem_lc FROM ({ONE})))
        SELECT (SELECT count(*) FROM ({LINKS})) AS n_links, (SELECT count(DISTINCT target) FROM ({LINKS})) AS n_targets, (SELECT count(*) FROM ({ONE})) AS n_files, b.n AS n_broken, x.n + (SELECT count(*) FROM ({INDEXES}) WHERE corpus = '{corpus}' AND NOT regexp_matches(content, '<!-- [a-z]+-closets:')) AS n_issues, CASE WHEN b.n > 0 THEN 1 ELSE 0 END AS exit_status FROM b, x""",
        "link_targets_top": f"SELECT rel, target, n FROM (SELECT rel, target, count(*) AS n, row_number() OVER (PARTITION BY rel ORDER BY count(*) DESC, target) AS k FROM ({LINKS}) GROUP BY rel, target) WHERE k <= 5",
        "mention_suggest": f"""WITH s AS (SELECT DISTINCT stem_lc AS stem FROM ({ONE}) WHERE length(stem_lc) >= 3), p AS (SELECT stem, 0 AS v, stem AS pat FROM s UNION ALL SELECT stem, 1, replace(stem, '-', ' ') FROM s WHERE contains(stem, '-')),
        f AS (SELECT rel, stem_lc AS own, {unlinked("CASE WHEN content LIKE '---%' AND strpos(substr(content, 4), '---') > 0 THEN substr(content, strpos(substr(content, 4), '---') + 6) ELSE content END")} AS content FROM ({MD})),
        l AS (SELECT rel, own, line_no, regexp_replace(regexp_replace(regexp_replace(line, 'https?://\\S+', '', 'g'), '\\[\\[[^\\]]+\\]\\]', '', 'g'), '<!--.*?-->', '', 'g') AS line FROM ({lines_of('SELECT * FROM f', 'rel, own')})),
        h AS (SELECT rel, line_no, stem, v, regexp_extract(line, '(?i)\\b(' || regexp_escape(pat) || ')\\b', 1) AS text FROM l JOIN p ON stem <> own AND contains(lower(line), pat) AND regexp_matches(lower(line), '\\b' || regexp_escape(pat) || '\\b'))
        SELECT rel, line_no, arg_min(text, v) AS text, stem FROM h GROUP BY rel, line_no, stem""",
        "links_renamed": f"SELECT CASE target {cases} ELSE target END AS target, count(*) AS n FROM ({LINKS}) GROUP BY 1",
        "front_matter": f"SELECT rel, key, value FROM ({FM})",
        "graph_nodes": NODES,
        "graph_edges": EDGES,
        "graph_dangling": DANGLING,
        "graph_edge_counts": f"SELECT type, count(*) AS n FROM ({EDGES}) GROUP BY type",
        "graph_by_type": f"SELECT type, string_agg(stem, ',' ORDER BY stem) AS stems FROM ({NODES}) WHERE type <> '' GROUP BY type",
        "graph_by_status": f"SELECT status, string_agg(stem, ',' ORDER BY stem) AS stems FROM ({NODES}) WHERE status <> '' GROUP BY status",
        "graph_by_source": f"SELECT source, string_agg(e, ',' ORDER BY e) AS edges FROM (SELECT source, type || ' -> ' || target AS e FROM ({EDGES})) GROUP BY source",
        "graph_stats": f"SELECT (SELECT count(*) FROM ({MD})) AS total_files, (SELECT count(*) FROM ({NODES})) AS files_with_front_matter, (SELECT count(*) FROM ({EDGES})) AS total_edges, (SELECT count(*) FROM ({DANGLING})) AS dangling",
        "facet_index_lines": INDEX_LINES,
        "facet_field_hits": f"SELECT rel, stem FROM ({INDEX_LINES}) WHERE field = 'people' AND contains(lower(value), '{person}')",
        "search_local": f"SELECT folder, rel, line_no, total FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY rel, line_no) AS k, count(*) OVER (PARTITION BY folder) AS total FROM ({hits(ONE, query)})) WHERE k <= 20",
        "markers": f"""SELECT * FROM (SELECT corpus, rel, nullif(regexp_extract(content, '{COMMENT.format('managed')}', 1), '') AS managed, nullif(regexp_extract(content, '{COMMENT.format('closets')}', 1), '') AS closets, nullif(regexp_extract(content, '{COMMENT.format('summary-format-version')}', 1), '') AS format FROM ({ALL})) WHERE coalesce(managed, closets, format) IS NOT NULL""",
    }


ALL = named(values(FILES, "corpus, rel, content, mtime"))
ONE = f"SELECT * FROM ({ALL}) WHERE corpus = 'garden'"
DEC = r"^\s*(?:[-*]\s+)?(?:~~)?\*\*(\d{4}-\d{2}-\d{2})\*\*\s+[-–]\s+(.*)$"
GONE = r"\(superseded (\d{4}-\d{2}-\d{2})\)"
DECISIONS = f"""SELECT row_number() OVER (ORDER BY line_no)::INT AS ordinal, regexp_extract(line, '{DEC}', 1) AS date, trim(replace(regexp_replace(regexp_extract(line, '{DEC}', 2), '{GONE}', '', 'g'), '~~', '')) AS text, contains(line, '~~') AS struck, nullif(regexp_extract(line, '{GONE}', 1), '') AS superseded_on FROM ({lines_of(f"SELECT * FROM ({ONE}) WHERE base = 'decisions.md'")}) WHERE regexp_matches(line, '{DEC}')"""
REG = values([("sources.md", REGISTRY)], "rel, content")
REG_LINES = fill(lines_of(f"SELECT * FROM {REG}"), r"CASE WHEN regexp_matches(line, '^##\s+(\S+)\s*$') THEN regexp_extract(line, '^##\s+(\S+)\s*$', 1) END", "name")
PAIR = r"^-\s+(\w+)\s*:\s*(.+)$"
REGISTRY_ROWS = f"""SELECT name, coalesce(arg_max(v, line_no) FILTER (k = 'path'), '') AS path, coalesce(arg_max(v, line_no) FILTER (k = 'registered'), '') AS registered, coalesce(lower(arg_max(v, line_no) FILTER (k = 'searchable')) IN ('true', 'yes', '1'), true) AS searchable FROM (SELECT name, line_no, lower(regexp_extract(trim(line), '{PAIR}', 1)) AS k, trim(regexp_extract(trim(line), '{PAIR}', 2)) AS v FROM ({REG_LINES}) WHERE name IS NOT NULL) GROUP BY name"""


FEDERATED = f"SELECT name, rel, line_no, line, '' AS note FROM ({hits(ALL, 'ada')}) JOIN ({REGISTRY_ROWS}) ON corpus = name WHERE searchable UNION ALL SELECT name, '', 0, '', 'path missing' FROM ({REGISTRY_ROWS}) WHERE searchable AND name NOT IN (SELECT corpus FROM ({ALL}))"
T = values(TURNS, "session_id, turn, role, text")
TEXTS = f"SELECT session_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS u, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS a, string_agg(text, chr(10) ORDER BY turn) AS c FROM {T} GROUP BY session_id"


def families(text: str, patterns, trim: str, cap: int, name: str, clean: str = "{}", where: str = "true") -> str:
    """First occurrence of each phrase by (pattern, place)."""
    parts = " UNION ALL ".join(f"SELECT session_id, {k} AS f, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (SELECT session_id, regexp_extract_all({text}, {quote(p)}) AS a FROM ({TEXTS}))" for k, p in enumerate(patterns))
    phrase = clean.format(f"rtrim(trim(p, ' ' || chr(10) || chr(9)), '{trim}')")
    return f"""WITH e AS (SELECT session_id, f, i, {phrase} AS p FROM ({parts})), d AS (SELECT session_id, arg_min(p, (f, i)) AS p, min((f, i)) AS o FROM e WHERE {where} GROUP BY session_id, lower(p)), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS rn FROM d)
        SELECT t.session_id, coalesce(string_agg(p, '|' ORDER BY rn) FILTER (rn <= {cap}), '') AS {name} FROM ({TEXTS}) t LEFT JOIN r USING (session_id) GROUP BY t.session_id"""


from .retrieval import tok  # noqa: E402

OVER = f"""WITH d AS (SELECT *, list_distinct({tok('text')}) AS w FROM ({DECISIONS})) SELECT n.ordinal AS newer, o.ordinal AS older FROM d n JOIN d o ON o.ordinal < n.ordinal WHERE regexp_matches(n.text, '(?i)\\b({"|".join(P.OVERRIDES)})\\b') AND NOT o.struck AND len(list_intersect(n.w, o.w)) > 0 AND 2 * len(list_intersect(n.w, o.w)) >= len(n.w) + len(o.w) - len(list_intersect(n.w, o.w))"""
ORACLES = corpus_oracles(ALL, "garden", "bed", "ada", {"raised-bed": "tall-bed", "ada": "ada-l"}) | {
    "decision_rows": DECISIONS,
    "override_pairs": OVER,
    "decisions_annotated": f"WITH o AS ({OVER}), m AS (SELECT older, min(date) AS nd FROM o JOIN ({DECISIONS}) ON ordinal = newer GROUP BY older) SELECT ordinal, struck OR older IS NOT NULL AS struck, coalesce(superseded_on, nd) AS superseded_on FROM ({DECISIONS}) LEFT JOIN m ON ordinal = older",
    "redundant_pairs": f'SELECT a.ordinal AS "old", b.ordinal AS "new" FROM ({DECISIONS}) a JOIN ({DECISIONS}) b ON a.superseded_on = b.date AND b.ordinal > a.ordinal WHERE a.struck AND NOT b.struck',
    "decision_clusters": f"WITH d AS (SELECT ordinal AS k, date_trunc('week', date::DATE)::DATE::VARCHAR AS week, list_distinct({tok('text')}) AS w FROM ({DECISIONS})), p AS (SELECT DISTINCT a.week, a.k FROM d a JOIN d b ON a.week = b.week AND a.k <> b.k WHERE len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) >= 0.5) SELECT week, count(*) AS n FROM p GROUP BY week HAVING count(*) >= 3",
    "upgrade_plan": """WITH r AS (SELECT * FROM (VALUES ('a', [2, 1, 3], 2, 0, [1, 1], 0, true), ('b', [2, 0, 9], 1, 1, [1, 0], 2, false), ('c', NULL, NULL, 0, NULL, 0, false), ('d', [2, 1, 0], 2, 0, [1, 1], 4, false), ('e', [10, 0, 0], 2, 3, [1, 0], 0, true)) t(corpus, m, f, miss, i, l, mem)),
        s AS (SELECT corpus, list_filter([CASE WHEN coalesce(f, 0) < 2 THEN 'resummarize' END, CASE WHEN miss > 0 THEN 'reindex' END, CASE WHEN i < [1, 1] AND l > 0 THEN 'reindex --force' END, CASE WHEN NOT mem AND coalesce(m < [2, 1, 0], true) THEN 'reindex memory' END, CASE WHEN coalesce(m < [2, 1, 3], true) THEN 'marker' END], lambda x: x IS NOT NULL) AS steps FROM r)
        SELECT corpus, generate_subscripts(steps, 1)::INT AS ordinal, unnest(steps) AS step FROM s""",
    "workspace_states": "SELECT * FROM (VALUES ('a', 'empty'), ('b', 'files'), ('c', 'compatible'), ('d', 'old'), ('e', 'current'), ('f', 'current')) t(name, state)",
    "compression_pressure": "SELECT r AS n_lines, CASE WHEN r < 60 THEN 'skip' WHEN r >= 95 THEN 'warn' ELSE 'compress' END AS action FROM range(55, 103) t(r)",
    "registry_rows": REGISTRY_ROWS,
    "registry_edited": f"SELECT name, path, registered, searchable OR name = 'cellar' AS searchable FROM ({REGISTRY_ROWS}) WHERE name <> 'attic' UNION ALL SELECT 'loft', '/srv/loft', '2026-02-01', true",
    "registry_search": FEDERATED,
    "registry_totals": f"SELECT count(*) AS total_hits, count(DISTINCT name) AS n_groups FROM ({FEDERATED}) WHERE note = ''",
    "path_resolution": "SELECT name, arg_min(path, (priority, path)) AS path, min(priority) AS priority FROM (VALUES ('status', 'cfg/status.md', 1), ('status', 'memory/status.md', 2), ('log', 'memory/log.md', 2), ('ideas', 'x/ideas.md', 3), ('log', 'b/log.md', 3), ('ideas', 'a/ideas.md', 3)) t(name, path, priority) GROUP BY name",
    "facet_claims": families("u", P.CLAIMS, ".,!?", 6, "claims"),
    "facet_decisions": families("a || chr(10) || u", P.DECISIONS, ".,!?", 4, "decisions"),
    "facet_dates_turns": families("u || chr(10) || a", P.DATES, ".,!?;:", 10, "dates", r"regexp_replace({}, '\s+', ' ', 'g')", "length(p) >= 3"),
}

#: What the corpus above must give, worked out by hand from its text.
EXPECTED = {
    "catalog_rows": ("section, tier, link, summary, head_kind, folder", [("Hub Map", None, "beds/_CLOSETS", "vegetable beds", "closets", "beds"), ("Hub Map", None, "tools-index", "what we own", "index", "tools"), ("Tier 1 - Always", 1, "glossary", "words", "file", None), ("Tier 1 - Always", 1, "status", "where things stand", "file", None), ("Tier 3 - Archive", 3, "old-plan", "replaced", "file", None)]),
    "session_log_entries": ("ordinal, date, title, bullets", [(1, "2026-02-12", "soil day", "moved soil, seed order still open|plan in [[raised-bed]]"), (2, "2026-02-08", "order", "seed order sent again"), (3, "2026-02-01", "start", "seed order drafted|tools counted")]),
    "status_sections": ("last_updated, section, ordinal, text", [("2026-02-10", "Blocked", 1, "seed order"), ("2026-02-10", "Blocked", 2, "water pump"), ("2026-02-10", "In Progress", 1, "[[raised-bed]] needs soil")]),
    "idea_routes": ("title, date, body, collection", [("Bee hotel", "2026-02-11", "A box for wild bees near the beds.", "beds"), ("Night light", "2026-02-12", "Solar lamps.", "unrouted")]),
    "lint_report": ('"check", severity, subject, detail', [("blockers", "WARN", "seed order", "3 entries"), ("catalog", "INFO", "old-plan", "no file"), ("catalog", "WARN", "tools-index", "no file"), ("coverage", "WARN", "tools", "no index"), ("decisions", "WARN", "1", "superseded by 4"), ("freshness", "WARN", "memory/status.md", "10 days"), ("orphan_files", "INFO", "beds/lost-bed", "no file"), ("orphan_files", "WARN", "beds/herb-spiral.v2", "not registered"), ("orphan_files", "WARN", "beds/herb-spirals", "not registered"), ("orphan_files", "WARN", "tools/rake", "not registered"), ("orphan_folders", "WARN", "compost", "3 files"), ("orphan_folders", "WARN", "people", "2 files"), ("summary_format", "WARN", "_MANIFEST.md", "1"), ("typed_edges", "WARN", "herb-spiral.v2", "supersedes old-plan"), ("typed_edges", "WARN", "rake", "blocked-by shed")]),
    "lint_totals": ("warnings, infos, checks", [(13, 2, 9)]),
    "next_actions": ('"check", action', [*audit.ACTIONS, ("upgrade", "upgrade, which does both in order")]),
    "upgrade_signals": ("corpus, managed, summary_format, n_missing, index_format, n_large, memory_index", [("garden", "2.0.1", 1, 1, "1.0", 0, False)]),
    "run_log_rows": ("ts, line, status", [("2026-02-01 10:00:00", "2026-02-01T10:00:00  contradictions=1 dedup=3 orphans=0  status=ok", "ok"), ("2026-02-03 11:30:00", "2026-02-03T11:30:00  files=14 hubs=2 refreshed=5 skipped=9  status=partial", "partial")]),
    "idempotent_write": ("rel", [("b",), ("c",)]),
    "field_split": ("id, fields, clean", [(1, "subjects: a; b#people: c#| dates: d", "subjects: a; b | people: c |  | dates: d"), (2, "plain", "plain"), (3, "", ""), (4, "a|b", "a|b"), (5, "Summary: - x", "x"), (6, "One-line summary:  y", "y")]),
    "summary_lines": ("line", [("| closets:emax | 100.0% | 0.0% |",), ("| content:bm25 | 50.0% | 93.8% |",)]),
    "facet_subjects": ("session_id, subjects", [(1, "I am a teacher in Lisbon|- buy oat milk\n- call Anna Maria Lopez\nI prefer tea|green tea set|buy oat milk|call Anna Maria Lopez"), (2, "I used to live in Oslo|Call Anna on 2024-03-05 or 3/5/24|Travel Plan"), (3, "")]),
    "facet_people_turns": ("session_id, people", [(1, "Mike|Lisbon|Meet|Anna Maria Lopez|Noted"), (2, "Oslo|Rex|Call Anna|Travel Plan\nSwitched"), (3, "Hello")]),
    "links_applied": ("rel, line_no, before, after", [("beds/raised-bed.md", 15, "The old plan of ada mentions the herb spiral too.", "The old plan of [[ada]] mentions the herb spiral too."), ("people/ada.md", 4, "Ada keeps the raised bed.", "Ada keeps the [[raised-bed]].")]),
    "graph_check": ("dangling, exit_status", [(2, 1)]),
    "stale_texts": ("rel", [("memory/decisions.md",)]),
    "file_listing": ("rel", [("_MANIFEST.md",), ("beds/_CLOSETS.md",), ("beds/herb-spiral.v2.md",), ("beds/herb-spirals.md",), ("beds/raised-bed.md",)]),
    "live_entries": ("key, field", [("raised-bed", "subjects"), ("raised-bed", "people"), ("raised-bed", "dates")]),
    "summary_rules": ("link, too_long, vague", [("status", False, False), ("glossary", False, False), ("old-plan", False, False), ("beds/_CLOSETS", False, False), ("tools-index", False, False), ("x", False, True), ("y", True, False)]),
    "summary_layers": ("layer, link", [(1, "status"), (1, "glossary"), (2, "beds/_CLOSETS"), (2, "tools-index"), (3, "herb-spirals")]),
    "briefing": ("part, ordinal, line", [("1 status", 1, "Last updated 2026-02-10"), ("2 stale", 1, "10 days old"), ("3 last session", 1, "moved soil, seed order still open"), ("3 last session", 2, "plan in [[raised-bed]]"), ("4 in progress", 1, "[[raised-bed]] needs soil"), ("5 blocked", 1, "seed order"), ("5 blocked", 2, "water pump"), ("6 decisions", 1, "2026-02-04 - north bed gets compost"), ("6 decisions", 2, "2026-02-03 - north bed gets clover"), ("6 decisions", 3, "2026-02-02 - drip hose replaces water by hand for the north bed"), ("6 decisions", 4, "2026-01-20 - clay pots instead of plastic pots"), ("6 decisions", 5, "2026-01-06 - buy plastic pots"), ("7 ideas", 1, "Bee hotel -> beds"), ("7 ideas", 1, "Night light"), ("8 notices", 1, "files changed after the last status update"), ("8 notices", 2, "no index: tools")]),
}
_BROKEN = [("broken_link", "WARN", "_MANIFEST.md", "old-plan"), ("broken_link", "WARN", "_MANIFEST.md", "tools-index"), ("broken_link", "WARN", "beds/herb-spiral.v2.md", "old-plan"), ("broken_link", "WARN", "beds/raised-bed.md", "missing-note"), ("broken_link", "WARN", "tools/rake.md", "shed")]
_NAMES = [("a", "b"), ("a", "c"), ("b", "c")]
_COLUMNS, _LINT = EXPECTED["lint_report"]
EXPECTED |= {
    "health_report": (_COLUMNS, [*_LINT, *_BROKEN, ("untracked", "INFO", "compost", "3 files"), ("untracked", "INFO", "memory", "4 files")]),
    "consolidation": (_COLUMNS, [*_BROKEN, ("cluster", "INFO", "2026-02-02", "3"), ("contradiction", "WARN", "1", "4"), ("redundant", "INFO", "2", "3"), ("duplicate", "INFO", "beds/herb-spiral.v2.md", "beds/herb-spirals.md links"), *[("duplicate", "INFO", f"compost/{a}.md", f"compost/{b}.md name") for a, b in _NAMES], ("duplicate", "INFO", "compost/a.md", "people/ada.md name"), *[("duplicate", "INFO", f"compost/{a}.md", "people/bo.md name") for a in "abc"]]),
    "graph_report": ("ordinal, line", list(enumerate(["Stats: 5 files with front matter out of 16 markdown files. 5 typed edges.", "| `people` | 2 |", "| `blocked-by` | 1 |", "| `blocks` | 1 |", "| `supersedes` | 1 |", "### other: [[bo]]", "### person: [[ada]]", "### project: [[herb-spiral.v2]], [[raised-bed]]", "### tool: [[rake]]", "### active: [[raised-bed]]", "### done: [[herb-spiral.v2]]", "- [[herb-spiral.v2]] `supersedes` → [[old-plan]]", "- [[raised-bed]] `blocks` → [[herb-spiral.v2]]", "- [[raised-bed]] `people` → [[ada]]", "- [[raised-bed]] `people` → [[bo]]", "- [[rake]] `blocked-by` → [[shed]]", "- [[herb-spiral.v2]] `supersedes` → [[old-plan]] (missing)", "- [[rake]] `blocked-by` → [[shed]] (missing)"], 1))),
}
EXPECTED["facet_entry"] = ("session_id, entry", [
    (1, "subjects: I am a teacher in Lisbon; - buy oat milk\n- call Anna Maria Lopez\nI prefer tea; green tea set; buy oat milk; call Anna Maria Lopez | people: Mike, Lisbon, Meet, Anna Maria Lopez, Noted | claims: I am a teacher in Lisbon; I have 3 cats and 2 kids; I prefer tea; 3 cats; 2 kids | decisions: I chose oolong over sencha because of June 12; I'll try running tomorrow at 3:30pm; oolong over sencha because of June | dates: June 12; Tuesday; tomorrow; 3:30pm"),
    (2, "subjects: I used to live in Oslo; Call Anna on 2024-03-05 or 3/5/24; Travel Plan | people: Oslo, Rex, Call Anna, Travel Plan\nSwitched | claims: I am allergic to nuts; I used to live in Oslo; I was born in 1987; My dog's name was Rex; allergic to nuts; I can't eat nuts | decisions: Switched to trains from planes, 2 weeks ago; won't fly in May | dates: May; 1987; 2024; 2 weeks ago; 3/5/24; 2024-03-05"),
    (3, "people: Hello | dates: today"),
])
EXPECTED["graph_file"] = ("rel, content", [("memory/.graph.md", "\n".join(line for _, line in sorted(EXPECTED["graph_report"][1])))])
EXPECTED["report_lines"] = ('"check", "ordinal", line', [(c, 1 + sum(x[0] == c for x in sorted(_LINT, key=lambda x: (x[0], x[1], x[2]))[:k]), f"  [{s}] {u} -- {d}") for k, (c, s, u, d) in enumerate(sorted(_LINT, key=lambda x: (x[0], x[1], x[2])))])
ORACLES |= {k: f"SELECT * FROM {values(rows, columns)}" for k, (columns, rows) in EXPECTED.items()}
