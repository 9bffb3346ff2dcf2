"""The corpus queries over a vault as large as the tables: one note a document, one person a supplier, an index a folder.

Notes have front matter, links that resolve, links that don't, code that must
not count, names in plain text, and the document's whole text.  An index file
holds its folder's first page.  The SQL twin builds the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import marker
from ..operators import facet_index, graph, links, search
from ..session import configured, table
from ..sources import parsers
from ..sources.markdown import index_files, with_names
from .corpora import KEYS, LINK, corpus_oracles, hits, named

SKIPPED, SCANNED = "src1", "src2"
PERSON, QUERY, RENAMES = "person-3", "note-2", {"person-1": "person-one", "note-5": "note-five"}
START = 1_704_067_200


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def vault(spark: SparkSession, sf: str) -> DataFrame:
    """(corpus, rel, content, mtime) with names."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("folder"), F.coalesce("lang", F.lit("text")).alias("lang"))
    status = F.when(k % 3 == 0, "active").when(k % 3 == 1, "done").otherwise("")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 365).cast("int"))
    head = _text("---\ntype: ", F.col("lang"), "\nstatus: ", status, "\ndate: ", day, "\npeople: [[person-", k % 40, "]], [[Person-", k % 7, "|lead]]\nblocks: [[note-", k * 7 + 3, "]]\n---\n# Note ", k)
    body = _text("\n\nSee [[note-", k + 1, "]], [[", F.col("folder"), "/note-", k, "|itself]] and [[note-", k, ".md]].\nPerson-", k % 40, " wrote of note ", k % 9, ".\n```\n[[not-a-link]]\n```\n", F.coalesce("text", F.lit("")), "\n")
    notes = d.select(_text(F.col("folder"), "/note-", k, ".md").alias("rel"), F.concat(head, body).alias("content"), F.timestamp_seconds(START + 60 * k).alias("mtime"))
    s = table(spark, sf, "supplier")
    people = s.select(_text("people/person-", F.col("s_suppkey"), ".md").alias("rel"), _text("---\ntype: person\n---\n", F.col("s_name"), "\n").alias("content"), F.timestamp_seconds(F.lit(START)).alias("mtime"))
    page = d.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("doc_id"))).filter(F.col("place") <= facet_index.PRIMARY)
    entry = _text("\n\n## [[note-", k, "]]\n- subjects: ", F.col("lang"), "\n- people: [[person-", k % 40, "]]")
    pages = page.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]), "").alias("entries"))
    mark = F.when(F.col("folder").endswith("0"), "# Index").otherwise("<!-- x-closets:1.1 -->")
    indexes = pages.select(_text(F.col("folder"), "/_CLOSETS.md").alias("rel"), _text(mark, F.col("entries"), "\n\n## [[gone-note]]\n- subjects: none\n").alias("content"), F.timestamp_seconds(F.lit(START)).alias("mtime"))
    return with_names(notes.union(people).union(indexes).select(F.lit("vault").alias("corpus"), "rel", "content", "mtime"))


def _indexed(v: DataFrame) -> DataFrame:
    return parsers.facet_index(v.filter(F.col("base").isin(*P.INDEX_FILES)))


QUERIES = {
    "file_names": lambda v: v.select("corpus", "rel", "folder", "base", "stem", "stem_lc", "ext", F.col("mtime").cast("date").cast("string").alias("day")),
    "link_rows": lambda v: links.link_rows(v),
    "broken_links": lambda v: links.broken_links(v),
    "index_issues": lambda v: links.index_issues(v),
    "link_totals": lambda v: links.link_totals(v),
    "link_targets_top": lambda v: links.top_targets(links.link_rows(v)).select("rel", "target", "n"),
    "mention_suggest": lambda v: links.mentions(v).select("rel", "line_no", "text", "stem"),
    "links_renamed": lambda v: links.link_rows(links.renamed(v, RENAMES)).groupBy("target").agg(F.count("*").alias("n")),
    "front_matter": lambda v: parsers.front_matter_fields(v),
    "graph_nodes": lambda v: graph.nodes(v),
    "graph_edges": lambda v: graph.edges(v).select("source", "type", "ordinal", "target"),
    "graph_dangling": lambda v: graph.dangling(graph.edges(v), v).select("source", "type", "target"),
    "graph_edge_counts": lambda v: graph.edge_counts(graph.edges(v)),
    "graph_by_type": lambda v: graph.stems_by(graph.nodes(v), "type").select("type", F.array_join("stems", ",").alias("stems")),
    "graph_by_status": lambda v: graph.stems_by(graph.nodes(v), "status").select("status", F.array_join("stems", ",").alias("stems")),
    "graph_by_source": lambda v: graph.edges_by_source(graph.edges(v)).select("source", F.array_join("edges", ",").alias("edges")),
    "graph_stats": lambda v: graph.stats(v),
    "facet_index_lines": lambda v: _indexed(v).select("rel", "stem", "field", "value"),
    "facet_field_hits": lambda v: facet_index.field_hits(_indexed(v), "people", PERSON).select("rel", "stem"),
    "search_local": lambda v: search.capped(search.hit_lines(v, QUERY), "folder", "rel", "line_no").select("folder", "rel", "line_no", "total"),
    "markers": lambda v: v.select("corpus", "rel", marker("content", "managed").alias("managed"), marker("content", "closets").alias("closets"), marker("content", "summary-format-version").alias("format")).filter("coalesce(managed, closets, format) is not null"),
    "names": lambda v: links.known_names(v).select("key"),
    "front_matter_map": lambda v: parsers.front_matter_map(v).select("rel", F.size("scalars").alias("n_scalars"), F.aggregate(F.map_values("link_lists"), F.lit(0), lambda n, x: n + F.size(x)).alias("n_links")),
    "links_scoped": lambda v: links.link_rows(v, (SKIPPED,)),
    "mentions_scoped": lambda v: links.mentions(v, v.filter(F.col("folder") == SCANNED), ()).select("rel", "line_no", "text", "stem"),
    "search_labels": lambda v: search.follow_up(search.hit_lines(v, QUERY)),
    "graph_report": lambda v: graph.report(v),
    "graph_check": lambda v: graph.check_status(v),
    "graph_file": lambda v: graph.graph_file(v).select("rel", F.sha2("content", 256).alias("content_sha256")),
    "index_selection": lambda v: index_files(v).select("rel"),
}
NAMES = {f"vault_{k}": k for k in QUERIES}
QUERIES = {name: (lambda q: lambda spark, sf: q(vault(configured(spark), sf)))(QUERIES[k]) for name, k in NAMES.items()}

# --- the same in DuckDB ----------------------------------------------------

_FILES = """(
    WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS text, coalesce(source, 'none') AS folder, coalesce(lang, 'text') AS lang FROM documents),
    e AS (SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY k) AS place, format(E'\\n\\n## [[note-{}]]\\n- subjects: {}\\n- people: [[person-{}]]', k, lang, k % 40) AS entry FROM d)
    SELECT 'vault' AS corpus, * FROM (
        SELECT format('{}/note-{}.md', folder, k) AS rel,
            format(E'---\\ntype: {}\\nstatus: {}\\ndate: {}\\npeople: [[person-{}]], [[Person-{}|lead]]\\nblocks: [[note-{}]]\\n---\\n# Note {}', lang, CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'done' ELSE '' END, (DATE '2024-01-01' + (k % 365)::INT)::VARCHAR, k % 40, k % 7, k * 7 + 3, k)
            || format(E'\\n\\nSee [[note-{}]], [[{}/note-{}|itself]] and [[note-{}.md]].\\nPerson-{} wrote of note {}.\\n```\\n[[not-a-link]]\\n```\\n', k + 1, folder, k, k, k % 40, k % 9) || text || chr(10) AS content,
            TIMESTAMP '2024-01-01 00:00:00' + to_seconds(60 * k) AS mtime FROM d
        UNION ALL SELECT format('people/person-{}.md', s_suppkey), format(E'---\\ntype: person\\n---\\n{}\\n', s_name), TIMESTAMP '2024-01-01 00:00:00' FROM supplier
        UNION ALL SELECT folder || '/_CLOSETS.md', CASE WHEN folder LIKE '%0' THEN '# Index' ELSE '<!-- x-closets:1.1 -->' END || string_agg(entry, '' ORDER BY place) || E'\\n\\n## [[gone-note]]\\n- subjects: none\\n', TIMESTAMP '2024-01-01 00:00:00' FROM e WHERE place <= 30 GROUP BY folder))"""

_ALL = named(_FILES)
_SQL = corpus_oracles(_ALL, "vault", QUERY, PERSON, RENAMES)
_N, _E, _D = (_SQL[k] for k in ("graph_nodes", "graph_edges", "graph_dangling"))
_HITS = hits(_ALL, QUERY)


def _grouped(key: str, part: int) -> str:
    return f"SELECT {part}, {key}, 0, '### ' || {key} || ': ' || string_agg('[[' || stem || ']]', ', ' ORDER BY stem) FROM ({_N}) WHERE {key} <> '' GROUP BY {key}"


_SQL |= {
    "names": f"SELECT stem_lc AS key FROM ({_ALL}) UNION SELECT lower(rel) FROM ({_ALL}) UNION SELECT regexp_replace(lower(rel), '([^/])\\.[^./]*$', '\\1') FROM ({_ALL})",
    "front_matter_map": f"SELECT rel, count(*) FILTER (key NOT IN ({KEYS}))::INT AS n_scalars, coalesce(sum(len(regexp_extract_all(value, '{LINK}', 1))) FILTER (key IN ({KEYS})), 0)::INT AS n_links FROM ({_SQL['front_matter']}) GROUP BY rel",
    "links_scoped": f"SELECT * FROM ({_SQL['link_rows']}) WHERE rel NOT LIKE '{SKIPPED}/%'",
    "mentions_scoped": f"SELECT * FROM ({_SQL['mention_suggest']}) WHERE rel LIKE '{SCANNED}/%'",
    "search_labels": f"SELECT count(DISTINCT folder) > 1 AS multi_folder, coalesce(bool_and(rel LIKE '%-archive.md'), false) AS archive_only, coalesce(bool_and(folder = 'memory'), false) AS memory_only FROM ({_HITS})",
    "graph_report": f"""SELECT row_number() OVER (ORDER BY part, k, i, line)::INT AS ordinal, line FROM (
        SELECT 1 AS part, '' AS k, 0 AS i, format('Stats: {{}} files with front matter out of {{}} markdown files. {{}} typed edges.', files_with_front_matter, total_files, total_edges) AS line FROM ({_SQL['graph_stats']})
        UNION ALL SELECT 2, '', -n, format('| `{{}}` | {{}} |', type, n) FROM ({_SQL['graph_edge_counts']}) UNION ALL {_grouped('type', 3)} UNION ALL {_grouped('status', 4)}
        UNION ALL SELECT 5, source, ordinal, format('- [[{{}}]] `{{}}` → [[{{}}]]', source, type, target) FROM ({_E})
        UNION ALL SELECT 6, source, ordinal, format('- [[{{}}]] `{{}}` → [[{{}}]] (missing)', source, type, target) FROM ({_E}) WHERE (source, type, target) IN (SELECT (source, type, target) FROM ({_D})))""",
    "graph_check": f"SELECT count(*) AS dangling, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_status FROM ({_D})",
    "index_selection": f"SELECT rel FROM ({_ALL}) WHERE rel = '_MANIFEST.md' OR base IN ('_CLOSETS.md', '_CLOSETS-archive.md')",
}
_SQL["graph_file"] = f"SELECT 'memory/.graph.md' AS rel, sha256(string_agg(line, chr(10) ORDER BY ordinal)) AS content_sha256 FROM ({_SQL['graph_report']})"
ORACLES = {name: _SQL[k] for name, k in NAMES.items()}
