"""Reading trees and datasets, writers, and the plans that keep a corpus, over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facets as fx
from ..functions import patterns as P
from ..functions.text import has_placeholder, slug
from ..operators import audit, chains, facet_index, graph, lifecycle, trigrams
from ..plans import briefing, closing
from ..session import configured, shared_path, table
from ..sources import parsers, sinks
from ..sources.markdown import read_corpus
from ..sources.sections import read_sections
from .corpora import named
from .vault import _FILES, vault
from .vault import ORACLES as VAULT

AS_OF = "2024-02-01"
PRIMARY = 30


#: What `indexed_search` asks: literals common and rare, one too short for the index, and expressions.
SEARCHES = (("note-17", "literal"), ("PERSON-3 wrote of note 4", "literal"), ("q7", "literal"), (r"person-1\d wrote of note [0-4]\.", "regex"), (r"^# note \d*77$|(gone|lost)-note", "regex"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")


def workspace_files(spark: SparkSession, sf: str) -> DataFrame:
    """SC1-SC3, SC13: the vault written as a tree of files, and read back without one folder; dates are those of the writing."""
    path = shared_path(spark, "workspace")
    sinks.write_texts(vault(spark, sf), path)
    return read_corpus(spark, path, corpus="vault", suffix=".md", skip=("src1",)).select("corpus", "rel", "folder", "stem", "content", (F.col("mtime") > F.current_timestamp() - F.expr("interval 1 day")).alias("dated"))


def _dataset(spark: SparkSession, sf: str) -> str:
    """Benchmark files: a question for every ten conversations, with their turns nested; every other file is one array, the rest JSON lines."""
    turn = F.sort_array(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("t"))))
    s = _turns(spark, sf).groupBy("session_id").agg(F.transform(turn, lambda x: x["t"]).alias("turns")).withColumn("q", F.expr("session_id div 10"))
    both = F.sort_array(F.collect_list(F.struct("session_id", "turns")))
    rows = s.groupBy("q").agg(both.alias("b")).select(F.col("q").cast("string").alias("question_id"), F.lit("t").alias("question_type"), F.lit("?").alias("question"), F.transform("b", lambda x: x["session_id"].cast("string")).alias("haystack_session_ids"), F.transform("b", lambda x: x["turns"]).alias("haystack_sessions"), F.slice(F.transform("b", lambda x: x["session_id"].cast("string")), 1, 1).alias("answer_session_ids"))
    file = F.expr("cast(question_id as bigint) div 8")
    texts = rows.groupBy(file.alias("file")).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*rows.columns)))).alias("values"))
    content = F.when(F.col("file") % 2 == 0, F.concat(F.lit("["), F.array_join("values", ", "), F.lit("]"))).otherwise(F.array_join("values", "\n"))
    path = shared_path(spark, "dataset")
    sinks.write_texts(texts.select(F.concat(F.lit("part-"), F.col("file").cast("string"), F.lit(".json")).alias("rel"), content.alias("content")), path)
    return path


def dataset_turns(spark: SparkSession, sf: str) -> DataFrame:
    """SC10, SC11, J6: the turns of a nested JSON dataset, read in ranges smaller than its files."""
    return parsers.candidate_turns(parsers.questions(spark, _dataset(spark, sf), range_bytes=1 << 18)).select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text")


def cached_texts(spark: SparkSession, sf: str) -> DataFrame:
    """SC12, SK5: texts appended to a cache in two goes, and read back."""
    path = shared_path(spark, "cache")
    if parsers.cache(spark, path).count():
        raise RuntimeError("an absent cache is empty")
    texts = fx.extracted(_turns(spark, sf), "content").select(F.col("session_id").cast("string").alias("session_id"), "text")
    for half in (0, 1):
        sinks.write_cache(texts.filter(F.pmod(F.col("session_id").cast("long"), F.lit(2)) == half), path)
    return parsers.cache(spark, path)


def cache_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """SC12, SK5, ST7: a cache filled in steps by a run that breaks off at its third, and by the run after it."""
    path, turns, done = shared_path(spark, "cache"), _turns(spark, sf).withColumn("session_id", F.col("session_id").cast("string")), []

    def extract(rows: DataFrame) -> DataFrame:
        if len(done) == 2:
            done.append(0)
            raise InterruptedError
        done.append(1)
        return fx.extracted(rows, "content").select("session_id", "text")

    every = max(1, turns.select("session_id").distinct().count() // 4)
    try:
        sinks.fill_cache(turns, path, extract, every=every)
    except InterruptedError:
        sinks.fill_cache(turns, path, extract, every=every)
    return parsers.cache(spark, path)


def extracted_texts(spark: SparkSession, sf: str) -> DataFrame:
    """EX1-EX4: (extractor, sessions with a text, characters); the summaries of a supplied table for the odd sessions only."""
    turns = _turns(spark, sf)
    supplied = turns.filter("session_id % 2 = 1").groupBy("session_id").agg(F.concat(F.lit("session "), F.first("session_id").cast("string")).alias("text"))
    out = None
    for name in ("content", "summary", "firstmsg", "haiku"):
        rows = fx.extracted(turns, name, supplied if name == "haiku" else None).agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("n_chars")).select(F.lit(name).alias("extractor"), "n", "n_chars")
        out = rows if out is None else out.unionByName(rows)
    return out


def _index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as entries, a collection for each customer nation."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    e = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("collection"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("stem"), F.col("o_orderdate").alias("mtime"), F.array(F.col("o_orderstatus")).alias("subjects"), F.array(F.col("o_custkey").cast("string"), F.lit("clerk")).alias("people"))
    empty = F.array().cast("array<string>")
    return facet_index.paginated(e).withColumns({"claims": empty, "decisions": empty, "dates": F.array(F.date_format("mtime", "yyyy-MM-dd"))})


def index_texts(spark: SparkSession, sf: str) -> DataFrame:
    """SK6: rendered index files."""
    return facet_index.rendered(_index_rows(spark, sf)).select("collection", "is_archive", F.sha2("content", 256).alias("content_sha256"))


def index_files_written(spark: SparkSession, sf: str) -> DataFrame:
    """SK6: the same index files written entry by entry, and read back from the tree."""
    path = shared_path(spark, "indexes")
    sinks.write_pieces(facet_index.rendered_pieces(_index_rows(spark, sf)), path, "place", between="\n\n")
    files = read_corpus(spark, path)
    return files.select(F.col("folder").cast("long").alias("collection"), (F.col("base") == P.INDEX_FILES[1]).alias("is_archive"), F.sha2("content", 256).alias("content_sha256"))


def graph_file_written(spark: SparkSession, sf: str) -> DataFrame:
    """SK1, SK2: the graph report of the vault written line by line, and its lines as they are in the file."""
    path = shared_path(spark, "graph")
    report = graph.report(vault(spark, sf)).select(F.lit("memory/.graph.md").alias("rel"), "ordinal", F.col("line").alias("content"))
    sinks.write_pieces(report, path, "ordinal")
    return parsers.lines(read_corpus(spark, path), "rel").select(F.col("line_no").cast("int").alias("ordinal"), "line")


def registry_written(spark: SparkSession, sf: str) -> DataFrame:
    """SK3, SC5: all customers as sources of a registry, the file written block by block and parsed again by its sections."""
    c = table(spark, sf, "customer").select(F.regexp_replace("c_name", "[^A-Za-z0-9]+", "-").alias("name"), F.concat(F.lit("/srv/"), F.col("c_custkey").cast("string")).alias("path"), F.lit(AS_OF).alias("registered"), (F.col("c_custkey") % 3 > 0).alias("searchable"))
    path = shared_path(spark, "registry")
    sinks.write_pieces(sinks.registry_pieces(c), path, "name", between="\n\n")
    return parsers.registry(read_sections(spark, path)).select("name", "path", "registered", "searchable")


def reindexed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """PR13: the entries that the index files of all conversations have, in their order."""
    files = _reindexed(spark, sf)
    heads = F.regexp_extract_all("content", F.lit(r"(?m)^## \[\[(s-[0-9]+)\]\]$"), F.lit(1))
    return files.select("collection", "is_archive", F.posexplode(heads).alias("at", "stem")).select("collection", "is_archive", F.col("at").cast("long").alias("at"), "stem")


def session_end_rows(spark: SparkSession, sf: str) -> DataFrame:
    """PR6: (step, key, value): the rows that closing a session writes or reports, not their number."""
    made, _ = _closing(spark, sf)
    row = lambda df, step, key, value: df.select(F.lit(step).alias("step"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    parts = [
        row(made.status, "1 status", F.col("rel"), F.col("content")),
        row(made.log, "2 log", F.col("ordinal"), F.concat_ws(" ", "text", F.when(F.col("archived"), "archived").otherwise("kept"))),
        row(made.decisions, "4 decisions", F.col("ordinal"), F.concat_ws(" ", F.col("date").cast("string"), "text")),
        row(made.refreshed.filter("refresh"), "5 index", F.concat_ws("/", "collection", "stem"), F.lit("refreshed")),
        row(made.due.filter("due"), "7 due", F.col("op"), F.col("days")),
    ]
    return reduce(DataFrame.unionByName, parts)


def log_prepended(spark: SparkSession, sf: str) -> DataFrame:
    """SK8: a new entry on top of a log of all events."""
    log = table(spark, sf, "events").select((F.col("event_id") + 1).cast("int").alias("ordinal"), F.col("event_type").alias("text"))
    entry = spark.createDataFrame([(1, "closed")], "ordinal int, text string")
    return lifecycle.prepended(log, entry)


def decisions_appended(spark: SparkSession, sf: str) -> DataFrame:
    """SK8: two new decisions after all orders."""
    d = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("ordinal"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("text"))
    new = spark.createDataFrame([("2030-01-02", "later"), ("2030-01-01", "sooner")], "date string, text string").withColumn("date", F.to_date("date"))
    return lifecycle.appended(d, new).select("ordinal", F.col("date").cast("string").alias("date"), "text")


def ideas_captured(spark: SparkSession, sf: str) -> DataFrame:
    """PR8, J22: parts as ideas with one more, routed to the collection that names it, else to the first collection whose name the words have."""
    ideas = table(spark, sf, "part").select(F.concat(F.lit("Idea "), F.col("p_partkey").cast("string")).alias("title"), F.lit("2024-01-01").cast("date").alias("date"), F.concat_ws(" ", "p_name", "p_type").alias("body"), F.lit(None).cast("string").alias("route"))
    hubs = table(spark, sf, "part").select(F.lower(F.substring_index("p_type", " ", -1)).alias("folder")).distinct()
    ideas = lifecycle.captured(ideas, "A box for bees", "2024-01-02", "Of wood.", "TIN")
    return lifecycle.routed(ideas, hubs).select("title", F.col("date").cast("string").alias("date"), "collection")


def scaffold(spark: SparkSession, sf: str) -> DataFrame:
    """SK10, PF27: templates of all nations filled, the catalog marked as last; what is left open shows."""
    n = table(spark, sf, "nation").select(F.concat(slug("n_name"), F.lit("/status.md")).alias("rel"), F.concat(F.lit("# {{name}}: "), "n_name", F.lit(" on {{date}} by {{owner}}")).alias("content"))
    files = n.unionByName(spark.createDataFrame([("_MANIFEST.md", "# {{name}}")], "rel string, content string"))
    return lifecycle.scaffolded(files, {"name": "Vault", "date": AS_OF})


def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    """PF27: files with a placeholder that nothing filled."""
    return scaffold(spark, sf).filter(has_placeholder("content")).select("rel")


def entry_archived(spark: SparkSession, sf: str) -> DataFrame:
    """PR9: one part moves from tier 2 to 3."""
    c = table(spark, sf, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("link"), (F.col("p_partkey") % 3 + 1).cast("int").alias("tier"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("date"))
    return lifecycle.archived(c, "part-4", "replaced", AS_OF)


def collection_added(spark: SparkSession, sf: str) -> DataFrame:
    hubs = table(spark, sf, "nation").select(slug("n_name").alias("folder"), F.concat(slug("n_name"), F.lit("/_CLOSETS")).alias("link"), F.col("n_name").alias("summary"))
    return lifecycle.add_collection(hubs, "New Garden", "beds")


def similar_collections(spark: SparkSession, sf: str) -> DataFrame:
    hubs = table(spark, sf, "nation").select(slug("n_name").alias("folder"))
    return lifecycle.similar_slugs(hubs, "Nation 1").select("folder", F.col("distance").cast("long").alias("distance"))


def _reindexed(spark: SparkSession, sf: str) -> DataFrame:
    """Index files of all conversations, twenty collections."""
    turns = _turns(spark, sf)
    placed = turns.select("session_id").distinct().select("session_id", F.concat(F.lit("hub-"), (F.col("session_id") % 20).cast("string")).alias("collection"), F.concat(F.lit("s-"), F.col("session_id").cast("string")).alias("stem"), F.timestamp_seconds("session_id").alias("mtime"))
    return briefing.reindexed(turns, placed, PRIMARY)


def reindexed(spark: SparkSession, sf: str) -> DataFrame:
    """PR13: entries in each index file."""
    return _reindexed(spark, sf).select("collection", "is_archive", F.size(F.regexp_extract_all("content", F.lit(r"(?m)^## \[\[s-[0-9]+\]\]$"), F.lit(0))).cast("long").alias("n_entries"))


def indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """PR2, PF18: all lines of the vault under a trigram index, and the lines that several searches find by it."""
    path = shared_path(spark, "trigrams")
    trigrams.write_index(parsers.lines(vault(spark, sf), *trigrams.KEYS), path)
    found = [trigrams.search(spark, path, query, mode).select(F.lit(query).alias("query"), "rel", F.col("line_no").cast("long").alias("line_no"), "line") for query, mode in SEARCHES]
    return reduce(DataFrame.unionByName, found)


def _closing(spark: SparkSession, sf: str) -> tuple[closing.Closing, DataFrame]:
    v = vault(spark, sf)
    c = table(spark, sf, "customer")
    status = lambda day, extra: c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("rel"), F.concat(F.lit(f"# Status\nLast updated: {day}\n"), "c_name", extra).alias("content"))
    log = table(spark, sf, "events").select((F.col("event_id") + 1).cast("int").alias("ordinal"), F.col("event_type").alias("text"))
    entry = spark.createDataFrame([(1, "this session")], "ordinal int, text string")
    decisions = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("ordinal"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("text"))
    new = spark.createDataFrame([("2030-01-01", "x")], "date string, text string").withColumn("date", F.to_date("date"))
    indexes = v.filter("base = '_CLOSETS.md'").select(F.col("folder").alias("collection"), F.timestamp_seconds(F.unix_timestamp("mtime") + 3600).alias("mtime"))
    runs = table(spark, sf, "events").select(F.concat_ws("-", F.lit("user"), F.col("user_id").cast("string")).alias("op"), "ts")
    made = closing.closed(status("2024-01-01", F.lit("")), status("2024-01-02", F.when(F.col("c_custkey") % 5 == 0, " moved").otherwise("")), log, entry, decisions, new, v, indexes, runs, F.lit(AS_OF).cast("date"))
    return made, entry


def session_end(spark: SparkSession, sf: str) -> DataFrame:
    """PR6: what each step of closing a session writes."""
    return _closing(spark, sf)[0].steps()


def session_end_test(spark: SparkSession, sf: str) -> DataFrame:
    """SE1"""
    made, entry = _closing(spark, sf)
    return made.self_test(entry)


def decision_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """J15 at the size of the tables: part types as decisions, every seventh with override language."""
    p = table(spark, sf, "part")
    text = F.concat_ws(" ", F.when(F.col("p_partkey") % 7 == 0, "replaces"), "p_name", "p_type", "p_brand")
    return audit.overrides(p.select(F.col("p_partkey").alias("ordinal"), text.alias("text"), (F.col("p_partkey") % 11 == 0).alias("struck")), similar=0.6)


def override_chains(spark: SparkSession, sf: str) -> DataFrame:
    """J15, J16, PR7: every part type that later ones override, with the one that stands at the end of its chain."""
    p = table(spark, sf, "part")
    text = F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, "replaces"), "p_name", "p_type")
    pairs = audit.last_overrides(p.select(F.col("p_partkey").alias("ordinal"), text.alias("text"), F.lit(False).alias("struck")), similar=0.6)
    return chains.ends(pairs, item="older", by="newer").select(F.col("item").alias("ordinal"), "last", "steps", F.col("cycle").isNotNull().alias("cyclic"))


QUERIES = {
    "workspace_files": workspace_files, "dataset_turns": dataset_turns, "cached_texts": cached_texts, "cache_resumed": cache_resumed, "extracted_texts": extracted_texts, "index_texts": index_texts,
    "log_prepended": log_prepended, "decisions_appended": decisions_appended, "ideas_captured": ideas_captured, "scaffold": scaffold, "placeholders": placeholders, "entry_archived": entry_archived,
    "collection_added": collection_added, "similar_collections": similar_collections, "reindexed": reindexed, "session_end": session_end, "session_end_test": session_end_test,
    "decision_overrides": decision_overrides, "indexed_search": indexed_search, "override_chains": override_chains,
    "index_files_written": index_files_written, "graph_file_written": graph_file_written, "registry_written": registry_written, "reindexed_entries": reindexed_entries, "session_end_rows": session_end_rows,
}
QUERIES = {k: (lambda q: lambda spark, sf: q(configured(spark), sf))(v) for k, v in QUERIES.items()}

# --- the same in DuckDB ----------------------------------------------------

from .retrieval import tok  # noqa: E402

_ALL = named(_FILES)
_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NATIONS = _SLUG.format("n_name")
_CONTENT = "SELECT conv_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '') AS c, coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS u, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS a FROM conversations GROUP BY conv_id"
_PARTS = "SELECT p_partkey AS k, list_distinct(" + tok("concat_ws(' ', CASE WHEN p_partkey % 7 = 0 THEN 'replaces' END, p_name, p_type, p_brand)") + ") AS w FROM part"

_CHAINED = "SELECT p_partkey AS k, list_distinct(" + tok("concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN 'replaces' END, p_name, p_type)") + ") AS w FROM part"
_SEARCHED = " UNION ALL ".join(f"SELECT '{q}' AS query, * FROM l WHERE " + (f"contains(lower(line), lower('{q}'))" if m == "literal" else f"regexp_matches(line, '(?i){q}')") for q, m in SEARCHES)

ORACLES = {
    "indexed_search": f"WITH l AS (SELECT rel, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM (SELECT rel, string_split(content, chr(10)) AS ls FROM ({_ALL}))) {_SEARCHED}",
    "workspace_files": f"SELECT corpus, rel, folder, stem, content, true AS dated FROM ({_ALL}) WHERE rel NOT LIKE 'src1/%'",
    "dataset_turns": "SELECT conv_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations",
    "cached_texts": f"SELECT conv_id::VARCHAR AS session_id, c AS text FROM ({_CONTENT})",
    "extracted_texts": f"""WITH t AS ({_CONTENT}) SELECT 'content' AS extractor, count(*) AS n, sum(length(c))::BIGINT AS n_chars FROM t UNION ALL SELECT 'summary', count(*), sum(length(left(u, 250) || ' | ' || left(a, 250)))::BIGINT FROM t
        UNION ALL SELECT 'firstmsg', count(*), sum(length(u))::BIGINT FROM t UNION ALL SELECT 'haiku', count(*), sum(length('session ' || conv_id))::BIGINT FROM t WHERE conv_id % 2 = 1""",
    "index_texts": """WITH e AS (SELECT c_nationkey AS collection, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, 'order-' || o_orderkey) AS place,
            format(E'## [[order-{}]]\\n- subjects: {}\\n- people: {}, clerk\\n- dates: {}', o_orderkey, o_orderstatus, o_custkey, strftime(o_orderdate, '%Y-%m-%d')) AS block FROM orders JOIN customer ON o_custkey = c_custkey)
        SELECT collection, place > 30 AS is_archive, sha256(string_agg(block, E'\\n\\n' ORDER BY place)) AS content_sha256 FROM e GROUP BY collection, place > 30""",
    "log_prepended": "SELECT (event_id + 2)::INT AS ordinal, event_type AS text FROM events UNION ALL SELECT 1, 'closed'",
    "decisions_appended": "SELECT o_orderkey::INT AS ordinal, o_orderdate::DATE::VARCHAR AS date, o_orderstatus AS text FROM orders UNION ALL SELECT (max(o_orderkey) + 1)::INT, '2030-01-01', 'sooner' FROM orders UNION ALL SELECT (max(o_orderkey) + 2)::INT, '2030-01-02', 'later' FROM orders",
    "ideas_captured": r"""WITH h AS (SELECT DISTINCT lower(regexp_extract(p_type, '[^ ]*$')) AS folder FROM part), i AS (SELECT 'Idea ' || p_partkey AS title, regexp_extract_all(lower('Idea ' || p_partkey || ' ' || p_name || ' ' || p_type), '[a-z0-9-]+') AS ws FROM part)
        SELECT title, '2024-01-01' AS date, coalesce((SELECT min(folder) FROM h WHERE list_contains(ws, folder)), 'unrouted') AS collection FROM i UNION ALL SELECT 'A box for bees', '2024-01-02', coalesce((SELECT folder FROM h WHERE folder = 'tin'), 'unrouted')""",
    "scaffold": f"SELECT {_NATIONS} || '/status.md' AS rel, '# Vault: ' || n_name || ' on {AS_OF} by {{{{owner}}}}' AS content, false AS last FROM nation UNION ALL SELECT '_MANIFEST.md', '# Vault', true",
    "placeholders": f"SELECT {_NATIONS} || '/status.md' AS rel FROM nation",
    "entry_archived": f"SELECT 'part-' || p_partkey AS link, CASE WHEN p_partkey = 4 THEN 3 ELSE (p_partkey % 3 + 1)::INT END AS tier, CASE WHEN p_partkey = 4 THEN 'replaced' END AS reason, CASE WHEN p_partkey = 4 THEN '{AS_OF}' END AS date FROM part",
    "collection_added": f"SELECT {_NATIONS} AS folder, {_NATIONS} || '/_CLOSETS' AS link, n_name AS summary FROM nation UNION ALL SELECT 'new-garden', 'new-garden/_CLOSETS', 'beds'",
    "similar_collections": f"SELECT folder, levenshtein(folder, 'nation-1')::BIGINT AS distance FROM (SELECT {_NATIONS} AS folder FROM nation) WHERE levenshtein(folder, 'nation-1') <= 2",
    "reindexed": "WITH p AS (SELECT DISTINCT conv_id FROM conversations), e AS (SELECT 'hub-' || conv_id % 20 AS collection, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id DESC) AS place FROM p) SELECT collection, place > 30 AS is_archive, count(*) AS n_entries FROM e GROUP BY collection, place > 30",
    "session_end": f"""SELECT '1 status' AS step, count(*) AS n FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT '2 log kept', least(count(*) + 1, 10) FROM events UNION ALL SELECT '3 log archived', greatest(count(*) + 1 - 10, 0) FROM events
        UNION ALL SELECT '4 decisions', count(*) + 1 FROM orders UNION ALL SELECT '5 index refreshed', count(*) FROM ({_ALL}) f LEFT JOIN (SELECT folder, mtime + INTERVAL 1 HOUR AS at FROM ({_ALL}) WHERE base = '_CLOSETS.md') i USING (folder) WHERE i.at IS NULL OR f.mtime > i.at
        UNION ALL SELECT '6 broken links', count(*) FROM ({VAULT['vault_broken_links']}) UNION ALL SELECT '7 due', count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING date_diff('day', max(ts)::DATE, DATE '{AS_OF}') > 14)""",
    "session_end_test": "SELECT * FROM (VALUES ('entry on top', true), ('log within cap', true), ('log whole', true), ('decisions unique', true)) t(\"check\", ok)",
    "decision_overrides": f"WITH d AS ({_PARTS}) SELECT n.k AS newer, o.k AS older FROM d n JOIN d o ON o.k < n.k WHERE n.k % 7 = 0 AND o.k % 11 <> 0 AND 5 * len(list_intersect(n.w, o.w)) >= 3 * (len(n.w) + len(o.w) - len(list_intersect(n.w, o.w)))",
    "override_chains": f"""WITH RECURSIVE d AS ({_CHAINED}), f AS (SELECT o.k AS item, max(n.k) AS above FROM d n JOIN d o ON o.k < n.k WHERE n.k % 2 = 0 AND 5 * len(list_intersect(n.w, o.w)) >= 3 * (len(n.w) + len(o.w) - len(list_intersect(n.w, o.w))) GROUP BY o.k),
        r AS (SELECT item, above AS last, 1 AS steps FROM f UNION ALL SELECT r.item, f.above, steps + 1 FROM r JOIN f ON r.last = f.item) SELECT item AS ordinal, arg_max(last, steps) AS last, max(steps)::BIGINT AS steps, false AS cyclic FROM r GROUP BY item""",
    "graph_file_written": f"SELECT ordinal, line FROM ({VAULT['vault_graph_report']})",
    "registry_written": f"SELECT regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g') AS name, '/srv/' || c_custkey AS path, '{AS_OF}' AS registered, c_custkey % 3 > 0 AS searchable FROM customer",
    "reindexed_entries": "WITH p AS (SELECT DISTINCT conv_id FROM conversations), e AS (SELECT 'hub-' || conv_id % 20 AS collection, 's-' || conv_id AS stem, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id DESC) AS place FROM p) SELECT collection, place > 30 AS is_archive, place - 1 - CASE WHEN place > 30 THEN 30 ELSE 0 END AS at, stem FROM e",
    "session_end_rows": f"""SELECT '1 status' AS step, 'c' || c_custkey AS key, '# Status' || chr(10) || 'Last updated: 2024-01-02' || chr(10) || c_name || ' moved' AS value FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT '2 log', (event_id + 2)::VARCHAR, event_type || CASE WHEN event_id + 2 > 10 THEN ' archived' ELSE ' kept' END FROM events UNION ALL SELECT '2 log', '1', 'this session kept'
        UNION ALL SELECT '4 decisions', o_orderkey::VARCHAR, o_orderdate::DATE || ' ' || o_orderstatus FROM orders UNION ALL SELECT '4 decisions', (max(o_orderkey) + 1)::VARCHAR, '2030-01-01 x' FROM orders
        UNION ALL SELECT '5 index', folder || '/' || stem, 'refreshed' FROM ({_ALL}) f LEFT JOIN (SELECT folder, mtime + INTERVAL 1 HOUR AS at FROM ({_ALL}) WHERE base = '_CLOSETS.md') i USING (folder) WHERE i.at IS NULL OR f.mtime > i.at
        UNION ALL SELECT '7 due', 'user-' || user_id, date_diff('day', max(ts)::DATE, DATE '{AS_OF}')::VARCHAR FROM events GROUP BY user_id HAVING date_diff('day', max(ts)::DATE, DATE '{AS_OF}') > 14""",
}
ORACLES["index_files_written"] = ORACLES["index_texts"]
ORACLES["cache_resumed"] = ORACLES["cached_texts"]
