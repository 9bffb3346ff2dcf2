"""Parsers of the corpus's text formats (SC4, SC5, SC7-SC12): lines, a forward-filled heading, and patterns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import patterns as P
from ..functions.text import front_matter, link_stem, links, strip, unquoted
from .json_ranges import RANGE_BYTES, json_values


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, line) of every file."""
    keep = keep or ("rel",)
    return files.filter("content is not null").select(*keep, F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def filled(rows: DataFrame, value: Column, name: str, *by: str) -> DataFrame:
    """WN15: the last non-null value so far, within a file."""
    w = Window.partitionBy(*(by or ("rel",))).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def _match(line: str, pattern: str, group: int = 1) -> Column:
    return F.when(F.rlike(line, F.lit(pattern)), strip(F.regexp_extract(line, pattern, group)))


def front_matter_fields(files: DataFrame) -> DataFrame:
    """SC4: (rel, key, value) of each front matter line; of equal keys the last one counts."""
    rows = files.select("rel", front_matter("content").alias("block")).filter("block is not null").select("rel", F.posexplode(F.split("block", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", strip("line")).filter(~F.col("line").startswith("#") & F.contains("line", F.lit(":")))
    key = F.lower(strip(F.substring_index("line", ":", 1)))
    value = unquoted(strip(F.regexp_replace("line", "^[^:]*:", "")))
    return rows.select("rel", key.alias("key"), value.alias("value"), "at").groupBy("rel", "key").agg(F.max_by("value", "at").alias("value"))


def front_matter_map(files: DataFrame) -> DataFrame:
    """(rel, scalars map, link_lists map) for files with at least one field."""
    rows = front_matter_fields(files)
    listed = F.col("key").isin(*P.EDGE_KEYS)
    return rows.groupBy("rel").agg(F.map_from_entries(F.collect_list(F.when(~listed, F.struct("key", "value")))).alias("scalars"), F.map_from_entries(F.collect_list(F.when(listed, F.struct(F.col("key"), links("value"))))).alias("link_lists"))


#: Pieces of a registry, of some 64 KB, that a task parses.
TASK_PIECES = 32


def registry(files: DataFrame) -> DataFrame:
    """SC5: (name, path, registered, searchable) in file order; names have no space, searchable defaults to true.

    Files may come in pieces that begin with a heading, with `start`, their place;
    then the order is by both, and there are tasks for every TASK_PIECES of them.
    """
    keep = ("rel", "start") if "start" in files.columns else ("rel",)
    tasks = max(1, -(-files.count() // TASK_PIECES)) if "start" in files.columns else 0
    # the number is given, as rows this alike are far larger than their shuffled bytes tell
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks else df
    files = dealt(files, *keep)
    rows = filled(lines(files, *keep), _match("line", r"^##\s+(\S+)\s*$"), "name", *keep).filter("name is not null")
    at = F.struct("start", "line_no") if "start" in files.columns else F.col("line_no")
    pair = r"^-\s+(\w+)\s*:\s*(.+)$"
    rows = rows.withColumn("key", F.lower(F.regexp_extract(strip("line"), pair, 1))).withColumn("value", strip(F.regexp_extract(strip("line"), pair, 2)))
    last = lambda key: F.max_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, at))
    found = dealt(rows, "rel", "name").groupBy("rel", "name").agg(F.min(at).alias("at"), last("path").alias("path"), last("registered").alias("registered"), last("searchable").alias("searchable"))
    return found.select("at", "name", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("registered", F.lit("")).alias("registered"), F.coalesce(F.lower("searchable").isin("true", "yes", "1"), F.lit(True)).alias("searchable"))


def facet_index(files: DataFrame) -> DataFrame:
    """SC7, D6: (rel, folder, is_archive, stem, ordinal, field, value), a row a field line, with or without the leading dash."""
    rows = filled(lines(files, "rel", "folder", "base"), _match("line", r"^\s*##\s+\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]\s*$"), "heading").filter("heading is not null")
    field = r"^\s*-?\s*(subjects|people|claims|decisions|dates|status):\s*(.*)$"
    rows = rows.withColumn("field", _match("line", field)).withColumn("value", _match("line", field, 2)).filter("field is not null")
    order = F.dense_rank().over(Window.partitionBy("rel").orderBy("heading"))
    return rows.select("rel", "folder", (F.col("base") == P.INDEX_FILES[1]).alias("is_archive"), link_stem("heading").alias("stem"), order.alias("ordinal"), "field", "value")


def catalog(files: DataFrame) -> DataFrame:
    """SC8, D8, D9: (section, tier, link, summary, extra, head_kind, folder) of every table row in the catalog file."""
    rows = filled(lines(files), _match("line", r"^#{2,3}\s+(.*)$"), "section").filter(F.rlike("line", F.lit(r"^\|.*\[\[")))
    cells = F.transform(F.split(F.regexp_replace(F.regexp_replace("line", r"^\s*\|", ""), r"\|\s*$", ""), r"\s*\|\s*(?![^\[]*\]\])"), strip)
    rows = rows.withColumn("cells", cells).withColumn("link", F.get(links(F.col("line")), F.lit(0)))
    at = F.array_position(F.transform("cells", lambda c: F.contains(c, F.lit("[["))), True).cast("int")
    tier = F.regexp_extract("section", r"(?i)tier\s+(\d)", 1)
    kind = F.when(F.col("link").endswith("/_CLOSETS"), "closets").when(F.col("link").endswith("-index"), "index").otherwise("file")
    where = F.when(kind == "closets", F.regexp_replace("link", "/_CLOSETS$", "")).when(kind == "index", F.regexp_replace("link", "-index$", ""))
    return rows.select("rel", "line_no", "section", F.when(tier != "", tier.cast("int")).alias("tier"), "link", F.get("cells", at).alias("summary"), F.get("cells", at + 1).alias("extra"), kind.alias("head_kind"), where.alias("folder"))


def status_items(files: DataFrame) -> DataFrame:
    """(rel, last_updated, section, ordinal, text); the two spellings of Blocked are one section."""
    rows = filled(lines(files), _match("line", r"^##\s+(.*)$"), "section")
    updated = rows.groupBy("rel").agg(F.max(F.to_date(F.nullif(F.regexp_extract("line", r"(?i)last updated:\**\s*(\d{4}-\d{2}-\d{2})", 1), F.lit("")))).alias("last_updated"))
    items = rows.withColumn("text", _match("line", r"^\s*[-*]\s+(.*)$")).filter("text is not null and section is not null")
    items = items.withColumn("section", F.regexp_replace("section", "^What's ", "")).withColumn("ordinal", F.row_number().over(Window.partitionBy("rel", "section").orderBy("line_no")))
    return updated.join(items.select("rel", "section", "ordinal", "text"), "rel", "left")


def session_log(files: DataFrame) -> DataFrame:
    """(rel, ordinal from 1 at the top, date, title, bullets)."""
    head = r"^##\s+(\d{4}-\d{2}-\d{2})\s+-\s+(.*)$"
    rows = filled(lines(files), F.when(F.rlike("line", F.lit(head)), F.col("line_no")), "entry").filter("entry is not null")
    return rows.groupBy("rel", "entry").agg(F.max(_match("line", head)).alias("date"), F.max(_match("line", head, 2)).alias("title"), F.transform(F.sort_array(F.collect_list(F.when(F.rlike("line", F.lit(r"^\s*[-*]\s+")), F.struct("line_no", F.regexp_replace("line", r"^\s*[-*]\s+", "").alias("b"))))), lambda x: x["b"]).alias("bullets")).select("rel", F.row_number().over(Window.partitionBy("rel").orderBy("entry")).alias("ordinal"), F.to_date("date").alias("date"), "title", "bullets")


def decision_log(files: DataFrame) -> DataFrame:
    """(rel, ordinal, date, text, struck, superseded_on)."""
    head = r"^\s*(?:[-*]\s+)?(?:~~)?\*\*(\d{4}-\d{2}-\d{2})\*\*\s+[-–]\s+(.*)$"
    rows = lines(files).filter(F.rlike("line", F.lit(head)))
    body = F.regexp_extract("line", head, 2)
    gone = F.nullif(F.regexp_extract("line", r"\(superseded (\d{4}-\d{2}-\d{2})\)", 1), F.lit(""))
    text = strip(F.regexp_replace(F.regexp_replace(body, r"\(superseded \d{4}-\d{2}-\d{2}\)", ""), "~~", ""))
    return rows.select("rel", F.row_number().over(Window.partitionBy("rel").orderBy("line_no")).alias("ordinal"), F.to_date(F.regexp_extract("line", head, 1)).alias("date"), text.alias("text"), F.contains("line", F.lit("~~")).alias("struck"), F.to_date(gone).alias("superseded_on"))


def ideas(files: DataFrame) -> DataFrame:
    """(rel, title, date, body, route); either arrow marks the route."""
    head = r"^###\s+(.*?)\s+-\s+(\d{4}-\d{2}-\d{2})\s*$"
    rows = filled(lines(files), F.when(F.rlike("line", F.lit(head)), F.col("line_no")), "entry").filter("entry is not null")
    arrow = r"^\s*(?:->|→)\s*(.*)$"
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.rlike("line", F.lit(head)) & ~F.rlike("line", F.lit(arrow)) & (strip("line") != ""), F.struct("line_no", F.col("line").alias("b"))))), lambda x: x["b"]), "\n")
    return rows.groupBy("rel", "entry").agg(F.max(_match("line", head)).alias("title"), F.to_date(F.max(_match("line", head, 2))).alias("date"), body.alias("body"), F.max(_match("line", arrow)).alias("route")).drop("entry")


def run_log(files: DataFrame) -> DataFrame:
    """(rel, ts, counters map, status) of each run line; any k=v is understood."""
    rows = lines(files).filter(F.rlike("line", F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}")))
    pairs = F.map_from_entries(F.transform(F.regexp_extract_all("line", F.lit(r"[A-Za-z_-]+=\S+"), F.lit(0)), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))))
    return rows.select("rel", F.to_timestamp(F.substring("line", 1, 19), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.map_filter(pairs, lambda k, v: k != "status").alias("counters"), F.element_at(pairs, "status").alias("status"))


QUESTIONS = "question_id string, question_type string, question string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"


def questions(spark: SparkSession, path: str, schema: str | StructType = QUESTIONS, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SC10, SC11: one JSON array a file, or JSON lines where a file doesn't start as one; read by byte ranges either way."""
    schema = schema if isinstance(schema, str) else schema.simpleString()
    return json_values(spark, path, range_bytes=range_bytes).select(F.from_json("value", schema).alias("row")).select("row.*")


def candidate_turns(data: DataFrame) -> DataFrame:
    """J6, AG26: (session_id, turn, role, text), each session once, its first occurrence."""
    pairs = data.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("pos", "z"))
    pairs = pairs.select("question_id", "pos", F.col("z.haystack_session_ids").alias("session_id"), F.col("z.haystack_sessions").alias("turns"))
    first = pairs.groupBy("session_id").agg(F.min_by("turns", F.struct("question_id", "pos")).alias("turns"))
    return first.select("session_id", F.posexplode("turns").alias("turn", "t")).select("session_id", "turn", "t.role", F.col("t.content").alias("text"))


def cache(spark: SparkSession, path: str) -> DataFrame:
    """SC12: (session_id, text) from Parquet; an absent cache is empty."""
    try:
        return spark.read.parquet(path).select("session_id", "text")
    except AnalysisException:
        return spark.createDataFrame([], "session_id string, text string")
