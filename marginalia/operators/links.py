"""Reference links: resolution, index headings and plain-text mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import base_name, clean_line, is_index_file, link_stem, links, path_keys, skipped, strip, without_code, without_front_matter
from ..sources.parsers import lines
from ..sources.markdown import markdown


def known_names(files: DataFrame) -> DataFrame:
    """ST5: one lower-cased key a row: every stem, path and path without extension."""
    return files.select(F.explode(F.array_union(F.array("stem_lc"), path_keys("rel"))).alias("key"), F.lit(True).alias("known")).distinct()


def link_rows(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(rel, ordinal, target) of every link outside code; index files are left to `index_issues`."""
    return markdown(files, skip).filter(~is_index_file("base")).select("rel", F.posexplode(links(without_code("content"))).alias("ordinal", "target"))


def broken_links(files: DataFrame, skip: tuple[str, ...] = (), rows: DataFrame | None = None) -> DataFrame:
    """(rel, ordinal, target) of links that name no file, a row an occurrence.

    The disjunction (stem, or path, or path with .md) becomes keys that are
    joined by equality, so no nested loop is planned.
    """
    found = rows if rows is not None else link_rows(files, skip)
    target = F.lower("target")
    base = F.lower(link_stem(base_name("target")))
    keys = F.when(F.contains("target", F.lit("/")), F.array_distinct(F.array(base, target, F.concat(target, F.lit(".md"))))).otherwise(F.array(F.lower(link_stem("target"))))
    stems = files.select(F.col("stem_lc").alias("key")).distinct()
    paths = files.select(F.explode(path_keys("rel")).alias("key")).distinct()
    # a bare link resolves by stem alone, one with a slash by either
    names = stems.select("key", F.lit(True).alias("stem")).join(paths.select("key", F.lit(True).alias("path")), "key", "full")
    tried = found.withColumn("slash", F.contains("target", F.lit("/"))).withColumn("base", base).withColumn("key", F.explode(keys)).join(names, "key", "left")
    hit = F.coalesce(F.col("stem") & (F.col("key") == F.col("base")), F.lit(False)) | (F.col("slash") & F.coalesce("path", F.lit(False)))
    return tried.groupBy("rel", "ordinal", "target").agg(F.bool_or(hit).alias("ok")).filter(~F.col("ok")).drop("ok")


def index_issues(files: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """(rel, line_no, message): index headings without a file, and a missing version marker at line 0."""
    indexes = files.filter(is_index_file("base") & ~skipped("rel", skip))
    unmarked = indexes.filter(~F.rlike("content", F.lit("<!-- [a-z]+-closets:"))).select("rel", F.lit(0).alias("line_no"), F.lit("missing version marker").alias("message"))
    heading = r"^##\s+\[\[([^\]\|]+?)(?:\|[^\]]*)?\]\]\s*$"
    heads = lines(indexes).withColumn("line", strip("line")).filter(F.rlike("line", F.lit(heading))).withColumn("target", strip(F.regexp_extract("line", heading, 1)))
    dangling = heads.join(files.select("stem_lc").distinct(), F.lower(link_stem("target")) == F.col("stem_lc"), "left_anti")
    return unmarked.union(dangling.select("rel", "line_no", F.concat(F.lit("entry [["), "target", F.lit("]] points to a missing file"))))


_WORD = r"(?U)\w+"
#: Hashes of first words that `mentions` sends to all tasks, whatever the number of names.
BUCKETS = 1 << 20


def mentions(files: DataFrame, scan: DataFrame | None = None, skip: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """(rel, line_no, original_line_no, text, stem): plain-text names of other files, at most one for a stem and line.

    Names become sequences of words; lines are exploded into the sequences
    that begin with a name's first word (told by a hash in BUCKETS, sent to all
    tasks) and have as many words, and joined by equality on the words.  Only
    these sequences are shuffled for that, not the lines they stand in; a line
    meets its names once, and the exact pattern is checked.  Line numbers count
    after front matter and code are removed; the original number counts in the
    file.
    """
    known = files.filter(F.length("stem_lc") >= least).groupBy("stem_lc").agg(F.max("rel").alias("target"))
    patterns = known.select("stem_lc", F.posexplode(F.array_distinct(F.array("stem_lc", F.replace("stem_lc", F.lit("-"), F.lit(" "))))).alias("variant", "pattern"))
    patterns = patterns.withColumn("words", F.regexp_extract_all("pattern", F.lit(_WORD), F.lit(0))).withColumn("n", F.size("words")).filter("n > 0").withColumn("key", F.concat_ws(" ", "words"))
    bucket = lambda word: F.pmod(F.xxhash64(word), F.lit(BUCKETS))
    starts = patterns.groupBy(bucket(F.get("words", F.lit(0))).alias("bucket")).agg(F.collect_set("n").alias("sizes"))
    scan = markdown(scan if scan is not None else files, skip).filter("content is not null").withColumn("kept", without_code(without_front_matter("content")))
    rows = scan.select("rel", F.col("stem_lc").alias("own"), F.posexplode(F.split("kept", "\n")).alias("at", "raw")).withColumn("line", clean_line("raw")).filter("lower(line) <> ''")
    words = rows.select("rel", "own", "at", F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)).alias("words"))
    placed = words.select("rel", "own", "at", "words", F.posexplode("words").alias("i", "word")).withColumn("bucket", bucket(F.col("word"))).join(F.broadcast(starts), "bucket")
    grams = placed.select("rel", "own", "at", "words", "i", F.explode("sizes").alias("m")).filter("i + m <= size(words)").select("rel", "own", "at", "m", F.array_join(F.slice("words", F.col("i") + 1, F.col("m")), " ").alias("gram"))
    named = grams.join(patterns.select("stem_lc", "variant", "pattern", "key", "n"), (F.col("gram") == F.col("key")) & (F.col("m") == F.col("n"))).filter(F.col("stem_lc") != F.col("own"))
    named = named.select("rel", "at", "stem_lc", "variant", "pattern").distinct()
    quoted = F.regexp_replace("pattern", r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    hits = named.join(rows.select("rel", "at", "line", F.sha2("raw", 256).alias("raw")), ["rel", "at"])
    hits = hits.withColumn("place", F.regexp_instr(F.lower("line"), F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"\b")))).filter("place > 0")
    hits = hits.select("rel", "at", "stem_lc", "variant", "raw", "place", F.substr("line", F.col("place"), F.length("pattern")).alias("text"))
    first = hits.groupBy("rel", "at", "stem_lc").agg(F.min_by(F.struct("place", "text", "raw"), "variant").alias("h"))
    originals = lines(scan).select("rel", F.sha2("line", 256).alias("raw"), "line_no").groupBy("rel", "raw").agg(F.min("line_no").alias("original_line_no"))
    out = first.select("rel", (F.col("at") + 1).alias("line_no"), F.col("h.text").alias("text"), F.col("stem_lc").alias("stem"), F.col("h.raw").alias("raw"))
    return out.join(originals, ["rel", "raw"], "left").select("rel", "line_no", "original_line_no", "text", "stem")


def link_totals(files: DataFrame) -> DataFrame:
    """AG23, AG7: links, linked targets, files, broken links and index issues, with an exit status; index issues only warn."""
    rows = link_rows(files)
    a = rows.agg(F.count("*").alias("n_links"), F.count_distinct("target").alias("n_targets"))
    b = files.agg(F.count("*").alias("n_files"))
    c = broken_links(files, rows=rows).agg(F.count("*").alias("n_broken"))
    d = index_issues(files).agg(F.count("*").alias("n_issues"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("exit_status", F.when(F.col("n_broken") > 0, 1).otherwise(0))


def renamed(files: DataFrame, renames: dict[str, str]) -> DataFrame:
    """[[old]] becomes [[new]], with and without alias, in every file; renames are few and given."""
    content = F.col("content")
    for old, new in renames.items():
        quoted = "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in old)
        content = F.regexp_replace(content, rf"\[\[{quoted}(\|[^\]]*)?\]\]", f"[[{new}$1]]")
    return files.withColumn("content", content)


def top_targets(rows: DataFrame, k: int = 5) -> DataFrame:
    """AG24: the k most frequent link targets of each file."""
    counted = rows.groupBy("rel", "target").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rel").orderBy(F.desc("n"), "target")
    return counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def applied(files: DataFrame, suggestions: DataFrame) -> DataFrame:
    """PR16: a file's suggested lines with the named text turned into a link, as proposals (rel, line_no, before, after).

    The first plain occurrence in the line is linked; a line with several
    suggestions gets one proposal for each.
    """
    s = suggestions.select("rel", F.col("original_line_no").alias("line_no"), "text", "stem").filter("line_no is not null")
    quoted = F.regexp_replace("text", r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    after = F.regexp_replace("line", F.concat(F.lit(r"(?U)^(.*?)(?<!\[)\b"), quoted, F.lit(r"\b(?!\])")), F.concat(F.lit("$1[["), "stem", F.lit("]]")))
    return s.join(lines(files), ["rel", "line_no"]).select("rel", "line_no", F.col("line").alias("before"), after.alias("after"))
