"""Integrity audits: freshness, decisions, orphans, duplicates, coverage, upgrades (J9-J17, AG20-AG22, AG27, LC, CO, UP, SS, SE).

Findings are rows (check, severity, subject, detail).  Dates are compared with
an `as_of` that the caller gives, never with the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import any_phrase, overlap, tokens, version
from ..session import settled
from .links import top_targets
from .overlaps import candidate_pairs, rarest_first, similar_pairs

FRESH_DAYS, DRIFT_SECONDS, STALE_ENTRIES, STALE_DAYS, CADENCE_DAYS = 3, 300, 3, 7, 14
COMPRESS_FROM, COMPRESS_WARN, LINE_CAP = 60, 95, 100


def finding(rows: DataFrame, check: str, severity: Column | str, subject: Column | str, detail: Column | str) -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.lit(check).alias("check"), c(severity).alias("severity"), c(subject).cast("string").alias("subject"), c(detail).cast("string").alias("detail"))


def freshness(status: DataFrame, as_of: Column) -> DataFrame:
    """LC1: (key, last_updated) -> age and state; no date warns as an old one does."""
    age = F.datediff(as_of, "last_updated")
    return status.withColumn("age_days", age).withColumn("severity", F.when(F.col("last_updated").isNull() | (age > FRESH_DAYS), "WARN").otherwise("PASS"))


def overrides(decisions: DataFrame, phrases: tuple[str, ...] = P.OVERRIDES, similar: float = 0.5) -> DataFrame:
    """J15, LC2: (newer, older) decisions where the newer has override language and shares its topic with an unannotated older one.

    Topics match by a Jaccard similarity of words of at least `similar`, which
    asks for at least that share of the smaller set.  Decisions of equal words
    are one topic: topics are compared, and their decisions meet only where
    topics match, so the work beyond the topics is that of the result.
    """
    newer, older, topics = _topics(decisions, phrases, similar)
    pairs = topics.join(newer, "l_topic").join(older, "r_topic").filter("older < newer").select("newer", "older")
    # a topic pair gives a pair of decisions once, unless an ordinal stands for several
    repeated = decisions.groupBy("ordinal").agg(F.count("*").alias("n")).filter("n > 1 and ordinal is not null")
    return pairs if repeated.isEmpty() else pairs.distinct()


def last_overrides(decisions: DataFrame, phrases: tuple[str, ...] = P.OVERRIDES, similar: float = 0.5) -> DataFrame:
    """(newer, older) of `overrides` with the largest newer decision of each older one; no other pair is made."""
    newer, older, topics = _topics(decisions, phrases, similar)
    last = newer.groupBy("l_topic").agg(F.max("newer").alias("newer"))
    reached = topics.join(last, "l_topic").groupBy("r_topic").agg(F.max("newer").alias("newer"))
    return older.join(reached, "r_topic").filter("older < newer").groupBy("older").agg(F.max("newer").alias("newer")).select("newer", "older")


def _topics(decisions: DataFrame, phrases: tuple[str, ...], similar: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(l_topic, newer), (r_topic, older) and the matching (l_topic, r_topic), a topic being a set of words; candidates meet on their rarest words."""
    words = F.array_sort(F.array_distinct(tokens("text")))
    d = decisions.select("ordinal", "struck", any_phrase("text", phrases).alias("says"), F.array_join(words, " ").alias("topic")).filter("topic <> '' and ordinal is not null")
    newer = d.filter("says").select(F.col("topic").alias("l_topic"), F.col("ordinal").alias("newer"))
    older = d.filter(~F.col("struck")).select(F.col("topic").alias("r_topic"), F.col("ordinal").alias("older"))
    kinds = settled(d.groupBy("topic").agg(F.max(F.when(F.col("says"), F.col("ordinal"))).alias("newest"), F.min(F.when(~F.col("struck"), F.col("ordinal"))).alias("oldest")).withColumn("words", F.split("topic", " ")))
    left, right = kinds.filter("newest is not null").drop("oldest"), kinds.filter("oldest is not null").drop("newest")
    pairs = similar_pairs(rarest_first(left, kinds), rarest_first(right, kinds), similar).filter("r_oldest < l_newest")
    return newer, older, pairs.select("l_topic", "r_topic").distinct()


def redundant_pairs(decisions: DataFrame) -> DataFrame:
    """Struck decisions whose superseder stands later in the file."""
    gone = decisions.filter("struck and superseded_on is not null").select(F.col("ordinal").alias("old"), "superseded_on", F.col("text").alias("old_text"))
    kept = decisions.filter("not struck").select(F.col("ordinal").alias("new"), "date", F.col("text").alias("new_text"))
    return gone.join(kept, (F.col("superseded_on") == F.col("date")) & (F.col("new") > F.col("old"))).select("old", "new", "old_text", "new_text")


def annotated(decisions: DataFrame, pairs: DataFrame) -> DataFrame:
    """PR7, LC11: the safe fix: superseded decisions struck, with the superseder's date."""
    dates = pairs.join(decisions.select(F.col("ordinal").alias("newer"), F.col("date").alias("new_date")), "newer").groupBy("older").agg(F.min("new_date").alias("new_date"))
    return decisions.join(dates, F.col("ordinal") == F.col("older"), "left").select("ordinal", "date", "text", (F.col("struck") | F.col("older").isNotNull()).alias("struck"), F.coalesce("superseded_on", "new_date").alias("superseded_on"))


def orphans(on_disk: DataFrame, registered: DataFrame, key: str = "key") -> DataFrame:
    """J9, LC3: (key, severity): on disk but unregistered warns, registered but missing informs."""
    a, b = on_disk.select(key).distinct().withColumn("d", F.lit(1)), registered.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").filter("d is null or r is null").select(key, F.when(F.col("r").isNull(), "WARN").otherwise("INFO").alias("severity"))


def untracked(members: DataFrame, known: DataFrame, key: str = "folder", least: int = 1) -> DataFrame:
    """J10, J11, LC4: groups with at least `least` members that are not known: (key, n)."""
    return members.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(known.select(key).distinct(), key, "left_anti")


def coverage(hubs: DataFrame, indexed: DataFrame, key: str = "folder") -> DataFrame:
    """J12, AG19: (covered, hubs, percent)."""
    joined = hubs.select(key).distinct().join(indexed.select(key).distinct().withColumn("i", F.lit(1)), key, "left")
    return joined.agg(F.count("i").alias("covered"), F.count("*").alias("hubs")).withColumn("percent", F.when(F.col("hubs") > 0, F.round(100.0 * F.col("covered") / F.col("hubs"), 2)))


def missing_entries(entries: DataFrame, there: DataFrame, key: str = "key") -> DataFrame:
    """J13, LC9: catalog entries (key, tier) without a file; tier 3 informs, the rest warns."""
    return entries.join(there.select(key).distinct(), key, "left_anti").withColumn("severity", F.when(F.col("tier") == 3, "INFO").otherwise("WARN"))


def near_names(names: DataFrame, *, most: int = 2, key: str = "id", name: str = "name", every: bool = True) -> DataFrame:
    """Pairs of names within `most` edits, without comparing all pairs.

    Rows of one name, in any case, are a class, and names are compared once.
    With `every`, all pairs of rows are given; without, a class's least key is
    paired with each other one and stands for the name in pairs with other
    names, so a name that many rows have gives no square of pairs.  Names are
    cut into most + 1 pieces; two names within `most` edits share a piece,
    shifted by at most `most`, so candidates come from equality joins on (piece
    number, piece) and only they are compared.
    """
    folded = names.select(F.col(key).alias("id"), F.lower(name).alias("nm"))
    n = folded.groupBy("nm").agg(F.min("id").alias("id")).withColumn("len", F.length("nm"))
    first = folded if every else n
    equal = folded.join(first.select("nm", F.col("id").alias("first")), "nm").filter(F.col("first") < F.col("id")).select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    parts = most + 1
    start = lambda i: (F.col("len") * i / parts).cast("int")
    indexed = n.select(F.col("id").alias("y"), F.col("nm").alias("ny"), F.col("len").alias("lb"), F.explode(F.array(*[F.struct(F.lit(i).alias("part"), start(i).alias("at"), F.substr("nm", start(i) + 1, start(i + 1) - start(i)).alias("piece")) for i in range(parts)])).alias("p")).select("y", "ny", "lb", "p.*")
    # every substring of the other name that may be such a piece: for each length of partner and shift
    probe = n.select(F.col("id").alias("x"), F.col("nm").alias("nx"), "len", F.explode(F.sequence(F.greatest(F.col("len") - most, F.lit(0)), F.col("len") + most)).alias("lp"))
    probe = probe.select("x", "nx", "lp", F.explode(F.array(*[F.lit(i) for i in range(parts)])).alias("part"))
    s, e = (F.col("lp") * F.col("part") / parts).cast("int"), (F.col("lp") * (F.col("part") + 1) / parts).cast("int")
    probe = probe.select("x", "nx", "lp", "part", s.alias("s"), (e - s).alias("w"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("shift")).filter("s + shift >= 0")
    probe = probe.select("x", "nx", "lp", "part", F.substr("nx", F.col("s") + F.col("shift") + 1, F.col("w")).alias("piece")).distinct()
    pairs = probe.join(indexed, (F.col("lp") == F.col("lb")) & (probe["part"] == indexed["part"]) & (probe["piece"] == indexed["piece"])).filter("x < y").select("x", "y", "nx", "ny").distinct()
    near = pairs.withColumn("distance", F.levenshtein("nx", "ny", most)).filter(F.col("distance") >= 0)
    if every:
        one, other = (folded.select(F.col("nm").alias(n), F.col("id").alias(i)) for n, i in (("nx", "x"), ("ny", "y")))
        near = near.drop("x", "y").join(one, "nx").join(other, "ny")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").unionByName(equal)


def similar_targets(link_rows: DataFrame, *, share: float = 0.8, k: int = 5) -> DataFrame:
    """Pairs of files whose k most frequent link targets overlap by at least `share` of the smaller set; candidates meet on their rarest targets."""
    sets = rarest_first(top_targets(link_rows, k).groupBy("rel").agg(F.collect_set("target").alias("words")))
    pairs = candidate_pairs(sets, sets, share).filter("l_rel <> r_rel").select(F.least("l_rel", "r_rel").alias("a"), F.greatest("l_rel", "r_rel").alias("b"), F.size(F.array_intersect("l_words", "r_words")).cast("long").alias("shared"), F.least(F.size("l_words"), F.size("r_words")).alias("least"))
    return pairs.withColumn("ratio", F.round(F.col("shared") / F.col("least"), 6)).filter(F.col("ratio") >= share).select("a", "b", "shared", "ratio").distinct()


def duplicate_candidates(files: DataFrame, link_rows: DataFrame) -> DataFrame:
    """CO3: near names or similar targets, with the reason; never merged here."""
    by_name = near_names(files.select(F.col("rel").alias("id"), F.col("stem").alias("name")), every=False).select("a", "b", F.lit("name").alias("reason"))
    return by_name.unionByName(similar_targets(link_rows).select("a", "b", F.lit("links").alias("reason"))).groupBy("a", "b").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def blockers(items: DataFrame, log: DataFrame, as_of: Column | None = None) -> DataFrame:
    """J17, AG20, LC5: (item, n_entries, days, stale): an item named in at least three log entries, or over more than seven days.

    Equal entries of a day are counted first.  An entry that has an item's text
    has each of its inner words whole (the first and last may be parts of
    longer ones), so items meet entries on their longest inner word; only items
    without one are compared with every different entry, and they are few.
    """
    text = F.lower("text")
    log = log.filter("text is not null").groupBy("date", text.alias("text")).agg(F.count("*").alias("n"))
    wanted = items.select("item").distinct().withColumn("low", F.lower("item"))
    runs = F.regexp_extract_all("low", F.lit("[^ ]+"), F.lit(0))
    # the words between the first and the last are whole in any text that has the item
    inner = F.when(F.size(runs) > 2, F.slice(runs, 2, F.size(runs) - 2)).otherwise(F.array().cast("array<string>"))
    wanted = wanted.withColumn("w", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"])
    word = log.select("date", "text", "n", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0)))).alias("w"))
    keyed = word.join(wanted.filter("w is not null"), "w").select("item", "low", "date", "text", "n")
    texts = log.join(wanted.filter("w is null").select("item", "low"), F.contains("text", F.col("low"))).select("item", "low", "date", "text", "n")
    named = keyed.filter(F.contains("text", F.col("low"))).unionByName(texts)
    per = named.groupBy("item").agg(F.sum("n").alias("n_entries"), F.datediff(as_of if as_of is not None else F.max("date"), F.min("date")).alias("days"))
    per = items.select("item").join(per, "item", "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
    return per.withColumn("stale", (F.col("n_entries") >= STALE_ENTRIES) | (F.coalesce("days", F.lit(0)) > STALE_DAYS))


def week_clusters(decisions: DataFrame, *, least: int = 3, share: float = 0.5, key: str = "ordinal") -> DataFrame:
    """AG21: weeks (Monday on) with at least `least` decisions that each overlap by `share` with another one of the week.

    Decisions of one week and one word set overlap wholly, so they are one row;
    only a set of a single decision looks for another set, on its rarest words.
    """
    d = decisions.select(key, F.to_date(F.date_trunc("week", "date")).alias("week"), F.array_sort(F.array_distinct(tokens("text"))).alias("words"))
    d = d.filter(F.col(key).isNotNull() & F.col("week").isNotNull() & (F.size("words") > 0))
    sets = d.groupBy("week", "words").agg(F.count_distinct(key).alias("n"), F.min(key).alias("one"))
    rare = rarest_first(sets.withColumn("key", F.col("words")), by=("week",))
    pairs = candidate_pairs(rare.filter("n = 1"), rare, share, by=("week",))
    met = pairs.filter("l_key <> r_key and (r_n > 1 or l_one <> r_one)").filter(overlap(F.col("l_words"), F.col("r_words")) >= share).withColumnRenamed("l_key", "wa")
    found = sets.filter("n > 1").select("week", "words").unionByName(met.select("week", F.col("wa").alias("words")).distinct())
    return d.join(found, ["week", "words"], "left_semi").groupBy("week").agg(F.count_distinct(key).alias("n")).filter(F.col("n") >= least)


def last_runs(runs: DataFrame, as_of: Column) -> DataFrame:
    """AG27, CO1: (op, last_ts, days, due)."""
    per = runs.groupBy("op").agg(F.max("ts").alias("last_ts"))
    return per.withColumn("days", F.datediff(as_of, "last_ts")).withColumn("due", F.col("days") > CADENCE_DAYS)


def lock_state(locks: DataFrame, as_of: Column, *, held_minutes: int = 30, cooldown_hours: int = 24) -> DataFrame:
    """PR18: (op, lock_ts, last_ok) -> state (held, stale, free) and whether the cooldown asks."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("lock_ts")
    state = F.when(F.col("lock_ts").isNull(), "free").when(age < held_minutes * 60, "held").otherwise("stale")
    cool = F.coalesce(F.unix_timestamp(as_of) - F.unix_timestamp("last_ok") < cooldown_hours * 3600, F.lit(False))
    return locks.withColumn("state", state).withColumn("cooling_down", cool)


def drift(files: DataFrame, status: DataFrame, key: str = "corpus") -> DataFrame:
    """Corpora where a file is more than five minutes newer than the status file."""
    newest = files.groupBy(key).agg(F.max("mtime").alias("newest"))
    return newest.join(status.select(key, F.col("mtime").alias("status_mtime")), key).withColumn("unclean", F.unix_timestamp("newest") - F.unix_timestamp("status_mtime") > DRIFT_SECONDS)


def pressure(n_lines: Column) -> Column:
    """CO2: skip below 60 lines, warn from 95, compress between."""
    return F.when(n_lines < COMPRESS_FROM, "skip").when(n_lines >= COMPRESS_WARN, "warn").otherwise("compress")


def upgrade_plan(signals: DataFrame, current: str = "2.1.3") -> DataFrame:
    """UP1-UP6: signals (corpus, managed, summary_format, n_missing, index_format, n_large, memory_index) -> ordered steps; nothing when current.

    Resummarising comes before reindexing, the marker last.
    """
    old = F.coalesce(version("managed") < version(F.lit(current)), F.lit(True))
    pre = F.coalesce(version("managed") < version(F.lit("2.1.0")), F.lit(True))
    steps = F.array_compact(F.array(
        F.when(F.coalesce(F.col("summary_format"), F.lit(0)) < 2, "resummarize"),
        F.when(F.col("n_missing") > 0, "reindex"),
        F.when(F.coalesce(version("index_format") < version(F.lit("1.1")), F.lit(False)) & (F.col("n_large") > 0), "reindex --force"),
        F.when(~F.col("memory_index") & pre, "reindex memory"),
        F.when(old, "marker"),
    ))
    return signals.select("corpus", F.posexplode(steps).alias("at", "step")).select("corpus", (F.col("at") + 1).alias("ordinal"), "step")


#: The suggestion for each failed check.
ACTIONS = (
    ("summary_format", "resummarize"), ("coverage", "reindex"), ("decisions", "annotate superseded decisions"), ("orphan_files", "register or remove"),
    ("orphan_folders", "add as a collection"), ("typed_edges", "fix the front matter reference"), ("freshness", "update the status"), ("blockers", "resolve or restate"), ("catalog", "update the catalog"),
)


def next_actions(findings: DataFrame) -> DataFrame:
    """LC10: one suggestion for each failed check, and the combined upgrade where both index checks fail."""
    spark = findings.sparkSession
    failed = findings.filter(F.col("severity") != "PASS").select("check").distinct()
    rules = spark.createDataFrame(list(ACTIONS), "check string, action string")
    single = failed.join(F.broadcast(rules), "check").select("check", "action")
    both = failed.filter(F.col("check").isin("summary_format", "coverage")).agg(F.count("*").alias("n")).filter("n = 2").select(F.lit("upgrade").alias("check"), F.lit("upgrade, which does both in order").alias("action"))
    return single.unionByName(both)


def report_totals(findings: DataFrame) -> DataFrame:
    """AG22"""
    return findings.agg(F.count_if(F.col("severity") == "WARN").alias("warnings"), F.count_if(F.col("severity") == "INFO").alias("infos"), F.count_distinct("check").alias("checks"))


def without_dead_entries(entries: DataFrame, there: DataFrame, key: str = "key") -> DataFrame:
    """LC11: the safe fix: index entries that point to a file."""
    return entries.join(there.select(key).distinct(), key, "left_semi")


def report_lines(findings: DataFrame) -> DataFrame:
    """SK12: (check, ordinal, line) of a printed report, and PASS for a check without findings."""
    spark = findings.sparkSession
    checks = spark.createDataFrame([(c,) for c, _ in ACTIONS], "check string")
    w = Window.partitionBy("check").orderBy("severity", "subject", "detail")
    found = findings.select("check", F.row_number().over(w).alias("ordinal"), F.format_string("  [%s] %s -- %s", "severity", "subject", "detail").alias("line"))
    return found.unionByName(checks.join(findings.select("check").distinct(), "check", "left_anti").select("check", F.lit(1).alias("ordinal"), F.lit("  PASS").alias("line")))


def stale_texts(rows: DataFrame, text: str = "content") -> DataFrame:
    """PF26: rows with a stale marker."""
    return rows.filter(any_phrase(text, P.STALE_MARKERS))


#: Lead-ins that a summary must not have.
VAGUE = ("this file", "this document", "a file", "notes about", "various", "miscellaneous")


def summary_rules(rows: DataFrame, summary: str = "summary") -> DataFrame:
    """EX16: the checkable rules: at most 250 characters, no vague lead-in."""
    vague = F.rlike(F.lower(summary), F.lit("^(" + "|".join(VAGUE) + r")\b"))
    return rows.withColumn("too_long", F.length(summary) > 250).withColumn("vague", vague)
