"""Session lifecycle: logs, decisions, ideas, archive, collections, state (PR4-PR10, WN7-WN9, SK8-SK10, J20, J22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug, version

LOG_CAP, LATEST = 10, 5


def newest(rows: DataFrame, by: str | None, *order: Column | str, k: int) -> DataFrame:
    """The first k of each group in the given order, with their place."""
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def rotated(log: DataFrame, by: str, *order: Column | str, cap: int = LOG_CAP) -> DataFrame:
    """WN7: every entry with `archived` for those beyond the newest `cap`."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("archived", F.col("place") > cap)


def prepended(log: DataFrame, entry: DataFrame) -> DataFrame:
    """SK8: new entries (few, with ordinals among themselves) on top; the log's ordinals go up by their number."""
    added = entry.agg(F.count("*").alias("_added"))
    moved = log.crossJoin(F.broadcast(added)).withColumn("ordinal", (F.col("ordinal") + F.col("_added")).cast("int")).drop("_added")
    return entry.unionByName(moved, allowMissingColumns=True)


def appended(decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """SK8: new decisions (few) after the last one."""
    last = decisions.agg(F.coalesce(F.max("ordinal"), F.lit(0)).alias("_last"))
    numbered = entries.withColumn("_k", F.row_number().over(Window.orderBy("date", "text"))).crossJoin(F.broadcast(last)).withColumn("ordinal", (F.col("_last") + F.col("_k")).cast("int")).drop("_last", "_k")
    return decisions.unionByName(numbered, allowMissingColumns=True)


def substance(content: Column) -> Column:
    """SK9: a hash of the status without its date line."""
    return F.sha2(F.regexp_replace(content, r"(?m)^.*Last updated:.*$\n?", ""), 256)


def changed(old: DataFrame, new: DataFrame, key: str = "rel") -> DataFrame:
    """SK9: the new rows that are worth writing: new keys, or another substance."""
    before = old.select(key, substance(F.col("content")).alias("before"))
    return new.join(before, key, "left").filter(F.col("before").isNull() | (F.col("before") != substance(F.col("content")))).drop("before")


def scaffolded(templates: DataFrame, values: dict[str, str]) -> DataFrame:
    """SK10: (rel, content, last) with {{placeholders}} filled; the catalog is written last."""
    content = F.col("content")
    for name, value in values.items():
        content = F.replace(content, F.lit("{{" + name + "}}"), F.lit(value))
    return templates.withColumn("content", content).withColumn("last", F.col("rel") == "_MANIFEST.md")


def archived(catalog: DataFrame, link: str, reason: str, date: str) -> DataFrame:
    """PR9: an entry of tier 2 moves to tier 3 with reason and date; tier 1 is refused."""
    hit = F.col("link") == link
    if not catalog.filter(hit & (F.col("tier") == 1)).isEmpty():
        raise ValueError(f"{link}: tier 1 is not archived")
    moved = hit & (F.col("tier") == 2)
    return catalog.withColumns({"reason": F.when(moved, F.lit(reason)).otherwise(F.col("reason")), "date": F.when(moved, F.lit(date)).otherwise(F.col("date")), "tier": F.when(moved, F.lit(3)).otherwise(F.col("tier"))})


def add_collection(hubs: DataFrame, name: str, summary: str) -> DataFrame:
    """PR10: a catalog row for a new collection under its slug; a taken slug is refused."""
    spark = hubs.sparkSession
    row = spark.createDataFrame([(name, summary)], "name string, summary string").select(slug("name").alias("folder"), F.concat(slug("name"), F.lit("/_CLOSETS")).alias("link"), "summary")
    if not row.join(hubs, "folder", "left_semi").isEmpty():
        raise ValueError(f"{name!r}: the collection exists")
    return hubs.unionByName(row, allowMissingColumns=True)


def similar_slugs(hubs: DataFrame, name: str, most: int = 2) -> DataFrame:
    """PR10: collections whose slug is within two edits of a new one's."""
    return hubs.withColumn("distance", F.levenshtein("folder", slug(F.lit(name)), most)).filter(F.col("distance") >= 0)


def workspace_state(n_markdown: Column, has_catalog: Column, managed: Column, current: str = "2.1.3") -> Column:
    """PF29: empty, files only, compatible, old or current."""
    return F.when(~has_catalog & (n_markdown == 0), "empty").when(~has_catalog, "files").when(managed.isNull(), "compatible").when(version(managed) < version(F.lit(current)), "old").otherwise("current")


def routed(ideas: DataFrame, hubs: DataFrame) -> DataFrame:
    """An idea's route if it names a collection, else the collection whose name its title or body has, else unrouted."""
    direct = ideas.join(hubs.select("folder"), F.lower("route") == F.lower("folder"), "left").withColumnRenamed("folder", "direct")
    words = direct.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "body")), F.lit("[a-z0-9-]+"), F.lit(0)))))
    keyed = words.join(hubs.select(F.lower("folder").alias("w"), F.col("folder").alias("keyed")), "w").groupBy("title").agg(F.min("keyed").alias("keyed"))
    return direct.join(keyed, "title", "left").withColumn("collection", F.coalesce("direct", "keyed", F.lit("unrouted"))).drop("direct", "keyed")


def resolved_paths(configured: DataFrame, conventional: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """(name, path): configuration before convention before search."""
    rows = configured.select(key, "path", F.lit(1).alias("priority")).union(conventional.select(key, "path", F.lit(2))).union(found.select(key, "path", F.lit(3)))
    return rows.groupBy(key).agg(F.min_by("path", F.struct("priority", "path")).alias("path"), F.min("priority").alias("priority"))


def first_of_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """AG26: unique by key, the first in order stays."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("k = 1").drop("k")


def first_of_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """AG26: the least `order` of each different text; only lengths and hashes of the texts are shuffled."""
    keyed = rows.select(F.length(text).alias("_length"), F.sha2(F.col(text).cast("binary"), 256).alias("_hash"), order)
    return keyed.groupBy("_length", "_hash").agg(F.min(order).alias(order)).select(order)


def work_list(wanted: DataFrame, cached: DataFrame, key: str = "session_id") -> DataFrame:
    """ST7: what is wanted and not yet cached."""
    return wanted.join(cached.filter("text is not null").select(key), key, "left_anti")


def copies_differ(owners: DataFrame, copies: DataFrame, key: str = "name") -> DataFrame:
    """Copies whose bytes differ from their owner's."""
    a = owners.select(key, F.sha2("content", 256).alias("own"))
    return copies.withColumn("copy", F.sha2("content", 256)).join(a, key).withColumn("differs", F.col("own") != F.col("copy")).drop("own", "copy")


def self_test(conditions: dict[str, Column], row: DataFrame) -> DataFrame:
    """SE1: (check, ok) of each post-condition over a one-row frame."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("ok")) for k, c in conditions.items()])).alias("c")).select("c.*")


def listing(files: DataFrame, most: int = 200) -> DataFrame:
    """SC15: the first paths in order."""
    return files.select("rel").orderBy("rel").limit(most)


def summary_layers(catalog: DataFrame, members: DataFrame) -> DataFrame:
    """PR14: (layer, link) in the order they are summarised: tier 1, collection heads, members."""
    tier1 = catalog.filter("tier = 1").select(F.lit(1).alias("layer"), "link")
    heads = catalog.filter("folder is not null").select(F.lit(2).alias("layer"), "link")
    return tier1.union(heads).union(members.select(F.lit(3).alias("layer"), F.col("link")))


def captured(ideas: DataFrame, title: str, date: str, body: str, route: str | None = None) -> DataFrame:
    """PR8: the inbox with a new idea."""
    new = ideas.sparkSession.createDataFrame([(title, date, body, route)], "title string, date string, body string, route string").withColumn("date", F.to_date("date"))
    return ideas.unionByName(new, allowMissingColumns=True)
