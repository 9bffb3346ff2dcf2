"""Facet extraction: typed fields of sessions and texts (EX1-EX11, EX14).

Field extractors are projections from text to array<string>: patterns in
order, then place in the text, first occurrence of each case-folded phrase,
cut at a cap.  Sessions are rows (session_id, turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import patterns as P
from .text import found, rstrip_chars, strip

ENTRY_CAP = 1500
#: What each pattern of P.DATES begins with, looked for before its word bound and alternatives are tried.
#: A long s is an s where case is ignored; \p{Nd} is what \d is under (?U).
DATE_LEADS = (
    "(?=[JFMASONDjfmasond\u017f][AEPUCOaepuco])", "(?=May)", "(?=[12])", "(?=[MTWFSmtwfs\u017f][OUEHRAouehra])", "(?=[YTLNytln][EOHAeoha])",
    *[r"(?=\p{Nd})"] * 3, "(?=[0-9])", r"(?=\p{Nd})",
)


def _unicode(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iuU)", 1) if pattern.startswith("(?i)") else "(?m)(?U)" + pattern[4:] if pattern.startswith("(?m)") else "(?U)" + pattern


def first_of_each(phrases: Column, cap: int) -> Column:
    """The first occurrence of each case-folded phrase, in order, at most `cap`."""
    kept = F.aggregate(phrases, F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen")), lambda s, p: F.when(F.array_contains(s["seen"], F.lower(p)) | (F.size(s["out"]) >= cap), s).otherwise(F.struct(F.array_append(s["out"], p).alias("out"), F.array_append(s["seen"], F.lower(p)).alias("seen"))))
    return kept["out"]


def phrases(text: Column, families: tuple[str, ...], trim: str, leads: tuple[str, ...] = ()) -> Column:
    every = F.flatten(F.array(*[found(text, lead + _unicode(p)) for p, lead in zip(families, leads or [""] * len(families), strict=True)]))
    return F.transform(every, lambda p: rstrip_chars(strip(p), trim))


def claims(user_text: Column, cap: int = 6) -> Column:
    """EX9"""
    return first_of_each(phrases(user_text, P.CLAIMS, ".,!?"), cap)


def decisions(text: Column, cap: int = 4) -> Column:
    """EX10"""
    return first_of_each(phrases(text, P.DECISIONS, ".,!?"), cap)


def dates(text: Column, cap: int = 10) -> Column:
    """EX11"""
    every = F.transform(phrases(text, P.DATES, ".,!?;:", DATE_LEADS), lambda p: F.regexp_replace(p, r"\s+", " "))
    return first_of_each(F.filter(every, lambda p: F.length(p) >= 3), cap)


def weighted_names(text: Column) -> Column:
    """The signals of EX8 in order: capitalised phrases 2, names after a relation 3, named 3."""
    blocked = F.array(*[F.lit(n) for n in P.NOT_NAMES])
    capitals = F.filter(found(text, _unicode(P.CAPITALIZED)), lambda m: ~F.array_contains(blocked, F.regexp_substr(m, F.lit(r"^\S+"))) & (F.length(m) >= 3))
    related = F.filter(F.transform(found(text, _unicode(P.RELATION_NAME), 1), lambda m: F.initcap(strip(m))), lambda m: ~F.array_contains(blocked, m) & (F.length(m) >= 3))
    named = F.filter(F.transform(found(text, _unicode(P.NAMED), 1), lambda m: F.initcap(strip(m))), lambda m: ~F.array_contains(blocked, m) & (m != ""))
    weigh = lambda names, w: F.transform(names, lambda m: F.struct(m.alias("name"), F.lit(w).alias("w")))
    return F.concat(weigh(capitals, 2), weigh(related, 3), weigh(named, 3))


def heaviest(rows: DataFrame, key: str, weighted: Column, cap: int, name: str) -> DataFrame:
    """(key, name): names of array<struct<name, w>> by summed weight, ties by first place, at most `cap` (AG9, AG10).

    Aggregated over rows, so a long text costs its names once, not squared.
    """
    spread = rows.select(key, F.posexplode(weighted).alias("at", "x")).groupBy(key, F.col("x.name").alias("name")).agg(F.sum("x.w").alias("w"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "at", "name"))
    first = spread.withColumn("place", place).filter(F.col("place") <= cap)
    top = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias(name))
    return rows.select(key).join(top, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def people(rows: DataFrame, key: str, text: str, cap: int = 8) -> DataFrame:
    """EX8: (key, people)."""
    return heaviest(rows, key, weighted_names(F.col(text)), cap, "people")


def acronyms(rows: DataFrame, key: str, text: str, cap: int = 8) -> DataFrame:
    """AG10: (key, acronyms): the most frequent, cut before the block list is applied."""
    every = F.transform(found(F.col(text), _unicode(P.CAPITALS)), lambda m: F.struct(m.alias("name"), F.lit(1).alias("w")))
    return heaviest(rows, key, every, cap, "acronyms").withColumn("acronyms", F.filter("acronyms", lambda t: ~t.isin(*P.NOT_CAPITALS)))


def first_sentence(text: Column, cap: int = 120) -> Column:
    """WN11: up to the first sentence end, at most `cap` characters."""
    return F.left(F.split(strip(text), r"(?<=[.!?])\s+")[0], F.lit(cap))


def subjects(user_turns: Column, full: Column, acronyms: Column, cap: int = 12) -> Column:
    """EX7: user first sentences, quoted strings, list items, headings, frequent acronyms."""
    sentences = F.transform(F.filter(F.transform(user_turns, strip), lambda t: t != ""), lambda t: first_sentence(t))
    every = F.flatten(F.array(sentences, found(full, P.QUOTED, 1), found(full, _unicode(P.LIST_ITEM), 1), found(full, _unicode(P.HEADING), 1), acronyms))
    every = F.transform(every, lambda p: rstrip_chars(strip(p), ".,!?;:"))
    return first_of_each(F.filter(every, lambda p: F.length(p) >= 4), cap)


def sessions(turns: DataFrame) -> DataFrame:
    """One row a session: EX1-EX3, EX14 and the texts that the field extractors read."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    s = turns.groupBy("session_id").agg(ordered.alias("turns"))

    def of(role: str) -> Column:
        return F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])

    users, assistants, first = of("user"), of("assistant"), lambda a: F.coalesce(F.get(a, F.lit(0)), F.lit(""))
    content = F.array_join(F.transform("turns", lambda t: t["text"]), "\n")
    transcript = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("["), F.coalesce(t["role"], F.lit("?")), F.lit("] "), t["text"])), "\n")
    return s.select(
        "session_id", F.size("turns").cast("long").alias("n_turns"), content.alias("content"),
        F.concat(F.left(first(users), F.lit(250)), F.lit(" | "), F.left(first(assistants), F.lit(250))).alias("summary"),
        first(users).alias("firstmsg"), F.when(F.length(transcript) > 8000, F.concat(F.left(transcript, F.lit(8000)), F.lit("...[truncated]"))).otherwise(transcript).alias("transcript"),
        users.alias("user_turns"), F.array_join(users, "\n").alias("user_text"), F.array_join(assistants, "\n").alias("assistant_text"),
    )


def facets(turns: DataFrame) -> DataFrame:
    """EX6: (session_id, subjects, people, claims, decisions, dates, entry)."""
    s = sessions(turns).withColumn("full", F.concat("user_text", F.lit("\n"), "assistant_text"))
    s = s.join(acronyms(s, "session_id", "content"), "session_id").join(people(s, "session_id", "full"), "session_id")
    s = s.select("session_id", subjects(F.col("user_turns"), F.col("content"), F.col("acronyms")).alias("subjects"), "people", claims(F.col("user_text")).alias("claims"), decisions(F.concat("assistant_text", F.lit("\n"), "user_text")).alias("decisions"), dates(F.col("full")).alias("dates"))
    parts = [F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: "), F.array_join(name, sep))) for name, sep in (("subjects", "; "), ("people", ", "), ("claims", "; "), ("decisions", "; "), ("dates", "; "))]
    entry = F.concat_ws(" | ", *parts)
    return s.withColumn("entry", F.when(F.length(entry) > ENTRY_CAP, F.concat(F.left(entry, F.lit(ENTRY_CAP)), F.lit("..."))).otherwise(entry))


def long_facets(facet_rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Field-level rows (key, field, ordinal, value)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in ("subjects", "people", "claims", "decisions", "dates")])
    return facet_rows.select(key, F.explode(fields).alias("f")).select(key, "f.field", F.posexplode("f.values").alias("ordinal", "value"))


EXTRACTORS = {"content": "content", "summary": "summary", "firstmsg": "firstmsg"}


def extracted(turns: DataFrame, name: str, supplied: DataFrame | None = None) -> DataFrame:
    """EX1-EX5 by name: (session_id, text); `haiku` and `closets` come from a supplied table or, for the latter, from EX6."""
    if name in EXTRACTORS:
        return sessions(turns).select("session_id", F.col(EXTRACTORS[name]).alias("text"))
    if supplied is not None:
        return turns.select("session_id").distinct().join(supplied, "session_id", "left").select("session_id", "text")
    if name == "closets":
        return facets(turns).select("session_id", F.col("entry").alias("text"))
    raise KeyError(name)
