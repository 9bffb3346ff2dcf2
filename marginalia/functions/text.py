"""Text functions on columns: tokens, names, links, code and front matter, cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of all kinds off both ends (trim() takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def rstrip_chars(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def found(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def tokens(c: Column | str) -> Column:
    """EX12: ASCII words, lower-cased after extraction, without stop words and single characters."""
    words = F.transform(found(F.coalesce(col(c), F.lit("")), "[A-Za-z0-9]+"), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(P.STOP_WORDS))


def stem(base: Column | str) -> Column:
    """PF1: the base name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(col(base), r"(?<=.)\.[^.]*$", "")


def base_name(rel: Column | str) -> Column:
    return F.element_at(F.split(col(rel), "/"), -1)


def folder(rel: Column | str) -> Column:
    """The folder part, "." at the root."""
    return F.when(F.locate("/", col(rel)) > 0, F.regexp_replace(col(rel), "/[^/]*$", "")).otherwise(F.lit("."))


def path_keys(rel: Column | str) -> Column:
    """PF2: the lower-cased path, with and without its extension."""
    rel = F.lower(col(rel))
    return F.array_distinct(F.array(rel, F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", "")))


def without_code(c: Column | str) -> Column:
    """PF3: four-tick fences, three-tick fences, inline code, in this order."""
    return reduce(lambda text, pattern: F.regexp_replace(text, pattern, ""), P.CODE, col(c))


def without_front_matter(c: Column | str) -> Column:
    """PF4: up to the first --- after the opening one, wherever it stands."""
    c = col(c)
    end = F.locate("---", c, 4)
    return F.when(c.startswith("---") & (end > 0), F.substr(c, end + 3)).otherwise(c)


def front_matter(c: Column | str) -> Column:
    """PF5: what stands between the opening --- and a line that starts with ---; null if there is none."""
    c = col(c)
    end = F.locate("\n---", c, 4)
    return F.when(c.startswith("---") & (end > 0), strip(F.substr(c, F.lit(4), end - 4)))


def links(c: Column | str) -> Column:
    """PF6: targets of [[target]] and [[target|alias]], trimmed."""
    return F.transform(found(c, P.LINK, 1), strip)


def link_stem(c: Column | str) -> Column:
    """PF7: without a trailing .md in any case; other dots stay."""
    return F.regexp_replace(col(c), r"(?i)\.md$", "")


def is_index_file(base: Column | str) -> Column:
    """PF8"""
    return col(base).isin(*P.INDEX_FILES)


def skipped(rel: Column | str, prefixes: tuple[str, ...] | list[str]) -> Column:
    """PF9: starts with one of the prefixes; each is taken as a folder."""
    return reduce(lambda a, b: a | b, [col(rel).startswith(p if p.endswith("/") else p + "/") for p in prefixes], F.lit(False))


def clean_line(c: Column | str) -> Column:
    """PF13: without URLs, links and comments of one line."""
    return reduce(lambda text, pattern: F.regexp_replace(text, pattern, ""), (r"https?://\S+", r"\[\[[^\]]+\]\]", r"<!--.*?-->"), col(c))


def unquoted(c: Column | str) -> Column:
    """PF15: one quote off each end, mixed quotes too; a single quote character is empty."""
    c = col(c)
    return F.when(c.isin("'", '"'), F.lit("")).otherwise(F.regexp_replace(c, r"""^['"]([\s\S]*)['"]$""", "$1"))


def contains_literal(c: Column | str, query: str, mode: str = "literal") -> Column:
    """PF18: case-insensitive match; a literal by default, a regular expression on demand."""
    return F.contains(F.lower(col(c)), F.lit(query.lower())) if mode == "literal" else F.rlike(col(c), F.lit("(?i)" + query))


def any_phrase(c: Column | str, phrases: tuple[str, ...] | list[str]) -> Column:
    """PF25, PF26: one of the phrases as whole words, in any case."""
    return F.rlike(col(c), F.lit(r"(?i)\b(" + "|".join(phrases) + r")\b"))


def has_placeholder(c: Column | str) -> Column:
    """PF27"""
    return F.rlike(col(c), F.lit(r"\{\{.*\}\}"))


def slug(c: Column | str) -> Column:
    """PF28: lower case, everything else one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def version(c: Column | str) -> Column:
    """"2.1.3" as [2, 1, 3]; arrays compare number by number."""
    return F.transform(F.split(col(c), "[.]"), lambda x: x.cast("int"))


def marker(c: Column | str, name: str) -> Column:
    """The value of a comment like <!-- x-name:1.2 -->, null if there is none; the product prefix may be any."""
    value = F.regexp_extract(col(c), rf"<!--\s*(?:[a-z]+-)?{name}:([0-9.]+)", 1)
    return F.when(value != "", value)


def fields(c: Column | str) -> Column:
    """EX13: the parts between bars, trimmed, without empty ones; a text without parts is one part."""
    parts = F.filter(F.transform(F.split(col(c), r"\s+\|\s+"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.coalesce(col(c), F.lit(""))))


def clean_summary(c: Column | str) -> Column:
    """EX15: without an echoed lead-in, tried once each in this order."""
    def drop(text: Column, lead: str) -> Column:
        return F.when(text.startswith(lead), strip(F.substr(text, F.lit(len(lead) + 1)))).otherwise(text)

    return reduce(drop, ("One-line summary:", "Summary:", "- "), strip(c))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
