"""Pairs of sets with a wanted overlap, without comparing all pairs.

Elements are ordered by ascending frequency.  If two sets share a fraction of
the smaller one, one of the smaller one's rarest elements is among what they
share; so only each set's rarest elements are joined with all elements of the
others, and an element that most sets have brings no pairs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rarest_first(sets: DataFrame, frequency_of: DataFrame | None = None, *, words: str = "words", by: tuple[str, ...] = ()) -> DataFrame:
    """The sets with their elements in the order of how many sets (within `by`) have them; empty sets go."""
    counted = (frequency_of if frequency_of is not None else sets).select(*by, F.explode(words).alias("_w")).groupBy(*by, "_w").agg(F.count("*").alias("_n"))
    rest = [c for c in sets.columns if c != words]
    rows = sets.select(*rest, F.explode(words).alias("_w")).join(counted, [*by, "_w"])
    return rows.groupBy(*rest).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_w"))), lambda x: x["_w"]).alias(words))


def prefix(words: str, share: float) -> Column:
    """The elements of which a pair with that share of this set, the smaller one, has at least one."""
    size = F.size(words)
    return F.slice(words, 1, F.greatest(size - F.ceil(F.lit(share) * size - 1e-9).cast("int") + 1, F.lit(1)))


def candidate_pairs(left: DataFrame, right: DataFrame, share: float, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides (columns prefixed l_ and r_) that share an element which the smaller side's prefix has; pairs may repeat."""

    def side(df: DataFrame, p: str, elements: Column) -> DataFrame:
        return df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by], F.explode(elements).alias("_w"))

    one = side(left, "l", prefix("words", share)).join(side(right, "r", F.col("words")), [*by, "_w"]).filter("size(l_words) <= size(r_words)")
    other = side(left, "l", F.col("words")).join(side(right, "r", prefix("words", share)), [*by, "_w"]).filter("size(r_words) < size(l_words)")
    return one.unionByName(other).drop("_w")


#: A word that more sets have is met in so many groups of sets.
GROUP_SETS = 256


def similar_pairs(left: DataFrame, right: DataFrame, similar: float) -> DataFrame:
    """Rows of both sides (prefixed l_ and r_) with a Jaccard similarity of at least `similar`; pairs may repeat.

    Such sets share that part of either one, so their rarest elements meet.
    The left sets that have a word are dealt out in groups, for words are few
    where sets are alike, and small tables would be compared in one task.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.explode(prefix("words", similar)).alias("_w"))

    one, other = side(left, "l"), side(right, "r")
    groups = one.groupBy("_w").agg((F.floor(F.count("*") / GROUP_SETS) + 1).cast("int").alias("_groups"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = one.join(groups, "_w").withColumn("_group", F.pmod(F.xxhash64("l_words"), F.col("_groups")).cast("int")).drop("_groups").repartition(parts, "_w", "_group")
    other = other.join(groups, "_w").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups").repartition(parts, "_w", "_group")
    both = F.size(F.array_intersect("l_words", "r_words"))
    sizes = (F.size("l_words") >= similar * F.size("r_words")) & (F.size("r_words") >= similar * F.size("l_words"))
    return one.join(other, ["_w", "_group"]).filter(sizes).filter(both >= similar * (F.size("l_words") + F.size("r_words") - both)).drop("_w", "_group")
