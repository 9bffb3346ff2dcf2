"""Chains of overridden decisions followed to their ends (J15, J16, PR7).

Every item names at most one that took its place, so the links are a forest,
but for cycles.  Pointers are doubled: a round replaces where an item points
by where that one points, so chains of up to n links take log2(n) + 1 rounds of
one equality join, whatever their number.  Only items that have not reached an
end look on.  In a round in which none arrives, those left lead
into cycles; they go on for as many rounds as tell a cycle from the way to it.

An item that many point to is one row on its side of the join; adaptive
execution splits the other side by skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def ends(links: DataFrame, *, item: str = "item", by: str = "by") -> DataFrame:
    """(item, last, steps, cycle) for every item that something took the place of.

    `last` is the item at the end of its chain and `steps` how far that is.
    Items of a cycle, and those that lead into one, have no last and no steps;
    `cycle` is the smallest item of the cycle, else null.  Of several links
    from one item the one to the largest counts; links from or to null and
    from an item to itself are left out.
    """
    one = links.select(F.col(item).alias("item"), F.col(by).alias("to")).filter("item is not null and to is not null and item <> to")
    one = one.groupBy("item").agg(F.max("to").alias("to"))
    items = one.select(F.col("item").alias("to"), F.lit(False).alias("arrived"))
    state = settled(one.join(items, "to", "left").select("item", "to", F.lit(1).cast("long").alias("steps"), F.coalesce("arrived", F.lit(True)).alias("arrived")))
    n, left = state.filter("not arrived").count(), -1
    while n and n != left:
        there = state.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("arrived").alias("there"))
        moved = state.filter("not arrived").join(there, "to").select("item", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("arrived"))
        state = settled(state.filter("arrived").unionByName(moved))
        n, left = state.filter("not arrived").count(), n
    done, going = state.filter("arrived"), state.filter("not arrived")
    last = done.select("item", F.col("to").alias("last"), "steps", F.lit(None).cast(one.schema["item"].dataType).alias("cycle"))
    if n == 0:
        return last
    return last.unionByName(_cycles(one.join(going.select("item"), "item", "left_semi"), n).select("item", F.lit(None).cast(one.schema["to"].dataType).alias("last"), F.lit(None).cast("long").alias("steps"), "cycle"))


def _cycles(links: DataFrame, n: int) -> DataFrame:
    """(item, cycle) of items that all lead into cycles: after n steps every pointer is on one."""
    state = settled(links.withColumn("low", F.col("item")))
    for _ in range(n.bit_length()):
        there = state.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        state = settled(state.join(there, "to").select("item", F.col("next").alias("to"), F.least("low", "next_low").alias("low")))
    # the steps from an item on a cycle have been all around it
    return state.select("item", "to").join(state.select(F.col("item").alias("to"), F.col("low").alias("cycle")), "to").select("item", "cycle")
