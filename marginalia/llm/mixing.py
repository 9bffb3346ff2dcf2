"""Mixing sources to target weights by Pareto order sampling.

Sources get targets by weight with water filling (no source above
`max_copies` times its size).  Within a source a document's expected copies
are in proportion to its weight, at most `max_copies`, and the source's rate
is such that the expected words are its target: what the most heavily weighted
documents can't take goes to the others.  Weights count in steps of 2 ** (1 /
`STEPS`), so a source's rate comes from one bounded histogram.

Whole copies are certain; the fraction is an inclusion probability p, and
documents are ranked by [u/(1-u)] / [p/(1-p)] with a seeded uniform u.  Of each
source the lowest ranks are taken until its words are spent: a sample of fixed
size (in words) with unequal probabilities.

The cut of each source is found digit by digit: word sums over the rank's
leading bits name the part that holds the cut, the next digit is looked at
within it only, until a source's part has at most `LEAST_ROWS` rows; so no task
orders more than that, however large or tied a source is.

Defined results: null text has size 0; null sources form one source, ordered
last; null or non-positive weights count as 0 and are taken 0 times; u comes
from the identifier, and from the whole record where that is null; rows that
share u (repeated identifiers) are ordered by a hash of the record; of wholly
equal rows as many are taken as the target has room for; very long texts are
counted whole; an empty table gives an empty table.  Only the named columns
are read, the input record is carried as a struct, so extra columns can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, scratch, staged, word_count

WEIGHTS = (3, 1, 2)
#: Weight steps in a doubling.
STEPS = 16
#: Bits looked at in a round, rows of a source's part that one task may order, and rows made at a time of equal ones.
DIGIT, LEAST_ROWS, EQUAL_ROWS = 8, 500, 100_000
#: With at most so many sources (some 100 bytes each) their table is broadcast; beyond that it is joined by shuffle.
BROADCAST_SOURCES = 200_000


def source_targets(sizes: DataFrame, *, share: float = 1.5, max_copies: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> + target.  Works on one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    t = sizes.withColumn("w", turn).withColumn("cap", F.lit(max_copies) * F.col("source_size")).withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
    # sources fill up in ascending order of cap / weight; the level is that of the first one that doesn't
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("rn", F.row_number().over(fill))
    t = t.withColumn("final", F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("rn", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("cap") <= F.col("final") * F.col("w")), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def seeded_uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of md5("seed:key")."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_rates(histogram: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """(source, source_size, target, rate, budget): expected copies are rate * weight, at most max_copies; budget is what whole copies leave."""
    h = histogram.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumn("w", step_weight(F.col("step")))
    by = Window.partitionBy("source").orderBy(F.desc("w"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # with the heavier steps full, the rate that spends the rest of the target; the first that fills no further step holds
    h = h.withColumn("level", F.try_divide(F.col("target") - max_copies * F.coalesce(F.sum("words").over(before), F.lit(0)), F.sum(F.col("w") * F.col("words")).over(rest)))
    h = h.withColumn("fits", F.col("level") * F.col("w") <= max_copies)
    rate = F.coalesce(F.max_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("w"))).over(Window.partitionBy("source")), F.lit(float("inf")))
    h = h.withColumn("rate", rate).withColumn("certain", F.floor(expected_copies(F.col("rate"), F.col("w"), max_copies)) * F.col("words"))
    return h.groupBy("source", "source_size", "target").agg(F.first("rate").alias("rate"), F.sum("certain").alias("certain")).select("source", "source_size", "target", "rate", (F.col("target") - F.col("certain")).alias("budget"))


def weight_step(weight: Column) -> Column:
    return F.when(weight > 0, F.round(STEPS * F.log2(weight))).cast("int")


def step_weight(step: Column) -> Column:
    return F.coalesce(F.pow(F.lit(2.0), step / F.lit(float(STEPS))), F.lit(0.0))


def expected_copies(rate: Column, weight: Column, max_copies: float) -> Column:
    return F.when(weight > 0, F.least(F.lit(float(max_copies)), rate * weight)).otherwise(0.0)


#: (column, bits to the right, mask) of every digit of the order: 52 bits of the rank, then 63 of the record's hash.
DIGITS = [("key", max(0, 52 - DIGIT * k), (1 << min(DIGIT, 52 - DIGIT * (k - 1))) - 1) for k in range(1, -(-52 // DIGIT) + 1)]
DIGITS += [("hash", max(0, 63 - DIGIT * k), (1 << min(DIGIT, 63 - DIGIT * (k - 1))) - 1) for k in range(1, -(-63 // DIGIT) + 1)]


def mix_sources(docs: DataFrame, *, seed: int = 7, share: float = 1.5, max_copies: float = 2.0, weights: tuple[int, ...] = WEIGHTS, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (record struct, size, source_size, target, copies) for every document; copies may be 0."""
    prepare(docs.sparkSession)
    record = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(record.alias("record"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), weight_step(F.lit(1.0) if weight is None else weight.cast("double")).alias("step"), F.expr("0L").alias("hash"), docs[id_col].alias("id"))
    rows = rows.withColumn("hash", F.xxhash64("record").bitwiseAND(F.lit((1 << 63) - 1)))
    rows = rows.withColumn("u", seeded_uniform(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.col("hash").cast("string"))), seed)).drop("id")

    def with_sources(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    def ranked(df: DataFrame) -> DataFrame:
        expected = expected_copies(F.col("rate"), step_weight(F.col("step")), max_copies)
        df = with_sources(df, rates).withColumn("whole", F.floor(expected).cast("long")).withColumn("p", expected - F.floor(expected))
        rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        return df.withColumn("key", F.when(F.col("p") > 0, F.floor(rank / (1 + rank) * F.lit(float(1 << 52))).cast("long")))

    with scratch(docs.sparkSession):
        thin = staged(rows.drop("record"), "mix-thin")
        histogram = staged(thin.groupBy("source", "step").agg(F.sum("size").alias("words")), "mix-steps")
        targets = source_targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), share=share, max_copies=max_copies, weights=weights)
        rates = staged(source_rates(histogram, targets, max_copies), "mix-rates", result=True)
        small = rates.count() <= BROADCAST_SOURCES
        edge = ranked(thin).filter("key is not null").select("source", "size", "key", "hash", "budget", F.lit(0).cast("long").alias("before"))
        by_digit = Window.partitionBy("source").orderBy("digit")
        cut = None  # sources whose words run out, with the part that holds the cut
        for column, right, mask in DIGITS:
            digit = F.shiftrightunsigned(F.col(column), right).bitwiseAND(F.lit(mask).cast("long"))
            parts = edge.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("budget").alias("budget"))
            parts = parts.withColumn("through", F.col("before") + F.sum("words").over(by_digit)).filter("through > budget")
            first = parts.groupBy("source").agg(F.min_by(F.struct("digit", "n", (F.col("through") - F.col("words")).alias("before")), "digit").alias("first"))
            cut = staged(first.select("source", "first.*"), "mix-cut")
            edge = with_sources(edge.drop("before"), cut.drop("n")).filter(digit == F.col("digit")).drop("digit")
            if cut.filter(F.col("n") > LEAST_ROWS).isEmpty():
                break
        # the part's different rows in order, and how many of each are taken
        run = Window.partitionBy("source").orderBy("key", "hash")
        groups = edge.groupBy("source", "key", "hash").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("before").alias("start"), F.first("budget").alias("budget"))
        groups = groups.withColumn("before", F.col("start") + F.sum(F.col("n") * F.col("size")).over(run) - F.col("n") * F.col("size"))
        room = F.floor((2 * (F.col("budget") - F.col("before")) + F.col("size")) / (2 * F.col("size")))
        room = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("budget"), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), room))).cast("long")
        groups = groups.withColumn("took", room)
        place = F.struct("key", "hash", "n", "took")
        last = groups.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("took") < F.col("n"), place)), F.max(place)).alias("cut"))
        limits = staged(cut.select("source").withColumnRenamed("source", "_c").join(last, F.col("_c").eqNullSafe(F.col("source")), "left").select(F.col("_c").alias("source"), *[F.col(f"cut.{c}").alias(f"cut_{c}") for c in ("key", "hash", "n", "took")]), "mix-limits", result=True)
    final = with_sources(ranked(rows), limits)
    below = (F.col("key") < F.col("cut_key")) | (F.col("key") == F.col("cut_key")) & (F.col("hash") < F.col("cut_hash"))
    level = F.coalesce((F.col("key") == F.col("cut_key")) & (F.col("hash") == F.col("cut_hash")), F.lit(False))
    parted = level & (F.col("cut_took") > 0) & (F.col("cut_took") < F.col("cut_n"))
    taken = F.col("key").isNotNull() & (F.col("cut_key").isNull() | below | level & (F.col("cut_took") == F.col("cut_n")))
    out = ["record", "size", "source_size", "target"]
    copies = F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")
    if limits.filter("cut_took > 0 and cut_took < cut_n").isEmpty():
        return final.select(*out, copies.alias("copies"))
    # wholly equal rows at a cut: as many of them as there is room for
    equal = final.filter(parted).groupBy(*out, "whole", "cut_took").agg(F.count("*").alias("n"))
    equal = equal.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {EQUAL_ROWS}L)")))
    equal = equal.withColumn("k", F.explode(F.expr(f"sequence(block * {EQUAL_ROWS}L + 1, least(n, (block + 1) * {EQUAL_ROWS}L))")))
    return final.filter(~parted).select(*out, copies.alias("copies")).unionByName(equal.select(*out, (F.col("whole") + (F.col("k") <= F.col("cut_took")).cast("long")).alias("copies")))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each record once for each copy."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("record.*")
