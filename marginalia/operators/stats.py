"""Paired bootstrap between two strategies (ST-B): exact by blocks of the random stream, and with hashed resampling at any size."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .ordering import numbered


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(qid, diff) over the questions both have."""
    return a.select("qid", F.col(metric).alias("x")).join(b.select("qid", F.col(metric).alias("y")), "qid").select("qid", (F.col("x") - F.col("y")).alias("diff"))


#: Draws that one task makes, and questions whose differences are sent to all tasks (64 MB).
BLOCK, QUESTIONS = 1 << 22, 8_000_000

#: Differences that the hashed bootstrap sends to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 500_000

_BLOCKS = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("skip", pa.int64()), ("state", pa.binary())])
_COUNTS = pa.schema([("grp", pa.int32()), ("block", pa.int64()), ("accepted", pa.int64())])
_SUMS = pa.schema([("grp", pa.int32()), ("resample", pa.int64()), ("high", pa.float64()), ("low", pa.float64())])


def _stream(state: bytes) -> np.random.MT19937:
    """The Mersenne twister in a state: 624 words and the place in them."""
    words = np.frombuffer(state, "<u4")
    twister = np.random.MT19937()
    twister.state = {"bit_generator": "MT19937", "state": {"key": words[:-1].astype(np.uint32), "pos": int(words[-1])}}
    return twister


def _state(twister: np.random.MT19937) -> bytes:
    now = twister.state["state"]
    return np.append(now["key"], now["pos"]).astype("<u4").tobytes()


def _drawn(row: dict) -> np.ndarray:
    """What a block draws from n: the highest bits of each word, where they are less than n."""
    words = _stream(row["state"]).random_raw(row["size"]) >> np.uint64(32 - int(row["n"]).bit_length())
    return words[words < row["n"]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([{"grp": row["grp"], "block": row["block"], "accepted": len(_drawn(row))}], schema=_COUNTS)


def exact_bootstrap(diffs: DataFrame, *, by: str = "qtype", resamples: int = 10_000, alpha: float = 0.05, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The published random stream for each group of questions: (by, mean, lo, hi, p).

    The stream is one sequence of words, of which a group of n questions takes
    those whose highest bits are below n: n for the first resample, n for the
    next.  The driver runs through the words once and keeps the generator's
    state at the start of every block.  Tasks count what each block accepts; the
    sums of these counts say to which resample a block's first draw belongs;
    then tasks add up the drawn differences by resample.  A resample that
    crosses blocks is added up from its parts.

    The differences of all questions, in order of their identifiers, go to all
    tasks; more than QUESTIONS are refused (`hashed_bootstrap` takes any
    number).  Sums are in extended precision, so means may differ from those of
    a plain loop in the last bit.
    """
    spark = diffs.sparkSession
    if diffs.limit(QUESTIONS + 1).count() > QUESTIONS:
        raise ValueError(f"more than {QUESTIONS} questions; use hashed_bootstrap")
    kind = dict(diffs.dtypes)[by]
    numbers = {r[by]: i for i, r in enumerate(diffs.select(by).distinct().orderBy(by).collect())}
    ordered = diffs.select(by, "qid", F.col("diff").cast("double").alias("diff")).orderBy(by, "qid").select(by, "diff").toArrow()
    keys = np.array([numbers[k] for k in ordered.column(by).to_pylist()], np.int64)
    all_values = ordered.column("diff").to_numpy()
    values = [all_values[keys == g] for g in range(len(numbers))]
    names = spark.createDataFrame([(g, k) for k, g in numbers.items()], f"grp int, {by} {kind}")
    need = {g: _words(len(v), resamples) for g, v in enumerate(values)}
    # blocks of a group differ in n only, so one run through the words serves all
    version, words, _ = random.Random(seed).getstate()
    twister = _stream(np.array(words, "<u4").tobytes())
    states: list[bytes] = []
    for _ in range(0, max(need.values(), default=0), block):
        states.append(_state(twister))
        twister.random_raw(block, output=False)
    blocks = [(g, b, len(values[g]), min(block, need[g] - b * block), 0, states[b]) for g in need for b in range(-(-need[g] // block))]
    schema = "grp int, block long, n long, size long, skip long, state binary"
    spread = lambda rows: spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10_000)), "grp", "block")
    accepted = {(r["grp"], r["block"]): r["accepted"] for r in spread(blocks).mapInArrow(_counted, "grp int, block long, accepted long").collect()}  # a row a block
    at, placed = dict.fromkeys(need, 0), []
    for g, b, n, size, _, state in blocks:
        placed.append((g, b, n, size, at[g], state))
        at[g] += accepted[g, b]
    if any(at[g] < len(values[g]) * resamples for g in need):
        raise RuntimeError("the stream was cut too short")
    sent = spark.sparkContext.broadcast(values)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, skip = row["n"], row["skip"]
                drawn = _drawn(row)[: max(0, n * resamples - skip)]
                if not len(drawn):
                    continue
                first = skip // n
                starts = np.maximum(np.arange(first, (skip + len(drawn) - 1) // n + 1) * n - skip, 0)
                sums = np.add.reduceat(sent.value[row["grp"]][drawn].astype(np.longdouble), starts)
                high = sums.astype(np.float64)
                k = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, row["grp"], np.int32)), pa.array(np.arange(first, first + k)), pa.array(high), pa.array((sums - high).astype(np.float64))], schema=_SUMS)

    parts = spread(placed).mapInArrow(added, "grp int, resample long, high double, low double")
    sizes = spark.createDataFrame([(g, len(v), float(np.sum(v.astype(np.longdouble)) / len(v))) for g, v in enumerate(values)], "grp int, n long, mean double")
    means = parts.groupBy("grp", "resample").agg((F.sum("high") + F.sum("low")).alias("s")).join(F.broadcast(sizes), "grp").select("grp", "mean", (F.col("s") / F.col("n")).alias("m"))
    found = means.groupBy("grp", "mean").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    opposite = F.when(F.col("mean") >= 0, F.size(F.filter("ms", lambda m: m <= 0))).otherwise(F.size(F.filter("ms", lambda m: m >= 0)))
    low, high = (F.get("ms", F.lit(int(resamples * share))) for share in (alpha / 2, 1 - alpha / 2))
    return found.join(F.broadcast(names), "grp").select(by, "mean", low.alias("lo"), high.alias("hi"), F.least(F.lit(1.0), 2 * opposite / resamples).alias("p"))


def _words(n: int, resamples: int) -> int:
    """Words that hold n * resamples draws below n, but for a chance too small to name."""
    need, share = n * resamples, n / (1 << n.bit_length())
    return int(need / share + 12 * (need * (1 - share)) ** 0.5 / share + 1000)


def hashed_bootstrap(diffs: DataFrame, *, by: str = "qtype", resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """AG17, AG18 with a hash in place of the random stream: slot k of resample s draws question md5(seed:s:k) mod n.

    The planner takes the draws for as few rows as the sizes they are made
    from, and would send them to all tasks; so it is said which side is sent.
    """
    placed = settled(numbered(settled(diffs.select(by, "qid", "diff")), by, "qid", name="place").select(by, "place", "diff"))
    sizes = placed.groupBy(by).agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.min("place").alias("first"))
    # a row of `sizes` becomes resamples times n draws: resamples are dealt out first, and the draws stream past the differences
    parts = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = sizes.select(by, "n", "first", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("s")).repartition(parts, by, "s")
    draws = each.select(by, "n", "first", "s", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("s").cast("string"), F.col("k").cast("string"))
    draws = draws.select(by, "s", (F.col("first") + F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % F.col("n")).cast("int").alias("place"))
    if placed.count() <= BROADCAST_ROWS:
        drawn = draws.join(F.broadcast(placed.select("place", "diff")), "place")
    else:
        drawn = draws.hint("merge").join(placed.select("place", "diff"), "place")
    means = drawn.groupBy(by, "s").agg(F.round(F.avg("diff"), 9).alias("m"))
    ordered = means.groupBy(by).agg(F.sort_array(F.collect_list("m")).alias("ms")).join(sizes, by)
    opposite = F.when(F.col("mean") >= 0, F.size(F.filter("ms", lambda m: m <= 0))).otherwise(F.size(F.filter("ms", lambda m: m >= 0)))
    return ordered.select(by, F.round("mean", 6).alias("mean_diff"), F.round(F.get("ms", F.lit(int(resamples * alpha / 2))), 6).alias("ci_low"), F.round(F.get("ms", F.lit(int(resamples * (1 - alpha / 2)))), 6).alias("ci_high"), F.round(F.least(F.lit(1.0), 2 * opposite / resamples), 6).alias("p"))


def significance(p: Column) -> Column:
    """Marks at .001, .01 and .05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def compared(a: DataFrame, b: DataFrame, questions: DataFrame, metric: str, *, resamples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """AG18, ST6: (grp, n, mean_diff, ci_low, ci_high, p, mark) over all questions and over each type that either side has.

    A group without a question of both sides is not compared: no difference,
    p of 1.
    """
    # both rankings are made once, in a plan of their own; the three results below read a thin table
    x = a.select("qid", F.col(metric).alias("x"), F.lit(True).alias("in_a"))
    y = b.select("qid", F.col(metric).alias("y"), F.lit(True).alias("in_b"))
    met = settled(x.join(y, "qid", "full").join(questions.select("qid", "qtype"), "qid").select("qid", "qtype", "in_a", "in_b", (F.col("x") - F.col("y")).alias("diff")))
    groups = met.select(F.col("qtype").alias("grp")).distinct().union(questions.sparkSession.createDataFrame([("all",)], "grp string"))
    diffs = met.filter("in_a and in_b").select("qid", "diff", F.explode(F.array(F.lit("all"), "qtype")).alias("grp"))
    found = hashed_bootstrap(diffs, by="grp", resamples=resamples, alpha=alpha, seed=seed)
    counts = diffs.groupBy("grp").agg(F.count("*").alias("n"))
    rows = groups.join(counts, "grp", "left").join(found, "grp", "left")
    return rows.select("grp", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_diff", "ci_low", "ci_high")], F.coalesce("p", F.lit(1.0)).alias("p")).withColumn("mark", significance(F.col("p")))
