"""The exact bootstrap against a plain loop over the standard library's generator."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import stats


def plain(d, resamples, seed=42, alpha=0.05):
    n, rng = len(d), random.Random(seed)
    means = sorted(math.fsum(d[rng.randint(0, n - 1)] for _ in range(n)) / n for _ in range(resamples))
    mean = math.fsum(d) / n
    opposite = sum(m <= 0 if mean >= 0 else m >= 0 for m in means) / resamples
    return mean, means[int(resamples * alpha / 2)], means[int(resamples * (1 - alpha / 2))], min(1.0, 2 * opposite)


def same(row, want):
    assert all(math.isclose(row[k], w, rel_tol=1e-12, abs_tol=1e-15) for k, w in zip(("mean", "lo", "hi", "p"), want)), (row, want)


def test_the_stream_is_the_generators():
    rng = random.Random(42)
    words = stats._stream(np.array(random.Random(42).getstate()[1], "<u4").tobytes())
    assert [rng.getrandbits(32) for _ in range(2000)] == words.random_raw(2000).tolist()
    again = stats._stream(stats._state(words))
    assert [rng.getrandbits(32) for _ in range(100)] == again.random_raw(100).tolist()
    for n in (1, 2, 3, 5, 64, 1000):
        row = {"state": np.array(random.Random(7).getstate()[1], "<u4").tobytes(), "size": 5000, "n": n}
        rng = random.Random(7)
        drawn = stats._drawn(row).tolist()
        assert drawn[:2000] == [rng.randint(0, n - 1) for _ in drawn[:2000]]


@pytest.mark.parametrize("block", [100, 1000, 1 << 22])
def test_groups_of_every_size(spark, block):
    rng = random.Random(3)
    groups = {f"g{n}": [rng.choice([-1.0, -0.5, 0.0, 0.2, 1.0]) for _ in range(n)] for n in (1, 2, 7, 16, 33)} | {"below": [-0.3, -0.1, -0.9, 0.1]}
    rows = [(g, f"q{i:04d}", x) for g, d in groups.items() for i, x in enumerate(d)]
    rng.shuffle(rows)
    found = {r["qtype"]: r for r in stats.exact_bootstrap(spark.createDataFrame(rows, "qtype string, qid string, diff double"), resamples=200, block=block).collect()}
    assert found.keys() == groups.keys()
    for g, d in groups.items():
        same(found[g], plain(d, 200))


def test_many_questions(spark):
    """A hundred thousand questions, in blocks of which none holds a resample."""
    rng = np.random.default_rng(1)
    d = rng.choice([-1, -0.25, 0, 0, 0.25, 1], 100_000, p=[0.1, 0.1, 0.3, 0.29, 0.11, 0.1])
    frame = spark.createDataFrame([("all", i, float(x)) for i, x in enumerate(d)], "qtype string, qid long, diff double").repartition(8)
    same(stats.exact_bootstrap(frame, resamples=40, block=1 << 16).first(), plain(d.tolist(), 40))


def test_no_questions(spark):
    assert stats.exact_bootstrap(spark.createDataFrame([], "qtype string, qid string, diff double")).count() == 0


def test_more_questions_than_fit_are_refused(spark, monkeypatch):
    monkeypatch.setattr(stats, "QUESTIONS", 2)
    with pytest.raises(ValueError, match="hashed_bootstrap"):
        stats.exact_bootstrap(spark.createDataFrame([("a", i, 1.0) for i in range(3)], "qtype string, qid long, diff double"))


@pytest.mark.parametrize("rows", [500_000, 3])
def test_hashed_bootstrap_against_a_plain_loop(spark, monkeypatch, rows):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", rows)
    rng, resamples = random.Random(5), 60
    diffs = {"a": [rng.choice([-1.0, 0.0, 0.5]) for _ in range(23)], "b": [rng.random() for _ in range(8)]}
    frame = spark.createDataFrame([(g, q, d) for g, own in diffs.items() for q, d in enumerate(own)], "grp string, qid long, diff double").repartition(3)
    found = stats.hashed_bootstrap(frame, by="grp", resamples=resamples)
    # the draws, resamples times all questions, are never what is sent to all tasks
    plan = found._jdf.queryExecution().executedPlan().toString()
    drawn = [line for line in plan.splitlines() if "Join" in line and "[place#" in line]
    assert drawn and all("SortMergeJoin" in line if rows == 3 else "BuildRight" in line for line in drawn)
    rows = {r["grp"]: r for r in found.collect()}
    for g, own in diffs.items():
        n = len(own)
        drawn = [[own[int(hashlib.md5(f"42:{s}:{k}".encode()).hexdigest()[:8], 16) % n] for k in range(n)] for s in range(1, resamples + 1)]
        means = sorted(round(sum(d) / n, 9) for d in drawn)
        mean = sum(own) / n
        opposite = sum(m <= 0 if mean >= 0 else m >= 0 for m in means)
        wanted = (mean, means[int(resamples * 0.025)], means[int(resamples * 0.975)], min(1.0, 2 * opposite / resamples))
        assert [rows[g][c] for c in ("mean_diff", "ci_low", "ci_high", "p")] == pytest.approx(wanted, abs=2e-6)


def test_both_sides_of_a_comparison_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    a = spark.range(40).select(F.col("id").alias("qid"), (F.col("id") % 3).cast("double").alias("m")).mapInArrow(counted, "qid long, m double")
    b = spark.range(30).select(F.col("id").alias("qid"), F.lit(1.0).alias("m")).mapInArrow(counted, "qid long, m double")
    kinds = spark.range(40).select(F.col("id").alias("qid"), F.when(F.col("id") < 30, "x").otherwise("y").alias("qtype"))
    rows = {r["grp"]: (r["n"], r["mean_diff"]) for r in stats.compared(a, b, kinds, "m", resamples=20).collect()}
    assert rows == {"all": (30, 0.0), "x": (30, 0.0), "y": (0, 0.0)}
    assert made.value == 70
