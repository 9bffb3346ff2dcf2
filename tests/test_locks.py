"""Streamed states of locks and runs against the batch functions."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.operators import audit
from marginalia.session import configured
from marginalia.streaming import locks

SCHEMA = "op string, kind string, ts timestamp"
START = datetime(2024, 1, 1)


def streamed(spark, tmp_path, batches, **options):
    """Each batch is a file and a trigger; time goes on with the last."""
    configured(spark)
    for key, value in locks.STORE.items():
        spark.conf.set(key, value)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source, exist_ok=True)
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = locks.changes(spark.readStream.schema(SCHEMA).parquet(source), **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(locks.CHANGES).parquet(target)


def batch_states(spark, events, as_of):
    e = spark.createDataFrame(events, SCHEMA).filter(F.col("ts") <= F.lit(as_of)).filter("kind in ('lock', 'ok')")
    last = e.groupBy("op").agg(F.max(F.when(F.col("kind") == "lock", F.col("ts"))).alias("lock_ts"), F.max(F.when(F.col("kind") == "ok", F.col("ts"))).alias("last_ok"))
    state = audit.lock_state(last, F.lit(as_of)).select("op", "state", "cooling_down")
    due = audit.last_runs(e.filter("kind = 'ok'"), F.lit(as_of)).select("op", "due")
    return {tuple(r) for r in state.join(due, "op", "left").collect()}


@pytest.mark.parametrize("n_batches", [1, 4])
def test_states_equal_the_batch_functions(spark, tmp_path, n_batches):
    rng = random.Random(n_batches)
    events = sorted(((f"op{rng.randrange(12)}", rng.choice(["lock", "ok", "other"]), START + timedelta(seconds=rng.randrange(30 * 86_400), microseconds=rng.randrange(10**6))) for _ in range(150)), key=lambda e: e[2])
    step = -(-len(events) // n_batches)
    batches = [events[i : i + step] for i in range(0, len(events), step)]
    for b in batches:
        rng.shuffle(b)
    # a later event of no operation that counts moves the watermark on
    batches += [[("clock", "tick", START + timedelta(days=60))], [("clock", "tick", START + timedelta(days=61))]]
    found = streamed(spark, tmp_path, batches).cache()
    assert found.count() == found.distinct().count()
    for as_of in (START + timedelta(days=d, hours=h) for d, h in ((3, 0), (14, 7), (29, 23), (45, 1))):
        assert {tuple(r) for r in locks.states(found, F.lit(as_of)).collect()} == batch_states(spark, events, as_of)


def test_changes_hold_from_their_time(spark, tmp_path):
    at = lambda **d: START + timedelta(**d)
    batches = [[("a", "lock", START), ("a", "ok", at(minutes=10))], [("a", "lock", at(minutes=50)), (None, "lock", START)], [("b", "x", at(days=40))], [("b", "x", at(days=41))]]
    rows = sorted((r["op"], r["at"], r["aspect"], r["value"]) for r in streamed(spark, tmp_path, batches).collect())
    assert rows == sorted([
        ("a", START, "lock", "held"), ("a", at(minutes=30), "lock", "stale"), ("a", at(minutes=50), "lock", "held"), ("a", at(minutes=80), "lock", "stale"),
        ("a", at(minutes=10), "cooldown", "cooling"), ("a", at(days=1, minutes=10), "cooldown", "over"), ("a", at(minutes=10), "cadence", "ran"), ("a", at(days=15), "cadence", "due"),
    ])
