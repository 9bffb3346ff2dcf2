import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing
from marginalia.llm.queries import ORACLES, op8_mixing


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling, source by source, until none is above its cap."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(w[i] for i in open_)
        over = {i for i in open_ if level * w[i] >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = level * w[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7], [1000, 1, 1, 1, 1], [5], [0, 7, 3]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes))


def test_query_and_twin(spark, sf):
    rows = op8_mixing(spark, sf).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    order = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(tuple(r[c] for c in order) for r in rows) == sorted(db.execute(f"SELECT {', '.join(order)} FROM ({ORACLES['op8_mixing']})").fetchall())
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["target"], []).append(r)
    for target, own in by.items():
        assert abs(sum(r["taken"] for r in own) - target * len({r["source_size"] for r in own})) <= max(r["size"] for r in own) * len(own)


def test_sources_come_near_their_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.when(F.col("id") < 4000, "hot").when(F.col("id") < 5000, "b").when(F.col("id") < 5900, "c").alias("source"))
    out = mixing.mix_sources(df).groupBy("record.source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("size").alias("most")).collect()
    assert len(out) == 4
    for r in out:
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1


def test_weights_make_unequal_chances(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))
    out = mixing.mix_sources(df, share=0.5, weight=F.col("weight"))
    n = {r["e"]: r["n"] for r in out.groupBy((F.col("record.doc_id") % 2).alias("e")).agg(F.sum("copies").alias("n")).collect()}
    assert n[0] + n[1] == 2000 and 2.4 < n[0] / n[1] < 3.8


def test_odd_rows(odd, empty):
    out = mixing.mix_sources(odd)
    rows = out.select("record.doc_id", "record.size", out["size"].alias("words"), out["copies"].alias("c")).collect()
    assert len(rows) == 10 and {r["size"] for r in rows} == {3} and all(0 <= r["c"] <= 2 for r in rows)
    again = mixing.repeated(out)
    assert again.columns == odd.columns and again.count() == sum(r["c"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def by_hand(rows, share, weights=(3, 1, 2), cap=2.0):
    """Copies by a plain loop: (id, source, size, weight) -> copies; no ties."""
    import hashlib

    sources = sorted({r[1] for r in rows if r[1] is not None}) + ([None] if any(r[1] is None for r in rows) else [])
    targets = filled([sum(r[2] for r in rows if r[1] == s) for s in sources], weights, share, cap)
    copies = {}
    for source, target in zip(sources, targets):
        own = [(r[0], r[2], 2 ** (round(16 * math.log2(r[3])) / 16) if r[3] else 0) for r in rows if r[1] == source]
        low, high = 0.0, 1e9
        for _ in range(300):  # the rate at which expected words are the target
            rate = (low + high) / 2
            low, high = (rate, high) if sum(min(cap, rate * w) * n for _, n, w in own) < target else (low, rate)
        budget, ranks = target, []
        for k, n, w in own:
            expected = min(cap, high * w)
            if abs(expected - round(expected)) < 1e-9:
                expected = round(expected)
            copies[k] = math.floor(expected)
            budget -= copies[k] * n
            p = expected - copies[k]
            if p:
                u = (int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                ranks.append((u / (1 - u) / (p / (1 - p)), k, n))
        through = 0
        for _, k, n in sorted(ranks):
            copies[k] += through + n / 2 <= budget + 1e-6
            through += n
    return copies


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_against_a_plain_loop(spark, share):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 30), rng.choice([0.5, 1.0, 1.7, 9.0])) for k in range(900)]
    df = spark.createDataFrame([(k, s, "w " * n, w) for k, s, n, w in rows], "doc_id long, source string, text string, weight double")
    found = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(df, share=share, weight=F.col("weight")).select("record.doc_id", "copies").collect()}
    assert found == by_hand(rows, share)


def test_heavy_documents_leave_the_rest_to_others(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") < 1000, 50.0).otherwise(1.0).alias("weight"))
    out = mixing.mix_sources(df, share=1.5, weight=F.col("weight"))
    assert out.filter("record.doc_id < 1000").agg(F.sum("copies")).first()[0] == 2000 and out.agg(F.sum("copies")).first()[0] == 3000


@pytest.mark.parametrize("doc_id", ["null", "5", "id"])
def test_rows_without_or_with_one_identifier(spark, doc_id, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_ROWS", 20)
    different = spark.range(3000).select(F.expr(f"cast({doc_id} as long)").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    equal = different.withColumn("text", F.lit("one two three four")).withColumn("doc_id", F.expr("cast(null as long)"))
    for df in (different, equal):
        out = mixing.mix_sources(df, share=0.5)
        assert out.count() == 3000 and out.agg(F.sum("copies")).first()[0] == 1500
