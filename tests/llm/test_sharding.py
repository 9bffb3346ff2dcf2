import zlib

from pyspark.sql import functions as F

from marginalia.llm.queries import op6_sharding
from marginalia.llm.sharding import two_pass_shuffle, write_shards


def slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    return {k: sorted(v) for k, v in by.items()}


def test_query(spark, sf):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(source)
    for r in rows:
        data = (source[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    by = slots(rows)
    assert all(v == list(range(len(v))) for v in by.values())
    counts = [len(by.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in op6_sharding(spark, sf).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_order_is_shuffled_and_seeded(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    order = lambda seed: [r["record"]["doc_id"] for r in two_pass_shuffle(df, shards=1, seed=seed).orderBy("slot").collect()]
    a, b = order(1), order(2)
    assert a != sorted(a) and a != b and sorted(a) == sorted(b) == list(range(2000))
    # neighbours in the input are far apart: mean distance of a uniform order is a third of the length
    place = {d: k for k, d in enumerate(a)}
    assert 500 < sum(abs(place[i] - place[i + 1]) for i in range(1999)) / 1999 < 850


def test_odd_rows(odd, empty):
    out = write_shards(two_pass_shuffle(odd, shards=3))
    rows = out.select("record.doc_id", "record.shard", out["shard"].alias("s"), "slot", "size").collect()
    assert len(rows) == 10 and {r["shard"] for r in rows} == {1}
    by = slots([{"shard": r["s"], "slot": r["slot"]} for r in rows])
    assert sorted(map(len, by.values())) == [3, 3, 4] and all(v == list(range(len(v))) for v in by.values())
    assert two_pass_shuffle(empty).count() == 0
