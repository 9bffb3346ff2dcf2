import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import prefix_trie as pt
from marginalia.llm.queries import op12_prefix_trie


def plain_python(conversations):
    """The trie's rows from {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    total = {}
    children = {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, own in members.items():
        saved, leaf = (len(own) - 1) * len(node[-1][1]) if node else 0, int(node not in children)
        for d in range(len(node) + 1):
            a = total.setdefault(node[:d], [0, 0])
            a[0], a[1] = a[0] + saved, a[1] + leaf
    return sorted(
        (min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children.get(node, 0), total[node][1], total[node][0], hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, own in members.items()
    )


def in_order(rows):
    """{conv_id: turns} from (conv_id, turn, role, text) without ties of turn."""
    out = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuilt(original):
    out = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = original.get(base, [])[:h] + own[h:]
    return out


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()))


def same(df, conversations):
    def key(r):
        return (r[1], r[0])

    assert sorted(found(df), key=key) == sorted(plain_python(conversations), key=key)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(op12_prefix_trie(spark, sf), rebuilt(in_order(rows)))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_stitched_partitions(spark, partitions):
    rng = random.Random(partitions)
    conversations = {}
    for c in range(-30, 400):
        conversations[c] = [("user", "same opening")] * (c % 3 > 0) + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "", "dédé"])) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
    conversations |= {c: [("user", "hot")] * 2 for c in range(1000, 1300)} | {2000: [("user", str(i)) for i in range(300)], 2001: [("user", str(i)) for i in range(290)]}
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    arrays = pt.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    alone = spark.createDataFrame([(c,) for c, turns in conversations.items() if not turns], "conv_id long")
    arrays = arrays.unionByName(alone.withColumn("turns", F.array().cast(arrays.schema["turns"].dataType)))
    same(pt.prefix_trie(arrays, partitions=partitions), conversations)


def test_chunks_of_identifiers(spark):
    conversations = {c: [("user", "hot")] for c in range(500)} | {900: [("user", "hot"), ("user", "more")], 901: []}
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    arrays = pt.turn_arrays(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    arrays = arrays.unionByName(spark.createDataFrame([(901, [])], arrays.schema))
    same(pt.prefix_trie(arrays, partitions=9, chunk_ids=7), conversations)


def test_rebuilding(spark):
    rng = random.Random(5)
    rows = [(c, i, "user", rng.choice("abc")) for c in [*range(0, 300, 2), 301, 405, -3, -104, -100, 100_000_000_000] for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    same(pt.prefix_trie(pt.with_shared_heads(pt.turn_arrays(df)), partitions=4), rebuilt(in_order(rows)))


def test_odd_rows(spark):
    long = "word " * 400_000
    rows = [(1, None, None, None), (1, 2, "user", long), (2, None, "", ""), (2, 7, "user", long), (None, 1, "user", "nobody's"), (3, 1, "user", "x"), (3, 2, "user", "x"), (4, 1, "user", "x"), (4, 5, "user", "x")]
    df = spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], "conv_id long, turn int, role string, text string, digest string, chars int, part int, kind int")
    nodes = pt.prefix_trie(pt.turn_arrays(df), partitions=3)
    same(nodes, in_order(rows))
    assert nodes.filter("depth = 0").first()["n_convs"] == 4 and nodes.count() == 5
    # repeated rows and ties of turn are turns of their own, in one order
    tied = spark.createDataFrame([(c, 1, "user", t) for c, ts in ((1, "abba"), (2, "baab")) for t in ts], "conv_id long, turn int, role string, text string")
    assert sorted((r["depth"], r["n_convs"]) for r in pt.prefix_trie(pt.turn_arrays(tied)).collect()) == [(d, 2) for d in range(5)]
    assert pt.prefix_trie(pt.turn_arrays(df.limit(0))).count() == 0
