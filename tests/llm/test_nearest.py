import numpy as np
import pytest

from marginalia.llm import nearest
from marginalia.llm.queries import op13_nearest


def exact_score(q, v):
    total = 0.0
    for a, b in zip(q, v):
        total += float(a) * float(b)
    return total


def brute_force(rows, k, wanted):
    """{query: [(vec_id, score), ...]} over rows of (id, vector)."""
    out = {}
    for i, q in rows:
        if wanted(i):
            near = sorted(((j, exact_score(q, v)) for j, v in rows if j != i), key=lambda x: (-x[1], x[0]))
            out[i] = near[:k]
    return out


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near}) for q, near in want.items()) / sum(len(near) for near in want.values())


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, sf, folder):
    folder = sf.replace("sf0.001", folder)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = op13_nearest(spark, folder)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = grouped(found.collect()), brute_force(rows, 20, lambda i: i % 20 == 0)
    vectors = dict(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len({j for j, _ in near} | {q}) == len(near) + 1 == 21
        assert all(s == exact_score(vectors[q], vectors[j]) for j, s in near)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("shape", ["uniform", "clusters", "norms", "hot"])
def test_recall_with_many_lists(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12))
    if shape == "clusters":
        x = x[rng.integers(0, 40, 3000)] + 0.05 * rng.normal(size=(3000, 12))
    if shape == "norms":
        x *= rng.uniform(0.1, 3, size=(3000, 1))
    if shape == "hot":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[:1000] = x[0]
        x[1000:2000] = x[2500] + 0.001 * rng.normal(size=(1000, 12))
    rows = list(enumerate(x.astype(np.float32).tolist()))
    index = nearest.build_index(frame(spark, rows).repartition(4), k=10, list_rows=40, group_rows=200)
    assert len(index.centroids.points) > 20 and index.lists.select("cls").distinct().count() == len({tuple(v) for _, v in rows})
    got = grouped(index.search(frame(spark, rows[::60])).collect())
    want = brute_force(rows, 10, lambda i: i % 60 == 0)
    assert recall(got, want) >= 0.9
    # copies tie with each other and are never lost
    if shape == "hot":
        assert [j for j, _ in got[60]] == list(range(10)) and [j for j, _ in got[0]] == list(range(1, 11))


def test_clusters_are_balanced():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(6000, 8)), 5 + 0.01 * rng.normal(size=(3000, 8))]).astype(np.float32)
    leaves = nearest._clusters(x, 100, rng)
    assert sorted(np.concatenate(leaves)) == list(range(9000)) and max(map(len, leaves)) <= 100 and np.mean([len(m) for m in leaves]) > 25
    same = nearest._clusters(np.zeros((1000, 3), np.float32), 10, rng)
    assert sorted(np.concatenate(same)) == list(range(1000)) and max(map(len, same)) <= 10


def test_graph_search_finds_what_is_within_the_ratio():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(700, 16)).astype(np.float32)
    index = nearest.Centroids.of(points, 1.0)
    x = rng.normal(size=(90, 16)).astype(np.float32)
    row, node, far = index.near(x, 1.2)
    exact = ((x[:, None] - points) ** 2).sum(2)
    within = exact <= 1.44 * exact.min(1, keepdims=True)
    hit = np.zeros_like(within)
    hit[row, node] = True
    assert (hit & within).sum() >= 0.95 * within.sum() and np.allclose(far, exact[row, node], atol=1e-3)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [0, 0]), (3, None), (4, []), (5, [nan, 1]), (6, [inf, 1]), (7, [None, 1]), (8, [1, 2, 3]), (9, [0, 1]), (9, [0, 1]), (10, [-1, 0]), (20, [1, 1]), (20, [1, 1])]
    df = frame(spark, rows).selectExpr("vec_id", "embedding", "'x' AS v", "1 AS id", "2 AS cls", "3 AS key")
    df = df.unionByName(df.filter("vec_id = 1").withColumn("vec_id", df["vec_id"] - 1).limit(0)).unionByName(spark.createDataFrame([(None, [1.0, 1.0], "x", 1, 2, 3)], df.schema))
    got = grouped(nearest.build_index(df, k=3).search(df.filter("vec_id % 20 = 0")).collect())
    assert got == {0: [(1, 1.0), (20, 1.0), (9, 0.0)], 20: [(0, 1.0), (1, 1.0), (9, 1.0)]}
    assert nearest.build_index(df.limit(0), k=3).search(df).count() == 0 and nearest.build_index(df, k=3).search(df.limit(0)).count() == 0
    alone = frame(spark, [(40, [1, 2])])
    assert nearest.build_index(alone, k=3).search(alone).count() == 0
    # double precision is kept
    fine = frame(spark, [(0, [1, 1e-9]), (1, [1, 2e-9]), (2, [1, 1e-9])], "double")
    assert grouped(nearest.build_index(fine, k=2).search(fine).collect())[0] == [(1, 1 + 2e-18), (2, 1 + 1e-18)]
