import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import vector_cells as vc


def frame(spark, x, key):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, embedding array<float>")


def truth(x, q, k, itself=True):
    s = q.astype(np.float32).astype(np.float64) @ x.astype(np.float32).astype(np.float64).T
    out = {}
    for i, row in enumerate(s):
        order = sorted((j for j in range(len(x)) if itself or j != i), key=lambda j: (-round(row[j], 6), j))
        out[i] = order[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("shape", ["uniform", "clusters"])
def test_recall_and_exact(spark, tmp_path, shape):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 24))
    if shape == "clusters":
        x = rng.normal(size=(60, 24))[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs, questions = frame(spark, x, "doc_id").repartition(4), frame(spark, x[:60], "qid")
    true = truth(x, x[:60], 10, itself=False)
    exact = vc.exact(docs, questions, 10, itself=False)
    assert got(exact) == true
    vc.write_index(docs, str(tmp_path / "index"), cells=40)
    found = vc.search(spark, str(tmp_path / "index"), questions, 10, probes=24 if shape == "uniform" else 8, itself=False)
    share = vc.recall(found, exact).first()
    assert share["n"] == 600 and share["share"] >= 0.9
    # all cells and all rows: nothing can be missed
    assert got(vc.search(spark, str(tmp_path / "index"), questions, 10, probes=40, keep=4000, itself=False)) == true


def test_codes_read_no_vectors(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(900, 8))
    vc.write_index(frame(spark, x, "doc_id"), str(tmp_path / "index"), cells=9)
    table = spark.read.parquet(str(tmp_path / "index/vectors"))
    assert table.select("cell").distinct().count() == 9 and table.count() == 900 and {len(r["code"]) for r in table.select("code").collect()} == {8}


def test_hot_cells_are_split(spark, tmp_path, monkeypatch):
    x = np.ones((300, 4)) + 1e-3 * np.random.default_rng(3).normal(size=(300, 4))
    docs, questions = frame(spark, x, "doc_id"), frame(spark, x[:3], "qid")
    vc.write_index(docs, str(tmp_path / "index"), cells=1)
    monkeypatch.setattr(vc, "GROUP_ROWS", 40)
    found = got(vc.search(spark, str(tmp_path / "index"), questions, 5, keep=300))
    assert found == got(vc.exact(docs, questions, 5))


def test_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (9, None)], "qid long, embedding array<double>")
    vc.write_index(docs, str(tmp_path / "index"))
    assert got(vc.search(spark, str(tmp_path / "index"), questions, 5)) == {1: [1, 3]} == got(vc.exact(docs, questions, 5))
    assert vc.exact(docs, questions.limit(0)).count() == 0 and vc.exact(docs.limit(0), questions).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        vc.write_index(docs.limit(0), str(tmp_path / "none"))


def test_cells_to_read_are_fitted_where_there_are_no_clusters(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs, questions = frame(spark, x, "doc_id").repartition(4), frame(spark, x[:50], "qid")
    vc.write_index(docs, str(tmp_path / "index"), cells=120)
    found = vc.search(spark, str(tmp_path / "index"), questions, 10, itself=False)
    assert vc.recall(found, vc.exact(docs, questions, 10, itself=False)).first()["share"] >= 0.9


def test_a_scan_passes_on_little_of_what_it_reads(spark, monkeypatch):
    """Tasks keep their best scores from batch to batch and multiply in small blocks; ties stay."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 8))
    x[17] = x[4000] = x[5999]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, embedding array<double>").coalesce(1)
    passed = []
    monkeypatch.setattr(vc, "best", lambda scores, k, best=vc.best: passed.append(scores.count()) or best(scores, k))
    monkeypatch.setattr(vc, "SCAN_ROWS", 100, raising=False)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        q = v.filter("doc_id < 20").select(F.col("doc_id").alias("qid"), "embedding")
        rows = vc.exact(v, q, k=5, itself=False).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for i in range(20):
        s = np.round(x @ x[i], 6)
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [r["doc_id"] for r in sorted((r for r in rows if r["qid"] == i), key=lambda r: r["rank"])] == want
    assert passed[0] < 20 * 150  # 5 of each of 60 batches would be 300 a question
