"""The kept word index against BM25 over the texts."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ranking, word_index


def corpus(rng, n):
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 90])))) for i in range(n)]


def rows(df):
    return sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_equal_to_the_scan(spark, tmp_path, batches):
    rng, path = random.Random(batches), str(tmp_path / "index")
    docs = corpus(rng, 900)
    for b in range(batches):
        own = [d for d in docs if d[0] % batches == b] + ([(10_000, None)] if b == 0 else [])
        word_index.add_documents(spark.createDataFrame(own, "doc_id long, text string"), path, b, block_docs=20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    questions = spark.createDataFrame([(0, "w0 w1 w2"), (1, "w399 w380 w0"), (2, "nothing here"), (3, ""), (4, "w7 w7 w9 w300"), (5, " ".join(f"w{i}" for i in range(60)))], "qid long, text string")
    for k in (1, 10):
        assert rows(word_index.search(spark, path, questions, k)) == rows(ranking.bm25_corpus(questions, frame, k))


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "index")
    for text in ("old words", "new words"):
        word_index.add_documents(spark.createDataFrame([(1, text), (2, "other"), (3, "thing")], "doc_id long, text string"), path)
    questions = spark.createDataFrame([(0, "old new")], "qid long, text string")
    found = word_index.search(spark, path, questions).collect()
    assert [r["doc_id"] for r in found] == [1] and found[0]["score"] > 0


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    """A rare word's block beats all blocks of a common one."""
    rng, path = random.Random(5), str(tmp_path / "index")
    docs = [(i, "common " * rng.randint(1, 2) + "filler " * 30) for i in range(3000)] + [(i, "rare common") for i in range(5000, 5012)]
    docs += [(i, "noise") for i in range(9000, 13_000)]
    word_index.add_documents(spark.createDataFrame(docs, "doc_id long, text string"), path, block_docs=10)
    questions = spark.createDataFrame([(0, "rare common")], "qid long, text string")
    found = rows(word_index.search(spark, path, questions, 3))
    assert found == rows(ranking.bm25_corpus(questions, spark.createDataFrame(docs, "doc_id long, text string"), 3)) and {f[2] for f in found} <= set(range(5000, 5012))
    plan = word_index.search(spark, path, questions, 3)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
    assert spark.read.parquet(f"{path}/postings").filter(F.col("token") == "common").count() > 100


def test_postings_are_counted_where_the_texts_lie(spark, tmp_path, monkeypatch):
    """Tasks follow from the documents, not from the session's setting, and each has its share of the postings."""
    monkeypatch.setattr(word_index, "TASK_DOCS", 50)
    monkeypatch.setattr(word_index, "FILE_BLOCKS", 2)
    rng, path = random.Random(9), str(tmp_path / "index")
    word_index.add_documents(spark.createDataFrame(corpus(rng, 1000), "doc_id long, text string"), path, block_docs=50)
    files = spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("f"), F.size("entries").alias("n")).groupBy("f").agg(F.sum("n").alias("n")).collect()
    assert len(files) > 200 and max(f["n"] for f in files) < sum(f["n"] for f in files) / 20


def test_texts_of_one_identifier_and_named_ones(spark, tmp_path):
    """Identifiers may be strings and come twice; weights may be negative; questions are scored in parts."""
    path = str(tmp_path / "index")
    texts = [("a", "one two"), ("a", "two three three"), ("b", "two"), ("c", ""), ("d", "two four")]
    word_index.add_documents(spark.createDataFrame(texts, "doc_id string, text string"), path)
    counts = {r["token"]: (r["df"], r["length"]) for r in spark.read.parquet(f"{path}/counts").collect()}
    assert counts == {None: (5, 8), "one": (1, None), "two": (3, None), "three": (1, None), "four": (1, None)}
    entries = spark.read.parquet(f"{path}/postings").filter("token = 'two'").select(F.inline("entries")).collect()
    assert sorted(map(tuple, entries)) == [("a", 2, 5), ("b", 1, 1), ("d", 1, 2)]
    questions = spark.createDataFrame([(f"q{i}", "two three") for i in range(300)] + [("none", "five")], "qid string, text string")
    found = word_index.search(spark, path, questions, 2).collect()
    assert len(found) == 600 and {(r["rank"], r["doc_id"]) for r in found if r["rank"] == 0} == {(0, "a")}
