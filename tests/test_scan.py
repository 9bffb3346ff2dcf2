"""BM25 over the whole corpus and passages' relevance, by passes over the texts."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from marginalia.catalog import ORACLES, QUERIES, retrieval
from marginalia.operators import ranking, scan


def tables(spark, path, docs, passages, kind="long"):
    spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def corpus(rng):
    """Copies, repeated and missing identifiers, null, empty and wordless texts, common words with negative weights."""
    text = lambda n: " ".join(rng.choices(["the", "Kiwi", "plum", "a", "fig's", "x9", "ümlaut", *(f"w{i}" for i in range(60))], k=n))
    docs = [(i, "every " + text(rng.randint(1, 40))) for i in range(90)]
    docs += [(i, "every plum plum of the plums w1") for i in range(100, 140)] + [(7, text(12)), (7, None), (8, docs[8][1]), (200, None), (201, ""), (202, "the - a"), (203, None), (203, None)]
    docs += [(None, "w3 w4 plum"), (None, "w3 kiwi")]
    passages = [(i, " ".join(docs[i][1].split(" ")[1:6])) for i in range(12)] + [(50, "every plum"), (51, None), (52, ""), (53, "unknown things"), (54, "every plum plum of"), (54, "w5"), (55, "plum  of")]
    return docs, passages


def both(spark, path, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, path).collect())), sorted(con.sql(ORACLES[name]).fetchall())


@pytest.mark.parametrize(("name", "kind"), [("bm25_topk", "long"), ("bm25_topk", "string"), ("bm25_eval", "long")])
def test_odd_tables_as_in_sql(spark, tmp_path, monkeypatch, name, kind):
    """In one part, then with questions and passages in several."""
    docs, passages = corpus(random.Random(3))
    path = tables(spark, tmp_path, [(i if kind == "long" or i is None else f"d{i}", t) for i, t in docs], passages, kind)
    found, expected = both(spark, path, name)
    assert len(expected) > 14 and found == expected
    if kind == "long":
        monkeypatch.setattr(ranking, "BROADCAST_ROWS", 20)
        monkeypatch.setattr(retrieval, "SENT_PASSAGES", 4)
        assert both(spark, path, name)[0] == expected


def test_texts_in_small_pieces_give_the_same(monkeypatch):
    rng, kept = random.Random(5), {}
    docs = [(i, " ".join(rng.choices(["kiwi", "plum", *(f"w{j}" for j in range(40))], k=rng.randint(0, 30)))) for i in range(300)]
    rows = pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "dl": pa.nulls(300, pa.int64()), "counts": pa.nulls(300, pa.list_(pa.struct({"token": pa.string(), "tf": pa.int64()})))})
    asked = scan.Asked.of(pa.table({"qid": [q for q in range(8) for _ in range(3)], "token": [t for q in range(8) for t in ("kiwi", f"w{q}", f"w{q + 7}")], "weight": [w for q in range(8) for w in (0.2, -1.0 if q == 3 else 2.5, 1.5)]}))
    for texts, cells, words in ((512, 2_000_000, 250_000), (7, 20, 5)):
        for name, value in (("TEXTS", texts), ("CELLS", cells), ("VOCABULARY", words)):
            monkeypatch.setattr(scan, name, value)
        best = [r for b in scan.scored(asked, 15.0, 4, k1=1.5, b=0.75, places=6)(iter(rows.to_batches(100))) for r in b.to_pylist()]
        counts = Counter()
        for b in scan.vocabulary(iter(rows.to_batches(100))):
            for r in b.to_pylist():
                counts[r["token"]] += r["df"] + (r["length"] or 0)
        kept[texts] = sorted((r["qid"], -r["score"], r["doc_id"]) for r in best), counts
    assert kept[512] == kept[7] and len(kept[7][0]) == 32
    assert kept[7][1] == Counter(w for _, t in docs for w in set(t.split())) + Counter({None: sum(len(t.split()) for _, t in docs)})


def test_no_pair_of_a_question_and_a_document_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"kiwi plum{i % 7}") for i in range(50)], "doc_id long, text string")
    found = ranking.bm25_corpus(spark.createDataFrame([(0, "kiwi plum3"), (1, "kiwi")], "qid long, text string"), docs, 3)
    assert [r["doc_id"] for r in found.filter("qid = 0").orderBy("rank").collect()] == [3, 10, 17]
    assert not re.search(r"hashpartitioning\([^)]*doc_id", found._jdf.queryExecution().executedPlan().toString())


def test_a_task_passes_on_each_questions_best_alone(spark):
    """However many copies there are."""
    docs = spark.createDataFrame([(i, "kiwi plum") for i in range(5000)] + [(i, "fig") for i in range(5000, 11_000)], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(q, "kiwi") for q in range(9)], "qid long, text string")
    found = ranking.bm25_corpus(asked, docs, 4)
    assert sorted((r["qid"], r["rank"], r["doc_id"]) for r in found.collect()) == [(q, i, i) for q in range(9) for i in range(4)]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_many_passages_go_to_the_texts_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "SENT_PASSAGES", 2)
    path = tables(spark, tmp_path, [(1, "an old kiwi tree"), (2, None), (3, "kiwi")], [(i, t) for i, t in enumerate(["an old kiwi tree", "old kiwi", "kiwi", "kiwi t", "", None])])
    found = retrieval._contained(spark, path)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (1, 1), (2, 1), (2, 3), (3, 1), (4, 1), (4, 3)]
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
