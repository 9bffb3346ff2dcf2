"""Rankers, metrics, bootstrap, lifecycle and streaming against hand-worked values."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import slug, stem, tokens, version
from marginalia.operators import audit, facet_index, lifecycle, metrics, ranking, stats
from marginalia.plans import evaluate
from marginalia.streaming import refresh


def test_tokens_and_names(spark):
    row = spark.createDataFrame([("The a Été-x2 I'm OK 7 42", "v1.2.md")], "t string, b string").select(tokens("t"), stem("b"), slug(F.lit(" Große & Kleine_Dinge! ")), version(F.lit("2.10.0")) > version(F.lit("2.9.9"))).first()
    assert list(row) == [["x2", "ok", "42"], "v1.2", "gro-e-kleine-dinge", True]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, "blue cow")], "doc_id int, text string")
    q = spark.createDataFrame([("q", "fox hen")], "qid string, text string")
    c = spark.createDataFrame([("q", i, i) for i in (1, 2, 3)], "qid string, doc_id int, pos int")
    idf, avg = math.log(2.5 / 1.5), 7 / 3
    score = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    rows = ranking.bm25(q, docs, c).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in rows] == [(1, round(score(1, 2), 6)), (2, round(score(1, 3), 6)), (3, 0.0)]


def test_negative_idf_is_a_share_of_the_mean(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "red cow")], "doc_id int, text string")
    q, c = spark.createDataFrame([("q", "red")], "qid string, text string"), spark.createDataFrame([("q", i, i) for i in (1, 2, 3)], "qid string, doc_id int, pos int")
    mean = (math.log(0.5 / 3.5) + 3 * math.log(2.5 / 1.5)) / 4
    assert ranking.bm25(q, docs, c).first()["score"] == pytest.approx(0.25 * mean, abs=1e-6)


def test_fusion_ties_and_rerank_tail(spark):
    a = spark.createDataFrame([("q", i, i, i) for i in range(25)], "qid string, doc_id int, pos int, rank int").withColumn("score", -F.col("rank").cast("double"))
    b = a.withColumn("rank", 24 - F.col("rank"))
    order = [r["doc_id"] for r in ranking.hybrid(a, b).orderBy("rank").collect()]
    assert order[:2] == [0, 24]  # equal scores, place decides
    docs = spark.createDataFrame([(i, "word" if i == 19 else "other") for i in range(25)], "doc_id int, text string")
    q = spark.createDataFrame([("q", "word")], "qid string, text string")
    order = [r["doc_id"] for r in ranking.rerank(q, docs, a).orderBy("rank").collect()]
    assert order[20:] == [20, 21, 22, 23, 24] and set(order[:20]) == set(range(20)) and order.index(19) < 19


def test_metrics_closed_forms(spark):
    r = spark.createDataFrame([("q", i, i) for i in range(12)], "qid string, doc_id int, rank int")
    gold = spark.createDataFrame([("q", 1), ("q", 6), ("q", 11)], "qid string, doc_id int")
    m = metrics.per_question(r, gold).first()
    dcg, ideal = 1 / math.log2(3) + 1 / math.log2(8), 1 + 1 / math.log2(3) + 1 / 2
    assert (m["hit1"], m["hit5"], m["recall5"], m["recall10"], m["mrr"]) == (0.0, 1.0, 0.333333, 0.666667, 0.5) and m["ndcg10"] == pytest.approx(dcg / ideal, abs=1e-6)
    none = metrics.per_question(r, gold.limit(0)).first()
    assert none["mrr"] == none["ndcg10"] == none["recall5"] == 0.0


def test_bootstrap(spark):
    d = spark.createDataFrame([("t", i, 0.1 * (i % 3)) for i in range(9)], "qtype string, qid int, diff double")
    row = stats.exact_bootstrap(d, resamples=500).first()
    assert row["lo"] <= row["mean"] <= row["hi"] and row["mean"] == pytest.approx(0.1)
    zero = stats.exact_bootstrap(d.withColumn("diff", F.lit(0.0)), resamples=50).first()
    assert zero["p"] == 1.0
    assert stats.hashed_bootstrap(d, resamples=100).first()["mean_diff"] == 0.1


def test_strategy_names():
    assert evaluate.parse_strategy("closets:emax") == ("closets", "emax")
    for bad in ("bm25", "content:bm25:x", "content:none", "none:bm25"):
        with pytest.raises(ValueError):
            evaluate.parse_strategy(bad)


def test_pagination_edges(spark):
    for n, archive, recent in ((30, 0, 0), (31, 1, 1), (36, 6, 5)):
        e = spark.range(n).select(F.lit("c").alias("collection"), F.col("id").alias("stem"), F.timestamp_seconds("id").alias("mtime"))
        p = facet_index.paginated(e)
        assert (p.filter("is_archive").count(), p.filter("recently_archived").count()) == (archive, recent)


def test_rotation_edges(spark):
    for n, gone in ((10, 0), (11, 1)):
        log = spark.range(n).select(F.lit("l").alias("k"), "id")
        assert lifecycle.rotated(log, "k", F.desc("id")).filter("archived").count() == gone


def test_archive_refuses_tier_one(spark):
    c = spark.createDataFrame([("a", 1, "", ""), ("b", 2, "", "")], "link string, tier int, reason string, date string")
    assert lifecycle.archived(c, "b", "old", "2026-01-01").filter("link = 'b'").first()["tier"] == 3
    with pytest.raises(ValueError):
        lifecycle.archived(c, "a", "old", "2026-01-01")


def test_collections(spark):
    hubs = spark.createDataFrame([("beds", "beds/_CLOSETS", "")], "folder string, link string, summary string")
    assert lifecycle.add_collection(hubs, "New Tools", "x").filter("folder = 'new-tools'").count() == 1
    assert lifecycle.similar_slugs(hubs, "Bets").count() == 1
    with pytest.raises(ValueError):
        lifecycle.add_collection(hubs, "Beds", "x")


def test_near_names_are_complete(spark):
    names = [(i, w) for i, w in enumerate(["alpha", "alpa", "alphas", "beta", "bet", "b", "", "xy", "yx", "gamma ray", "gama ray", "gammaray", "Alpha"])]
    got = {(r["a"], r["b"]) for r in audit.near_names(spark.createDataFrame(names, "id int, name string")).collect()}

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s):
            new = [i + 1]
            for j, y in enumerate(t):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    assert got == {(i, j) for i, s in names for j, t in names if i < j and distance(s.lower(), t.lower()) <= 2}


def test_self_test(spark):
    row = spark.createDataFrame([(1, None)], "a int, b int")
    assert {r["check"]: r["ok"] for r in lifecycle.self_test({"a": F.col("a") == 1, "b": F.col("b") == 1}, row).collect()} == {"a": True, "b": False}


def test_stream_refresh(spark, tmp_path):
    schema = refresh.SCHEMA
    at = lambda d: datetime(2026, 1, d)
    first = spark.createDataFrame([("c", f"s{i:02d}", at(1 + i % 9), "x") for i in range(32)] + [("d", "t", at(1), "y")], schema)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    go = lambda: refresh.stream_refresh(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    spark.createDataFrame([("c", "s00", at(20), "new")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    index = spark.read.parquet(str(tmp_path / "out" / "index" / "batch=1"))
    assert index.select("collection").distinct().collect()[0][0] == "c" and index.count() == 32
    assert index.filter("place = 1").first()["content"] == "new" and index.filter("is_archive").count() == 2
    # what the second batch doesn't touch is as the first one left it
    whole = refresh.current_index(spark, str(tmp_path / "out"))
    assert whole.count() == 33 and whole.filter("collection = 'd'").first()["content"] == "y" and whole.filter("collection = 'c' and place = 1").first()["content"] == "new"
    assert not (tmp_path / "out" / "state" / "batch=1" / "collection=d").exists()


def test_compared_by_type(spark):
    questions = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(20)] + [(90, "lonely")], "qid int, qtype string")
    a = spark.createDataFrame([(i, 1.0) for i in range(20)] + [(90, 1.0)], "qid int, m double")
    b = spark.createDataFrame([(i, 0.5 if i % 2 else 1.0) for i in range(20)], "qid int, m double")
    rows = {r["grp"]: r for r in stats.compared(a, b, questions, "m", resamples=400).collect()}
    assert set(rows) == {"all", "a", "b", "lonely"}
    assert (rows["a"]["n"], rows["a"]["mean_diff"], rows["a"]["p"], rows["a"]["mark"]) == (10, 0.5, 0.0, "***")
    assert rows["all"]["mean_diff"] == 0.25 and rows["b"]["mean_diff"] == 0.0 and rows["b"]["mark"] == ""
    # no question of both sides: nothing compared
    assert tuple(rows["lonely"][c] for c in ("n", "mean_diff", "ci_low", "ci_high", "p", "mark")) == (0, 0.0, 0.0, 0.0, 1.0, "")


def test_overlap_candidates_lose_no_pair(spark):
    import itertools
    import random

    from marginalia.operators.overlaps import candidate_pairs, rarest_first

    rng = random.Random(12)
    sets = {k: {"common", *rng.sample("abcdefghij", rng.randint(0, 6))} if rng.random() < 0.8 else set(rng.sample("abcdefghij", rng.randint(1, 5))) for k in range(60)}
    rows = rarest_first(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "k int, words array<string>"))
    for share in (0.5, 0.8, 1.0):
        found = {(r["l_k"], r["r_k"]) for r in candidate_pairs(rows, rows, share).collect()}
        wanted = {(a, b) for a, b in itertools.permutations(sets, 2) if len(sets[a] & sets[b]) >= share * min(len(sets[a]), len(sets[b])) - 1e-9}
        assert wanted <= found


def test_equal_names_are_one_class(spark):
    rows = [(k, "readme") for k in range(50)] + [(90, "README"), (91, "readmes"), (92, "other")]
    pairs = {(r["a"], r["b"]): r["distance"] for r in audit.near_names(spark.createDataFrame(rows, "id int, name string"), every=False).collect()}
    assert pairs == {(0, k): 0 for k in [*range(1, 50), 90]} | {(0, 91): 1}


def test_blockers_by_inner_words(spark):
    log = [(1, "the water pump is broken"), (2, "a water pump"), (3, "Fix the Old Water Pump now"), (4, "old water pumps"), (9, "old  water pump"), (9, None)]
    items = ["old water pump", "water pump", "pump", "nothing"]
    frame = spark.createDataFrame([(datetime(2026, 1, d), t) for d, t in log], "date timestamp, text string")
    found = {r["item"]: r["n_entries"] for r in audit.blockers(spark.createDataFrame([(i,) for i in items], "item string"), frame).collect()}
    assert found == {i: sum(i in (t or "").lower() for _, t in log) for i in items}


def test_numbered_by_ranges(spark):
    from marginalia.operators.ordering import numbered

    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), (F.col("id") % 3).alias("y"))
    got = numbered(rows, "y", "x").orderBy("ordinal").collect()
    assert [(r["y"], r["x"]) for r in got] == sorted((r["y"], r["x"]) for r in got) and [r["ordinal"] for r in got] == list(range(1, 501))


def test_token_totals_are_counted_where_the_texts_lie(spark):
    rows = [(1, "Kiwi kiwi plum"), (2, "plum fig"), (2, "plum"), (3, None), (None, "fig fig")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = ranking.token_totals(texts, "doc_id")
    assert {(r["token"], r["df"], r["cf"]) for r in found.collect()} == {("kiwi", 1, 2), ("plum", 2, 3), ("fig", 2, 3)}
    plan = ranking.token_totals(spark.createDataFrame([(1, "a plum")], "doc_id long, text string").filter("doc_id > 0"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan.split("UnionExec")[0].split("Union")[0]


def test_candidates_of_bm25_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ranking, "DEALT_CANDIDATES", 4, raising=False)
    texts = spark.createDataFrame([(i, f"kiwi plum{i % 3}") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "plum1 kiwi"), (1, "plum2 plum2")], "qid long, text string")
    pairs = spark.createDataFrame([(i % 2, i, i) for i in range(40)], "qid long, doc_id long, pos long")
    rows = ranking.bm25(asked, texts, pairs)
    assert rows.rdd.getNumPartitions() == 10
    assert {r["doc_id"] % 3 for r in rows.filter("rank < 3 and qid = 0").collect()} == {1}
    assert {r["doc_id"] % 3 for r in rows.filter("rank < 3 and qid = 1").collect()} == {2}


def test_passages_go_to_the_texts_that_hold_them(spark, tmp_path):
    from marginalia.catalog import retrieval

    spark.createDataFrame([(1, "so the old kiwi tree fell"), (2, "kiwi"), (3, None), (4, "an old kiwi tree")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "the old kiwi tree"), (8, "old kiwi")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = retrieval._contained(spark, str(tmp_path))
    assert {(r["qid"], r["doc_id"]) for r in found.collect()} == {(7, 1), (8, 1), (8, 4)}
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
