"""Queries read all of their input, by brute force."""

import math
import os
from collections import Counter

import pytest

from marginalia.catalog import QUERIES
from marginalia.functions import patterns as P

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(text):
    import re

    return [w for w in map(str.lower, re.findall("[A-Za-z0-9]+", text)) if len(w) > 1 and w not in P.STOP_WORDS]


def brute_bm25(question, documents):
    """Scores of all documents for one question, written out."""
    docs = {k: Counter(words(t)) for k, t in documents.items()}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t in {t for d in docs.values() for t in d} for f in [sum(t in d for d in docs.values())]}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if x < 0 else x for t, x in raw.items()}
    return {k: round(sum(q * idf[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * sum(d.values()) / mean)) for t, q in Counter(words(question)).items() if t in d), 6) for k, d in docs.items()}


def test_words_after_the_400th_character_are_asked(spark, tmp_path):
    asked = "filler " * 80 + "heron kite heron"
    texts = {1: "filler words here", 2: "the heron stands by water", 3: "kite and heron and kite", 4: "nothing of that", 5: "some other thing", 6: "more filler words"}
    spark.createDataFrame([(0, asked), *texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(7)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r["doc_id"]: r["score"] for r in QUERIES["bm25_candidates"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(brute_bm25(asked, texts), abs=2e-6) and found[2] != 0 and found[3] != 0


def brute_weeks(events):
    """Weeks by comparing all pairs of (key, time, text)."""
    from datetime import timedelta

    by = {}
    for k, ts, text in events:
        by.setdefault(ts.date() - timedelta(days=ts.weekday()), []).append((k, set(words(text))))
    met = {w: {a for a, x in rows for b, y in rows if a != b and x and y and len(x & y) / min(len(x), len(y)) >= 0.5} for w, rows in by.items()}
    return {w: len(keys) for w, keys in met.items() if len(keys) >= 3}


def test_week_clusters_read_all_users(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    errors = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type = 'error'").select("event_id", "ts", "props").collect()
    found = {r["week"]: r["n"] for r in QUERIES["week_clusters"](spark, FOLDER).collect()}
    assert found == brute_weeks(errors)


def test_week_clusters_of_mixed_word_sets(spark):
    import random
    from datetime import datetime, timedelta

    from marginalia.operators import audit

    rng = random.Random(6)
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 24 * 60)), " ".join(rng.choices(["red", "blue", "green", "x", *(f"word{i}" for i in range(40))], k=rng.randint(0, 5)))) for k in range(150)]
    found = audit.week_clusters(spark.createDataFrame([*rows, (900, None, "red blue"), (901, None, "red blue"), (902, None, "red")], "ordinal long, date timestamp, text string")).collect()
    assert {r["week"]: r["n"] for r in found} == brute_weeks(rows)


def test_blockers_count_all_entries(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    days = {}
    for kind, ts in spark.read.parquet(f"{FOLDER}/events.parquet").select("event_type", "ts").collect():
        days.setdefault(kind, []).append(ts.date())
    found = {r["item"]: (r["n_entries"], r["days"]) for r in QUERIES["blockers"](spark, FOLDER).collect()}
    assert found == {k: (len(d), (max(d) - min(d)).days) for k, d in days.items()}


def test_token_overlap_of_all_sources(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    items = [(i, set(words(t))) for i, t in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [(i, set(words(t or ""))) for i, t in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    found = {(r["item_id"], r["doc_id"]): r["share"] for r in QUERIES["token_overlap"](spark, FOLDER).collect()}
    assert found == pytest.approx({(i, d): len(b & w) / len(b) for i, b in items for d, w in docs if b & w}, abs=1e-6)


@pytest.mark.parametrize("rare", [True, False])
def test_corpus_wide_best_against_all_scores(spark, rare):
    """Questions whose common words bring in no documents, and questions of common words only."""
    import random

    from marginalia.operators import ranking

    rng = random.Random(21)
    common = [f"common{i}" for i in range(6)]
    texts = {k: " ".join(rng.choices(common, k=rng.randint(3, 9)) + ([f"rare{k % 9}"] * 3 if rare and k % 4 == 0 else [])) for k in range(160)}
    asked = {q: " ".join(([f"rare{q % 9}", f"rare{(q + 1) % 9}"] * 4 if rare else []) + rng.choices(common, k=3)) for q in range(6)}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    found = {}
    for r in ranking.bm25_corpus(frame(asked, "qid"), frame(texts, "doc_id"), 4).collect():
        found.setdefault(r["qid"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q, text in asked.items():
        scores = brute_bm25(text, texts)
        sharing = {k for k, t in texts.items() if set(words(t)) & set(words(text))}
        best = sorted(sharing, key=lambda k: (-scores[k], k))[:4]
        assert [(i, d) for i, d, _ in sorted(found[q])] == list(enumerate(best))
        assert [s for _, _, s in sorted(found[q])] == pytest.approx([scores[k] for k in best], abs=2e-6)
