import random

import pytest

from marginalia.operators import audit

WORDS = "red blue bolt gear ring plate small large brass steel".split()


def decisions(spark, n, seed, kinds=12):
    rng = random.Random(seed)
    texts = [" ".join(rng.sample(WORDS, rng.randrange(1, 6))) for _ in range(kinds)]
    rows = [(i, rng.choice(["", "Replaces "]) + rng.choice(texts), rng.random() < 0.2) for i in range(n)]
    return rows + [(n, None, False), (None, "replaces red ring", False), (n + 1, "a", False), (n + 2, "replaces red ring", None)]


def by_hand(rows, similar):
    sets = [(k, {w for w in (text or "").lower().split() if len(w) > 1}, "replaces" in (text or "").lower(), struck) for k, text, struck in rows if k is not None]
    return {(a, b) for a, x, says, _ in sets for b, y, _, struck in sets if says and struck is False and b < a and x and y and len(x & y) >= similar * len(x | y)}


@pytest.mark.parametrize("similar", [0.5, 0.6, 1.0])
def test_pairs_of_decisions_and_the_last_of_each(spark, similar):
    rows = decisions(spark, 150, similar)
    df = spark.createDataFrame(rows, "ordinal long, text string, struck boolean")
    found = [tuple(r) for r in audit.overrides(df, similar=similar).collect()]
    wanted = by_hand(rows, similar)
    assert len(found) == len(set(found)) and set(found) == wanted
    last = {}
    for newer, older in wanted:
        last[older] = max(newer, last.get(older, newer))
    assert sorted((r["older"], r["newer"]) for r in audit.last_overrides(df, similar=similar).collect()) == sorted(last.items())


def test_repeated_ordinals_give_a_pair_once(spark):
    rows = [(1, "red ring", False), (1, "red ring bolt", False), (2, "replaces red ring", False)]
    found = audit.overrides(spark.createDataFrame(rows, "ordinal long, text string, struck boolean"), similar=0.5).collect()
    assert [tuple(r) for r in found] == [(2, 1)]


def test_equal_texts_are_compared_once(spark):
    rows = decisions(spark, 3000, 7)
    topics = {frozenset(w for w in (text or "").lower().split()) for _, text, _ in rows}
    pairs = audit._topics(spark.createDataFrame(rows, "ordinal long, text string, struck boolean"), ("replaces",), 0.5)[2]
    assert pairs.count() <= len(topics) ** 2 < len(rows)
