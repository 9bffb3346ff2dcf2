import random

import pytest

from marginalia.operators import chains


def by_hand(links):
    to = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            to[a] = max(b, to.get(a, b))
    out = {}
    for a in to:
        seen, at = [a], to[a]
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        out[a] = (None, None, min(seen[seen.index(at) :])) if at in seen else (at, len(seen), None)
    return out


def found(spark, links):
    rows = chains.ends(spark.createDataFrame(links, "item long, by long")).collect()
    assert len({r["item"] for r in rows}) == len(rows)
    return {r["item"]: (r["last"], r["steps"], r["cycle"]) for r in rows}


@pytest.mark.parametrize("name", ["chain", "cycle", "hot", "random", "two ways", "none"])
def test_chains(spark, name):
    rng = random.Random(name)
    links = {
        "chain": [(i, i + 1) for i in range(37)],
        "cycle": [(i, (i + 1) % 7 + 10 * (i >= 10)) for i in (0, 1, 2, 3, 4, 5, 6)] + [(20, 0), (21, 20), (30, 31), (31, 30), (40, 41), (41, 42)],
        "hot": [(i, 1000) for i in range(200)] + [(1000, 1001), (1001, 1002)] + [(2000 + i, i) for i in range(50)],
        "random": [(i, rng.randrange(60)) for i in range(50)],
        "two ways": [(1, 2), (1, 3), (1, 2), (2, 4), (3, 3), (None, 1), (5, None)],
        "none": [],
    }[name]
    rng.shuffle(links)
    assert found(spark, links) == by_hand(links)
