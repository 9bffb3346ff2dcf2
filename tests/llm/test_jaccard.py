import os
import random
import re

import numpy as np
import pytest

from marginalia.llm import common, jaccard, textkeys
from marginalia.llm.components import components
from marginalia.llm.queries import op2_ngram_jaccard
from marginalia.llm.textkeys import batch_shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, k, percent):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append(set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


def found(df, k, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, shingle=k, percent=percent).collect()}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_random_near_copies(spark, k, percent):
    rng = random.Random(k)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randint(1, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["NEW", "ax", "q" + str(rng.randint(0, 9))])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "ONE two"), (204, "one TWO"), (205, "one\x0btwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, k, percent) == brute(rows, k, percent)


def test_long_lists_and_blocks(spark, monkeypatch):
    """One template with single edits: lists longer than a block, links only through others."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "AT_ONCE", 0)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(90):
        own = list(words)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(70)] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 4, 85) == brute(rows, 4, 85)


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_ngram_jaccard(spark, sf).collect()}
    assert got == brute(rows, 4, 85)


def test_odd_rows(spark, odd, empty):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == 10 and jaccard.jaccard_components(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[4] == {(1, 4)} and by[7] == {(1, 4)} and by[1] == {(0, 1)} and len(by[5]) == 1 and by[5].pop()[1] == 5


def test_sketch_bounds_hold():
    rng = np.random.default_rng(0)
    for n in (1, 5, 100, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64)]))
        for x, y in ((jaccard.sketch(a), jaccard.sketch(b)), (jaccard.small_sketch(jaccard.sketch(a), len(a)), jaccard.small_sketch(jaccard.sketch(b), len(b)))):
            size = min(len(x), len(y))
            p, q = (jaccard.folded(np.frombuffer(v, np.uint8)[None, :], size)[0] for v in (x, y))
            assert len(a) - np.bitwise_count(p & ~q).sum() >= len(np.intersect1d(a, b))


def test_shingles_in_any_batching():
    texts = [b"a b c d e", b"", b"x", b"A B c D", b"a " * 5000]
    whole, small = [list(map(list, batch_shingles(texts, 4, b))) for b in (1 << 22, 10)]
    assert whole == small and whole[3][0] in whole[0] and len(whole[4]) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100}


def linked(rows, shingle, percent):
    """Every linked pair of rows with different sets, by comparing all pairs."""
    sets = {i: brute_set(t, shingle) for i, t in rows}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}, sets


def brute_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_copies(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = list(words[: rng.choice((60, 60, 58, 40))])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 5)}"
        rows.append((i, " ".join(own)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, "w1 w2"), (n + 3, "w1 w2")]


@pytest.mark.parametrize("percent", [85, 20])
@pytest.mark.parametrize("bits", [64, 5])
def test_all_links(spark, monkeypatch, percent, bits):
    """Long lists in blocks and cells, hash collisions of sets, and sketches of unlike widths."""
    for name, value in (("BLOCK", 8), ("SHORT", 2), ("CELL", 2), ("SPILL_BYTES", 300)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(70, 9) + [(500 + k, " ".join(f"w{i}" for i in range(k % 11 * 6))) for k in range(22)]
    want, sets = linked(rows, 4, percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, members = jaccard.jaccard_links(df, shingle=4, percent=percent, bits=bits)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    of = {i: first[frozenset(sets[i])] for i in sets}
    assert {tuple(r) for r in links.collect()} == {(min(of[a], of[b]), max(of[a], of[b])) for a, b in want}
    for r in members.collect():
        i = r["doc_id"]
        own = sum(bool(sets[i]) and j != i and sets[j] == sets[i] for j in sets) + sum(i in pair for pair in want)
        assert r["n_links"] == own and r["n_shingles"] == len(sets[i]) and (not sets[i] or r["class_id"] == of[i])
    assert found(df, 4, percent) == brute(rows, 4, percent)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df, shingle=4, percent=percent, bits=bits).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, percent).items()}


def test_words_in_stretches(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n\tXé") for _ in range(rng.randint(0, 90))).encode() for _ in range(40)] + [b"x" * 300, b""]
    whole = textkeys.word_hashes(texts)
    monkeypatch.setattr(textkeys, "STRETCH", 16)
    cut = textkeys.word_hashes(texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all() and whole[1].tolist() == [len(t.split()) for t in texts]


def test_staged_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rows = near_copies(30, 2)
    assert jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)
    # what the lazy result reads stays
    assert {name.rsplit("-", 1)[0] for name in os.listdir(tmp_path)} <= {"features", "classes", "found"}
