import itertools
import random

import pytest

from marginalia.llm import decontamination as d
from marginalia.llm.queries import op7_decontamination


@pytest.mark.parametrize("n", [10, 15, 20])
def test_masks_hit_whatever_a_fifth_of_the_words_is_lost(n):
    for gone in itertools.combinations(range(n), n // 5):
        assert any(all(p + o not in gone for o in m) for m in d.MASKS for p in range(n - m[-1]))


def brute(docs, items, share=d.OVERLAP, window=d.WINDOW):
    """Substitution-tolerant containment on every alignment, without shifts."""
    out = set()
    for i, text in docs:
        w = (text or "").lower().split()
        for item, passage in items:
            p = passage.lower().split()
            size = min(window, len(p))
            for shift in range(-len(p) + 1, len(w)):
                same = [0 <= k + shift < len(w) and w[k + shift] == p[k] for k in range(len(p))]
                if max(sum(same[a : a + size]) for a in range(len(p) - size + 1)) >= share * size:
                    out.add((i, item))
                    break
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("stuvw") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 70)))) for k in range(8)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            own = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, len(own) // 4)):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randint(0, len(text))
            text[at:at] = own
        docs.append((i, " ".join(text).upper() if i % 5 == 0 else " ".join(text)))
    a, b = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in d.find_overlaps(a, b, block_words=100).collect()}
    assert got == brute(docs, items)
    clean = {r["doc_id"] for r in d.decontaminated(a, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def test_insertions_and_long_passages(spark):
    passage = [f"w{i}" for i in range(200)]
    cut = passage[60:120]
    docs = [(1, " ".join(cut[:25] + ["new"] + cut[25:])), (2, " ".join(passage[:30])), (3, " ".join(cut[:30] + cut[33:]))]
    a, b = frames(spark, docs, [(9, " ".join(passage))])
    assert {r["doc_id"] for r in d.find_overlaps(a, b).collect()} == {1, 3}


def test_contained_passages_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    held = {(x["doc_id"], i["item_id"]) for x in docs for i in items if i["text"] in (x["text"] or "")}
    assert held <= {(r["doc_id"], r["item_id"]) for r in op7_decontamination(spark, sf).collect()}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (None, "no id here at all"), (2, "x y z"), (3, ""), (4, "no id here at all")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in d.find_overlaps(odd, items).collect()] == [(None, 4)]
    assert d.decontaminated(odd, items).count() == 9 and d.decontaminated(odd, items).columns == odd.columns
    assert d.find_overlaps(empty, items).count() == 0 and d.find_overlaps(odd, items.limit(0)).count() == 0 and d.decontaminated(odd, items.limit(0)).count() == 10


@pytest.mark.parametrize("n", range(5, 21))
def test_masks_hit_at_every_length(n):
    for gone in itertools.combinations(range(n), n // 5):
        assert any(all(p + o not in gone for o in m) for m in d.MASKS for p in range(n - m[-1]))


def test_short_passages_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("stuvw") + rng.choice("xyz")
    items = [(k, " ".join(word() for _ in range(1 + k % 7))) for k in range(28)]
    docs = [(-1, items[0][1]), (-2, ""), (-3, None)]
    for i in range(150):
        text, own = [word() for _ in range(rng.randint(0, 12))], rng.choice(items)[1].split()
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = "zz"
        at = rng.randint(0, len(text))
        text[at:at] = own
        docs.append((i, " ".join(text)))
    a, b = frames(spark, docs, items)
    rows = d.find_overlaps(a, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items) and len(rows) == len(brute(docs, items))
    assert {r["doc_id"] for r in d.decontaminated(a, b).collect()} == {i for i, _ in docs} - {i for i, _ in brute(docs, items)}


def test_one_very_long_text(spark):
    """Words are hashed in stretches; a passage across their borders and at the end is found."""
    passage = " ".join(f"word{i}" for i in range(30))
    long = "filler and more " * 130_000
    a, b = frames(spark, [(1, long + passage), (2, long[: (1 << 20) - 60] + " " + passage + " " + long), (3, long)], [(7, passage)])
    assert sorted((r["doc_id"], r["item_id"]) for r in d.find_overlaps(a, b).collect()) == [(1, 7), (2, 7)]


def repeating(rng, period, n):
    own = [f"w{rng.randrange(9)}" for _ in range(period)]
    return [own[i % period] for i in range(n)]


@pytest.mark.parametrize("period", [1, 2, 3, 5])
def test_repeated_words_against_brute_force(spark, period, monkeypatch):
    """Passages and texts of few words over and over, by hits and by sweeping."""
    rng = random.Random(period)
    items = [(k, " ".join(repeating(rng, period, rng.randint(5, 70)))) for k in range(6)]
    docs = []
    for i in range(40):
        text = repeating(rng, rng.choice([1, period, 4]), rng.randint(0, 120))
        for _ in range(rng.randint(0, len(text) // 6)):
            text[rng.randrange(len(text))] = "zz"
        if rng.random() < 0.4:
            text[len(text) // 2 : len(text) // 2] = rng.choice(items)[1].split()
        docs.append((i, " ".join(text)))
    want = brute(docs, items)
    index = d.SeedIndex([(k, t.encode()) for k, t in items])
    for sparse in (0, 10**9):
        monkeypatch.setattr(d, "SPARSE", sparse)
        rows = sorted(index.overlaps([t.encode() for _, t in docs], overlap=d.OVERLAP, window=d.WINDOW, band=0))
        assert {(docs[t][0], item) for t, item, *_ in rows} == want
        # with shifted runs counted the two ways agree as well
        rows = sorted(index.overlaps([t.encode() for _, t in docs], overlap=d.OVERLAP, window=d.WINDOW, band=d.BAND))
        assert want <= {(docs[t][0], item) for t, item, *_ in rows}
        first = rows if sparse == 0 else first
        assert rows == first


@pytest.mark.parametrize("n, m", [(100, 2000), (400, 8000), (60, 500_000)])
def test_repeated_words_take_no_time(n, m):
    import time

    for words in (["0"], ["0", "1"], ["a", "b", "c", "d", "e"]):
        passage, text = " ".join((words * n)[:n]), " ".join((words * m)[: m - 7] + ["end"] * 7)
        near = " ".join("x" if i % 9 == 4 else w for i, w in enumerate((words * n)[:n]))
        index = d.SeedIndex([(1, passage.encode()), (2, near.encode())])
        began = time.process_time()
        found = list(index.overlaps([text.encode()], overlap=d.OVERLAP, window=d.WINDOW, band=d.BAND))
        assert {f[1] for f in found} == {1, 2} and time.process_time() - began < 6


def test_many_blocks_are_staged(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").limit(40)
    one, many = (sorted(tuple(r) for r in d.find_overlaps(docs, items, block_words=size).collect()) for size in (d.BLOCK_WORDS, 700))
    assert one == many and len(one) >= 3
    assert sorted(r["doc_id"] for r in d.decontaminated(docs, items, block_words=700).collect()) == sorted(set(r["doc_id"] for r in docs.select("doc_id").collect()) - {o[0] for o in one})
