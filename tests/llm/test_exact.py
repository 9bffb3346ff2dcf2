import hashlib
import random
import re

from marginalia.llm.exact import PatriciaTrie, exact_groups, normalised, shared_prefix, trie_owners
from marginalia.llm.queries import op10_exact_dedup


def test_normalised_and_prefix():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([" ", "\t", "\n", "\x0b", "a", "é", "\xa0", "\x1f", "  "]) for _ in range(rng.randint(0, 8)))
        assert normalised(text.encode()).decode() == re.sub("[\x20\x09-\x0d]+", " ", text)
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in "xx")
        assert shared_prefix(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_trie_with_and_without_spill():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 3, 8, 200]))) for _ in range(3000)]
    keys += [b"shared prefix " * 20 + k for k in keys[:500]]
    want = {}
    for i, k in enumerate(keys):
        want.setdefault(k, [i, 0])[1] += 1
    for budget in (None, 20_000, 3_000):
        trie = PatriciaTrie(budget)
        for i, k in enumerate(keys):
            trie.insert(k, i, 1, k)
            assert not budget or trie.root.weight <= budget + 5000
        assert {tag: [a, b] for a, b, tag in trie.owners()} == want


def test_query(spark, sf):
    source = {r["doc_id"]: re.sub("[\x20\x09-\x0d]+", " ", r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = {}
    for i, t in source.items():
        groups.setdefault(t, []).append(i)
    rows = op10_exact_dedup(spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        own = groups[source[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(own), len(own), r["doc_id"] == min(own)) and r["text_sha256"] == hashlib.sha256(source[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, empty):
    rows = {(r["id"], r["keep_id"], r["n"]) for r in exact_groups(odd).collect()}
    assert {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (7, 4, 2), (5, 5, 2), (None, None, 1), (8, 8, 1), (9, 9, 1)} == rows
    assert exact_groups(empty).count() == 0 and trie_owners(odd).count() == 7
