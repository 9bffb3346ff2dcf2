import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import language
from marginalia.llm.queries import op1_language_id, public_tokenizer

PATH = public_tokenizer("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    prefix = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    table = np.random.default_rng(1).random((7, 2))

    def brute(s):
        if not s:
            return np.ones(2)
        total, single = np.zeros(2), False
        for k in range(1, len(s) + 1):
            if s[:k] in prefix:
                total += table[prefix[s[:k]]] * brute(s[k:])
                single |= k == 1
        return total if single else total + table[6] * brute(s[1:])

    words = ["ab", "a", "", "zab", "abab"]
    assert np.allclose(language.Lattice.of(["▁" + w for w in words], prefix, 6).likelihood(table), np.log([brute("▁" + w) for w in words]))


def segmentations(s, prefix, unknown):
    """All ways to write s as pieces; a character without a piece of its own may be an unknown one."""
    if not s:
        yield []
        return
    for k in range(1, len(s) + 1):
        row = prefix.get(s[:k], -1)
        if row >= 0:
            yield from ([row, *rest] for rest in segmentations(s[k:], prefix, unknown))
    if prefix.get(s[0], -1) < 0:
        yield from ([unknown, *rest] for rest in segmentations(s[1:], prefix, unknown))


def test_expected_counts_of_all_segmentations():
    prefix = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5}
    rng = np.random.default_rng(2)
    table, words = rng.random((7, 3)), ["▁ab", "▁abab", "▁xab", "▁", "▁bbaab"]
    counts = rng.integers(0, 9, (5, 3)).astype(float)
    want = np.zeros((7, 3))
    for w, n in zip(words, counts):
        ways = list(segmentations(w, prefix, 6))
        chance = np.array([np.prod(table[way], axis=0) for way in ways])
        for way, p in zip(ways, chance / chance.sum(axis=0)):
            for piece in way:
                want[piece] += p * n
    assert np.allclose(language.Lattice.of(words, prefix, 6).expected(table, counts), want)


def test_long_words_are_summed_whole(monkeypatch):
    prefix = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "aba": 5}
    table = np.random.default_rng(3).random((7, 2)) * [[1.0, 0.01]]
    rng, counts = random.Random(4), np.array([[2.0, 1.0]] * 6)
    words = ["▁" + "".join(rng.choice("abx") for _ in range(n)) for n in (3, 9, 17, 28, 30, 31)]
    lattice = language.Lattice.of(words, prefix, 6)
    plain, expected = lattice.likelihood(table), lattice.expected(table, counts)
    monkeypatch.setattr(language, "LONG", 1)
    assert np.allclose(lattice.likelihood(table), plain) and np.allclose(lattice.expected(table, counts), expected)
    monkeypatch.undo()
    huge = language.Lattice.of(["▁" + "abx" * 5000, "▁" + "ab" * 40], prefix, 6)
    logs, found = huge.likelihood(np.full((7, 1), 1e-9)), huge.expected(np.full((7, 1), 1e-9), np.ones((2, 1)))
    assert np.isfinite(logs).all() and logs[0, 0] < -100_000 and abs(found[6, 0] - 5000) < 1e-3


def test_words():
    assert language.letter_words("“Élan” – d’été: a1b naïve") == ["Élan".encode(), b"d", "été".encode(), b"a", b"b", "naïve".encode()]
    assert language.letter_words("क्षत्रिय, 中文。字") == ["क्षत्रिय".encode(), "中文".encode(), "字".encode()]
    assert not language.has_letter(language.letter_words("12 — “ ” …")) and language.has_letter(language.letter_words("…é"))


def brute_model(rows):
    """Words, expected counts and likelihoods, written out word by word."""
    own = language.vocabulary(PATH)
    languages = sorted({lang for _, lang in rows})
    counts = {}
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts.setdefault(w, Counter())[lang] += 1

    def probabilities(sums):
        out = {}
        for lang in languages:
            total = sum(sums[lang].values()) + language.SMOOTHING * (own.size + 1)
            out[lang] = [max((sums[lang][k] + language.SMOOTHING) / total, language.FLOOR) for k in range(own.size)] + [language.FLOOR]
        return out

    def edges(s):
        for i in range(len(s)):
            ends = [j for j in range(i + 1, len(s) + 1) if own.prefix.get(s[i:j], -1) >= 0]
            yield from ((i, j, own.prefix[s[i:j]]) for j in ends)
            if i + 1 not in ends:
                yield i, i + 1, own.unknown

    def forward(s, p):
        alpha = [1.0] + [0.0] * len(s)
        for i, j, piece in sorted(edges(s), key=lambda e: e[1]):
            alpha[j] += alpha[i] * p[piece]
        return alpha

    sums = {lang: Counter() for lang in languages}
    for w, by in counts.items():
        for piece in own.processor.encode(w):
            for lang, n in by.items():
                sums[lang][own.row.get(piece, own.unknown)] += n
    p = probabilities(sums)
    sums = {lang: Counter() for lang in languages}
    for w, by in counts.items():
        s = "▁" + w
        for lang, n in by.items():
            alpha, beta = forward(s, p[lang]), [0.0] * len(s) + [1.0]
            for i, j, piece in sorted(edges(s), key=lambda e: -e[0]):
                beta[i] += p[lang][piece] * beta[j]
            for i, j, piece in edges(s):
                sums[lang][piece] += n * alpha[i] * p[lang][piece] * beta[j] / alpha[-1]
    p = probabilities(sums)

    def judged(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        logs = [sum(n * math.log(forward("▁" + w, p[lang])[-1]) for w, n in Counter(words).items()) for lang in languages]
        best = max(range(len(logs)), key=lambda k: (logs[k], -k))
        return languages[best], 1 / sum(math.exp(x - logs[best]) for x in logs)

    return judged


def test_query_against_brute_force(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60 and length(text) < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = docs.collect()
    judged = brute_model([(r["text"], r["lang"]) for r in rows if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2])
    found = op1_language_id(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) > 10
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in found:
        lang, score = judged(texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6


def test_held_out_accuracy(spark, sf):
    rows = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert rows.filter("lang = lang_pred").count() >= 0.9 * rows.count() > 0


def test_odd_rows(spark, odd, empty):
    model = language.learn(odd, PATH)
    rows = language.identify(odd, model, PATH).select("record.doc_id", "record.text", "lang_pred", "score", "record.shard").collect()
    assert len(rows) == 10
    for r in rows:
        known = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not known) and 0 <= r["score"] <= 1 and not math.isnan(r["score"])
    none = language.learn(empty, PATH)
    assert {r["lang_pred"] for r in language.identify(odd, none, PATH).collect()} == {"und"}
    assert language.identify(empty, model, PATH).count() == 0


@pytest.mark.parametrize("doc,held", [(1, None), (None, False)])
def test_held_out_rule(spark, doc, held):
    row = spark.createDataFrame([(doc,)], "d long").select(language.held_out(F.col("d")).alias("h")).first()
    assert row["h"] == (zlib.crc32(str(doc).encode()) % 4 == 2 if doc is not None else held)


def long_words(rng, n):
    """Runs of letters: of words strung together, of one letter, and of letters no piece has."""
    parts = ["ing", "the", "tion", "q", "zx", "é", "語", "a", "und", "ﬃ"]
    return ["▁" + "".join(rng.choice(parts) for _ in range(n)), "▁" + "a" * n, "▁" + "語" * n, "▁" + "ab" * n, "▁"]


@pytest.mark.parametrize("block", [1, 7, 64, 512])
def test_blocks_give_the_sum_over_all_segmentations(block):
    rng = np.random.default_rng(2)
    own = language.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    table = np.maximum(rng.dirichlet(np.ones(own.size + 1) * 0.1, 3).T, language.FLOOR)
    for n in (1, 5, 40, 700):
        for word in long_words(random.Random(n), n):
            _, lattice = next(language.lattices([word], own, 3))
            assert np.allclose(language.blocked_likelihood(word, own, table, block), lattice.likelihood(table)[0], rtol=1e-9)


def test_very_long_words_in_bounded_memory():
    import time
    import tracemalloc

    own = language.vocabulary(public_tokenizer("piece_bpe_32k.model"))
    table = np.full((own.size + 1, 5), 1 / own.size)
    word = "".join(random.Random(3).choices("etaoinshr", k=1_000_000))
    began = time.process_time()
    logs = language.blocked_likelihood(word, own, table)
    assert np.isfinite(logs).all() and time.process_time() - began < 15
    tracemalloc.start()
    language.blocked_likelihood(word[:300_000], own, table)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_a_very_long_word_among_documents(spark):
    rows = [(i, lang, w * 30) for i, (lang, w) in enumerate([("en", "the thing and that "), ("de", "und nicht der die ")] * 20)] + [(100, "en", "thethingandthat" * 3000), (101, None, "undnichtderdie" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.learn(docs, public_tokenizer("piece_bpe_32k.model"))
    assert max(map(len, model.words)) <= language.KNOWN_BYTES
    found = {r["record"]["doc_id"]: r["lang_pred"] for r in language.identify(docs, model, public_tokenizer("piece_bpe_32k.model")).collect()}
    assert found[100] == "en" and found[101] == "de"
