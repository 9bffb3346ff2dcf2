"""The trigram index against a scan of all lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import contains_literal
from marginalia.operators import trigrams

WORDS = ["garden", "Garden", "harbour", "bed", "ÉTÉ", "ΟΔΟΣ", "a.b", "x+y", "[[note-7]]", "warden", "gardener", "𝄞clef", "", "ab", "the", "İstanbul"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "corpus string, rel string, folder string, line_no int, line string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [("c", f"f{f % 5}/n{f}.md", f"f{f % 5}", n + 1, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))) for f in range(120) for n in range(rng.choice([1, 3, 600]) if f % 30 == 0 else 3)]
    rows += [("c", "null.md", ".", 1, None), ("c", "rare.md", ".", 1, "one quixotic line")]
    path = str(tmp_path_factory.mktemp("index"))
    trigrams.write_index(frame(spark, rows), path)
    return rows, path


def scan(spark, rows, query, mode):
    return {tuple(r) for r in frame(spark, rows).filter((F.col("line") != "") & contains_literal("line", query, mode)).collect()}


@pytest.mark.parametrize("query", ["garden", "GARDEN", "rden", "ab", "", "n", "note-7]]", "quixotic", "absent", "ΟΔΟΣ", "οδο", "été", "a.b", "x+y", "bed the", "𝄞cl", "İst", "istanbul"])
def test_literals(spark, indexed, query):
    rows, path = indexed
    assert {tuple(r) for r in trigrams.search(spark, path, query).collect()} == scan(spark, rows, query, "literal")


@pytest.mark.parametrize("query", ["gard(en|ener) the", "(garden|harbour) bed", "g.rden", "^garden$", r"\bbed\b", "(bed|x)", "war+den", "(ward)?en", "(ab){2}", "[gw]arden", r"note-\d\]", "qui(x|z)otic", "(?:quixotic)+", "é", "(?s)a.b", "gar.*our", r"\Qa.b\E", "[[g]]arden", "quix(?=otic)", "(?!bed)garden"])
def test_expressions(spark, indexed, query):
    rows, path = indexed
    assert {tuple(r) for r in trigrams.search(spark, path, query, "regex").collect()} == scan(spark, rows, query, "regex")


def test_what_is_needed():
    assert trigrams.required("Abcd") == [{"abc", "bcd"}] and trigrams.required("ab") is None
    assert trigrams.required("abc(def|ghi)x*", "regex") == [{"abc", "def"}, {"abc", "ghi"}] and trigrams.required("abc|d", "regex") is None
    assert trigrams.required("(abc)?d", "regex") is None and trigrams.required("(abc){2,}d", "regex") == [{"abc"}] and trigrams.required("(", "regex") is None
    assert trigrams.required(".".join(f"(a{i}b|c{i}d)" for i in range(9)), "regex") is not None


def test_every_match_has_what_is_needed():
    rng = random.Random(2)

    def made(depth=0):
        kind = rng.randint(0, 8 if depth < 3 else 2)
        if kind <= 2:
            return rng.choice(["abc", "abcd", "x", "yz", "ABCDE", ".", r"\d", "[ab]", "^", r"\b"])
        if kind == 3:
            return f"({made(depth + 1)}|{made(depth + 1)})"
        if kind == 4:
            return f"(?:{made(depth + 1)}){rng.choice(['*', '+', '?', '{2}', '{0,2}', '+?'])}"
        return made(depth + 1) + made(depth + 1)

    used = 0
    for _ in range(3000):
        pattern = made()
        needed = trigrams.required(pattern, "regex")
        if needed is None:
            continue
        used += 1
        for _ in range(20):
            line = "".join(rng.choice(["abc", "abcd", "x", "yz", "abcde", "1", " ", "a", "b"]) for _ in range(rng.randint(1, 8)))
            low = line.lower()
            if re.search(pattern, line, re.I):
                assert any(all(t in low for t in one) for one in needed), (pattern, line)
    assert used > 500


def test_a_search_reads_a_small_share(spark, tmp_path):
    rows = [("c", f"n{f}.md", ".", 1, f"line {f} " + "word%d " % (f % 97) * 30) for f in range(20_000)]
    path = str(tmp_path / "index")
    lines = frame(spark, rows).repartition(8)
    trigrams.write_index(lines, path)
    needed = trigrams.required("line 1234 word")
    assert trigrams.candidates(spark, path, needed).count() < 20
    assert [r["rel"] for r in trigrams.search(spark, path, "line 1234 word").collect()] == ["n1234.md"]
    plan = trigrams.search(spark, path, "line 1234 word")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(block" in plan or "EqualTo(block" in plan


def test_batches_are_added_and_replace_files(spark, tmp_path):
    path = str(tmp_path / "index")
    trigrams.write_index(frame(spark, [("c", "a.md", ".", 1, "first garden"), ("c", "b.md", ".", 1, "garden b"), ("d", "a.md", ".", 1, "garden d")]), path, 0)
    trigrams.write_index(frame(spark, [("c", "a.md", ".", 1, "second text"), ("c", "n.md", ".", 4, "new garden")]), path, 1)
    found = lambda q: sorted((r["corpus"], r["rel"], r["line_no"]) for r in trigrams.search(spark, path, q).collect())
    assert found("garden") == [("c", "b.md", 1), ("c", "n.md", 4), ("d", "a.md", 1)] and found("second") == [("c", "a.md", 1)] and found("first") == []
    trigrams.write_index(frame(spark, [("c", "n.md", ".", 4, "again")]), path, 1)
    # the batch, written again without a.md and with another n.md, has replaced itself
    assert found("garden") == [("c", "a.md", 1), ("c", "b.md", 1), ("d", "a.md", 1)]


@pytest.mark.parametrize("pairs", [1 << 20, 40])
def test_bitmaps_of_whole_blocks(monkeypatch, pairs):
    """A task's bitmaps hold every trigram of every block once, in pieces of whole blocks, however lines are cut."""
    import pyarrow as pa

    monkeypatch.setattr(trigrams, "PAIRS", pairs)
    monkeypatch.setattr(trigrams, "CHARS", 16)
    monkeypatch.setattr(trigrams, "MADE", 3)
    rng = random.Random(pairs)
    rows = sorted((rng.choice([1, 2, 7, 4096, 4097, 9000]), "".join(rng.choices("ab \n𝄞é", k=rng.choice([0, 2, 3, 9, 60])))) for _ in range(60))
    batches = [pa.RecordBatch.from_pylist([{"block": b, "low": t} for b, t in rows[i : i + 7]], schema=pa.schema([("block", pa.int32()), ("low", pa.string())])) for i in range(0, len(rows), 7)]
    found = [r for out in trigrams._bitmaps(iter(batches)) for r in out.to_pylist()]
    had, where = set(), {}
    for r in found:
        bits = int.from_bytes(r["blocks"], "little")
        for at in (i for i in range(trigrams.SEGMENT) if bits >> i & 1):
            block = r["segment"] * trigrams.SEGMENT + at + 1
            assert (block, r["tri"]) not in had and where.setdefault(block, r["piece"]) == r["piece"]
            had.add((block, r["tri"]))
    assert had == {(b, t[i : i + 3]) for b, t in rows for i in range(len(t) - 2)}
    assert (max(r["piece"] for r in found) > 0) == (pairs == 40)


def test_no_pair_of_a_block_and_a_trigram_is_shuffled(spark, tmp_path):
    """The postings' shuffle has a bitmap for a trigram and a segment."""
    rng, path = random.Random(3), str(tmp_path / "index")
    lines = frame(spark, [("c", f"n{f}.md", ".", 1, " ".join(rng.choices(WORDS, k=40))) for f in range(5000)])
    trigrams.write_index(lines, path)
    postings = spark.read.parquet(f"{path}/postings")
    assert postings.groupBy("tri", "segment", "piece").count().filter("count > 1").isEmpty()
    assert postings.count() < 1000 and {r["segment"] for r in postings.select("segment").distinct().collect()} == {0, 1}
    blocks = spark.read.parquet(f"{path}/lines").select("block").distinct()
    assert (blocks.count(), blocks.agg(F.max("block")).first()[0]) == (5000, 5000)
