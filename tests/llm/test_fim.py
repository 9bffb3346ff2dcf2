import hashlib
import random
import re

from marginalia.llm.fim import UNIT, fill_in_middle, fill_in_middle_digests, restored
from marginalia.llm.queries import op11_fill_in_middle


def plain_python(doc_id, text, seed=42):
    """(n, form, prefix length, middle length, output) by hand."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, sf):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_fill_in_middle(spark, sf).collect()
    assert len(rows) == len(source) and {r["form"] for r in rows} == {"plain", "spm", "psm"}
    for r in rows:
        n, form, prefix, middle, output = plain_python(r["doc_id"], source[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, prefix, middle, hexed(output))
        assert r["restored_sha256"] == hexed(source[r["doc_id"]] or "")


def test_hostile_texts(spark):
    rng = random.Random(11)
    pieces = ["<", ">", "P", "S", "M", "<P", "S>", "<M", "<P>", " ", "\t", "\n", "\x0b", "\x00", "\xa0", " ", "é", "𝄞", "ab", "'", "\\x20"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    rows = list(enumerate(texts))
    formed = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).cache()
    seen = {r["doc_id"]: r for r in formed.collect()}
    for i, text in rows:
        r = seen[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_python(i, text), (i, text)
    assert {r["doc_id"]: r["text"] for r in restored(formed).collect()} == dict(rows)
    assert {r["form"] for r in seen.values()} == {"plain", "spm", "psm"}


def test_every_rate(spark):
    rows = [(i, f"one two {i} three") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["form"] for r in fill_in_middle(df, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r["form"] for r in fill_in_middle(df, rate=100, spm_rate=100).collect()} == {"spm"}
    assert {r["form"] for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert sorted(r["output"] for r in fill_in_middle(df, seed=7).collect()) == sorted(plain_python(i, t, 7)[-1] for i, t in rows)


def test_odd_rows(spark, odd, empty):
    rows = fill_in_middle_digests(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        n, form, prefix, middle, output = plain_python(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) == (n, form, prefix, middle, hexed(output))
    assert fill_in_middle(empty).count() == 0 and fill_in_middle_digests(empty).count() == 0
    long = spark.createDataFrame([(4, "word " * 1_000_000), (6, "x" * 5_000_000), (8, " " * 5_000_000)], "doc_id long, text string")
    for r in fill_in_middle_digests(long).collect():
        assert (r["n"], r["restored_sha256"]) == {4: (1_000_001, hexed("word " * 1_000_000)), 6: (1, hexed("x" * 5_000_000)), 8: (1, hexed(" " * 5_000_000))}[r["doc_id"]]


def test_unit_is_the_published_pattern():
    assert UNIT == r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
