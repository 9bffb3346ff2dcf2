"""The tree reader, parsers and writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph, links, search
from marginalia.sources import parsers, sinks
from marginalia.sources import markdown as md
from marginalia.sources.markdown import index_files, markdown, read_corpus


def tree(root, files):
    for rel, text in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_hidden_files_are_read_and_hidden_folders_are_not(spark, tmp_path):
    path = tree(tmp_path, {"_MANIFEST.md": "m", "a/_CLOSETS.md": "c", "a/.graph.md": "g", ".git/x.md": "no", "b/v1.2.3.md": "v", "b/.hidden": "h", "bad.md": b"\xff\xfe\xff"})
    rows = {r["rel"]: r for r in read_corpus(spark, path).collect()}
    assert set(rows) == {"_MANIFEST.md", "a/_CLOSETS.md", "a/.graph.md", "b/v1.2.3.md", "b/.hidden", "bad.md"}
    assert rows["bad.md"]["content"] is None and rows["b/v1.2.3.md"]["stem"] == "v1.2.3" and rows["b/.hidden"]["stem"] == ".hidden"
    assert rows["b/v1.2.3.md"]["ext"] == ".md" and rows["_MANIFEST.md"]["folder"] == "." and rows["_MANIFEST.md"]["mtime"] is not None
    assert {r["rel"] for r in index_files(read_corpus(spark, path)).collect()} == {"_MANIFEST.md", "a/_CLOSETS.md"}
    assert read_corpus(spark, path, skip=("a",), suffix=".md").count() == 3


def test_empty_tree(spark, tmp_path):
    assert read_corpus(spark, str(tmp_path)).count() == 0


def test_links_resolve_by_stem_or_path(spark, tmp_path):
    path = tree(tmp_path, {"a.md": "[[b]] [[B.MD]] [[v1.2.3-x]] [[nowhere/b]] [[c/d]] [[c/e.txt]] [[gone]] [[c/gone|t]]\n````\n[[in code]]\n````\n`[[x]]`", "b.md": "", "v1.2.3-x.md": "", "c/d.md": "", "c/e.txt": ""})
    files = read_corpus(spark, path)
    assert sorted(r["target"] for r in links.broken_links(files).collect()) == ["c/gone", "gone"]
    assert links.link_totals(files).first()["exit_status"] == 1


def test_mentions(spark, tmp_path):
    text = "---\nx: campaign plan\n---\nThe Campaign Plan and campaign-plan; replan; [[campaign-plan]] https://x.y/campaign-plan\n<!-- campaign plan -->\nab ab"
    path = tree(tmp_path, {"n.md": text, "campaign-plan.md": "campaign plan", "ab.md": "", "plan.md": ""})
    rows = {(r["rel"], r["stem"]): r for r in links.mentions(read_corpus(spark, path)).collect()}
    # names of two letters are left out, a file doesn't name itself, one row a line and name
    assert set(rows) == {("n.md", "campaign-plan"), ("n.md", "plan"), ("campaign-plan.md", "plan")}
    assert rows["n.md", "campaign-plan"]["text"] == "campaign-plan"
    assert (rows["n.md", "campaign-plan"]["line_no"], rows["n.md", "campaign-plan"]["original_line_no"]) == (2, 4)


def test_front_matter_traps(spark, tmp_path):
    path = tree(tmp_path, {"a.md": "---\nType: 'x\"\nstatus: \"\ntype: y\n# no: no\npeople: [[p|q]], [[r]] other\nplain\n---\n", "b.md": "---\ntags: z\n---", "c.md": "text", "d.md": "---\nno end"})
    files = read_corpus(spark, path)
    nodes = {r["stem"]: r for r in graph.nodes(files).collect()}
    assert set(nodes) == {"a", "b"} and nodes["a"]["type"] == "y" and nodes["a"]["status"] == "" and nodes["b"]["type"] == "other"
    assert [r["target"] for r in graph.dangling(graph.edges(files), files).orderBy("target").collect()] == ["p", "r"]
    assert markdown(files).count() == 4


def test_registry_edit_and_text(spark):
    r = spark.createDataFrame([("a", "/a", "2026-01-01", True)], "name string, path string, registered string, searchable boolean")
    r = search.add_source(r, "b", "/b", "2026-01-02")
    for bad in ("a", "two words", ""):
        try:
            search.add_source(r, bad, "/c", "2026-01-02")
            raise AssertionError(bad)
        except ValueError:
            pass
    text = sinks.registry_text(search.set_searchable(r, "b", False)).first()["content"]
    again = parsers.registry(spark.createDataFrame([("r", text)], "rel string, content string"))
    assert [(x["name"], x["searchable"]) for x in again.orderBy("at").collect()] == [("a", True), ("b", False)]


def test_search_is_literal_by_default(spark, tmp_path):
    path = tree(tmp_path, {"_MANIFEST.md": "a.c\nabc\nA.C", "x.md": "a.c"})
    files = read_corpus(spark, path)
    assert search.hit_lines(files, "a.c").count() == 2 and search.hit_lines(files, "a.c", "regex").count() == 3


def test_questions_json_and_lines(spark, tmp_path):
    rows = [{"question_id": "q1", "question_type": "t", "question": "?", "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]], "answer_session_ids": ["s1"]}, {"question_id": "q2", "question_type": "t", "question": "?", "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "again"}]], "answer_session_ids": []}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array.json", "lines.json"):
        found = parsers.questions(spark, str(tmp_path / name))
        assert found.count() == 2
        assert {(r["session_id"], r["text"]) for r in parsers.candidate_turns(found).collect()} == {("s1", "a"), ("s2", "b")}
    assert parsers.cache(spark, str(tmp_path / "absent")).count() == 0


def test_writers(spark, tmp_path):
    files = spark.createDataFrame([("_MANIFEST.md", "m"), ("a/_CLOSETS.md", "c")], "rel string, content string")
    sinks.write_texts(files, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["_MANIFEST.md", "a"]
    sinks.write_cache(spark.createDataFrame([("s", "t")], "session_id string, text string"), str(tmp_path / "cache"))
    sinks.write_results(spark.createDataFrame([("x", 1)], "strategy string, v int"), str(tmp_path / "res"))
    assert parsers.cache(spark, str(tmp_path / "cache")).count() == 1
    assert spark.read.parquet(str(tmp_path / "res")).filter(F.col("strategy") == "x").count() == 1


def test_a_cache_is_filled_in_steps_and_resumed(spark, tmp_path):
    path, work = str(tmp_path / "cache"), spark.createDataFrame([(f"s{i % 30}", i) for i in range(60)], "session_id string, n int")
    calls = []

    def extract(rows):
        if len(calls) == 2:
            raise InterruptedError
        calls.append(rows.count())
        return rows.groupBy("session_id").agg(F.sum("n").cast("string").alias("text"))

    with pytest.raises(InterruptedError):
        sinks.fill_cache(work, path, extract, every=6)
    kept = parsers.cache(spark, path).count()
    assert 0 < kept < 30 and 2 * kept == sum(calls)
    calls[:] = [0] * 9
    steps = sinks.fill_cache(work, path, extract, every=6)
    assert steps == -(-(30 - kept) // 6) and sum(calls) == 60 - 2 * kept
    assert {(r["session_id"], r["text"]) for r in parsers.cache(spark, path).collect()} == {(f"s{i}", str(2 * i + 30)) for i in range(30)}
    assert sinks.fill_cache(work, path, extract, every=6) == 0


def test_long_files_are_passed_on_one_by_one(monkeypatch):
    monkeypatch.setattr(md, "READ_CHARS", 10)
    rows = [("c", f"{i}.md", text, None) for i, text in enumerate(("a" * 4, None, "b" * 5, "c" * 30, "d"))]
    got = list(md._batched(iter(rows)))
    assert [b.num_rows for b in got] == [3, 1, 1]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == rows
