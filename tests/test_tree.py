"""Writing, listing and streaming trees of files."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from marginalia.sources import markdown, sinks
from marginalia.sources.markdown import CorpusSource, read_corpus, stream_corpus


def all_files(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def files_of(spark, rows, parts=5):
    return spark.createDataFrame(rows, "rel string, content string").repartition(parts)


def test_round_trip_by_tasks(spark, tmp_path):
    rows = [(f"d{i % 7}/e{i % 3}/n{i}.md", f"text {i} é\n") for i in range(500)] + [("_MANIFEST.md", "m"), ("empty.md", ""), ("null.md", None)]
    sinks.write_texts(files_of(spark, rows), str(tmp_path / "out"))
    assert all_files(tmp_path / "out") == sorted(r for r, c in rows if c is not None)
    for listed in (1, 4, 1000):  # folders below the first are listed by tasks
        back = read_corpus(spark, str(tmp_path / "out"), listed=listed)
        assert {(r["rel"], r["content"]) for r in back.collect()} == {r for r in rows if r[1] is not None} and back.count() == 502
    assert read_corpus(spark, str(tmp_path / "out"), listed=1, skip=("d1", "d2/e0")).filter("rel like 'd1/%' or rel like 'd2/e0/%'").count() == 0
    tree = markdown._Tree({"path": str(tmp_path / "out"), "listed": "1"})
    assert [p.rels for p in tree.parts()][0] == ["_MANIFEST.md", "empty.md"] and [p.folders for p in tree.parts()[1:]] == [[f"d{i}"] for i in range(7)]


def test_append_replaces_and_overwrite_clears(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_texts(files_of(spark, [("a.md", "1"), ("b/c.md", "2")]), out)
    sinks.write_texts(files_of(spark, [("a.md", "3"), ("d.md", "4")]), out)
    assert {(r["rel"], r["content"]) for r in read_corpus(spark, out).collect()} == {("a.md", "3"), ("b/c.md", "2"), ("d.md", "4")}
    sinks.write_texts(files_of(spark, [("e.md", "5")]), out, overwrite=True)
    assert all_files(out) == ["e.md"]
    with pytest.raises(ValueError, match="given 2 times"):
        sinks.write_texts(files_of(spark, [("e.md", "5"), ("e.md", "6")]), out)
    assert all_files(out) == ["e.md"]


@pytest.mark.parametrize("bad", ["../up.md", "/root.md", "a//b.md", "", "a/./b.md"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    out = tmp_path / "out"
    sinks.write_texts(files_of(spark, [("a.md", "old")]), str(out))
    rows = [("a.md", "new"), *[(f"n{i}.md", "x") for i in range(40)], (bad, "y")]
    with pytest.raises(Exception, match="no path inside a tree"):
        sinks.write_texts(files_of(spark, rows), str(out))
    assert all_files(out) == ["a.md"] and (out / "a.md").read_text() == "old"


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A killed attempt and one that was repeated, by the writer's own methods."""
    writer = markdown._Writer({"path": str(tmp_path)}, False, ["rel", "content"])

    def broken():
        yield {"rel": "killed.md", "content": "x"}
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(broken())
    twice = [writer.write(iter([{"rel": "a.md", "content": str(i)}, {"rel": f"only{i}.md", "content": ""}])) for i in range(2)]
    assert read_names(tmp_path) == []  # nothing is in its place before all are done
    writer.commit([twice[1], None])
    assert all_files(tmp_path) == ["a.md", "only1.md"] and (tmp_path / "a.md").read_text() == "1"


def read_names(root):
    return [f for f in all_files(root) if not f.startswith(markdown.WRITING)]


def test_catalog_files_come_last(tmp_path, monkeypatch):
    writer = markdown._Writer({"path": str(tmp_path)}, False, ["rel", "content"])
    message = writer.write(iter([{"rel": r, "content": r} for r in ("_MANIFEST.md", "x/_MANIFEST.md", "b.md", "a.md")]))
    moved, system = [], markdown.fs.LocalFileSystem()

    class Watched:
        def __getattr__(self, name):
            return getattr(system, name)

        def move(self, a, b):
            moved.append(os.path.relpath(b, tmp_path))
            system.move(a, b)

    monkeypatch.setattr(markdown, "opened", lambda path: (Watched(), str(tmp_path)))
    writer.commit([message])
    assert set(moved[:2]) == {"a.md", "b.md"} and set(moved[2:]) == {"_MANIFEST.md", "x/_MANIFEST.md"}


def test_readers_see_old_files_while_new_ones_are_written(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_texts(files_of(spark, [(f"n{i}.md", "old") for i in range(50)]), out)
    seen, stop = set(), threading.Event()

    def watch():
        while not stop.is_set():
            seen.add(len([f for f in os.listdir(out) if not f.startswith(".")]))

    watcher = threading.Thread(target=watch)
    watcher.start()
    sinks.write_texts(files_of(spark, [(f"n{i}.md", "new") for i in range(50)]), out)
    stop.set()
    watcher.join()
    assert seen == {50} and read_corpus(spark, out).filter("content = 'new'").count() == 50


def test_stream_reads_only_what_was_touched(spark, tmp_path):
    tree, got = tmp_path / "tree", []
    tree.mkdir()
    (tree / "a").mkdir()
    for i in range(6):
        (tree / "a" / f"n{i}.md").write_text(f"first {i}")

    def trigger():
        rows = []
        query = stream_corpus(spark, str(tree), settle=0).writeStream.foreachBatch(lambda df, n: rows.extend((r["rel"], r["content"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(sorted(rows))

    trigger()
    time.sleep(0.05)
    (tree / "a" / "n3.md").write_text("second 3")
    (tree / "b").mkdir()
    (tree / "b" / "_new.md").write_text("new")
    (tree / ".git").mkdir()
    (tree / ".git" / "x.md").write_text("hidden")
    trigger()
    trigger()
    assert got == [[(f"a/n{i}.md", f"first {i}") for i in range(6)], [("a/n3.md", "second 3"), ("b/_new.md", "new")], []]


def test_replay_of_an_offset_gives_the_same_rows(tmp_path):
    for i, at in enumerate((100, 200, 200, 300)):
        (tmp_path / f"n{i}.md").write_text(str(i))
        os.utime(tmp_path / f"n{i}.md", (at, at))
    reader = markdown._StreamReader({"path": str(tmp_path), "listed": "1"})

    def rows(a, b):
        return sorted(r[1] for p in reader.partitions({"mtime": a}, {"mtime": b}) for r in reader.read(p))

    assert rows(0.0, 150.0) == ["n0.md"] and rows(150.0, 200.0) == ["n1.md", "n2.md"] == rows(150.0, 200.0) and rows(200.0, 300.0) == ["n3.md"]
    assert reader.initialOffset() == {"mtime": 0.0} and reader.latestOffset()["mtime"] <= time.time() - 2


def test_whole_vault_is_written(spark):
    from marginalia.catalog.upkeep import workspace_files
    from marginalia.catalog.vault import vault
    from marginalia.session import configured

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    made = vault(configured(spark), sf).filter(~F.col("rel").startswith("src1/"))
    assert workspace_files(spark, sf).count() == made.count() > 100
    assert isinstance(CorpusSource.name(), str)


def test_files_in_pieces(spark, tmp_path):
    """A file of more pieces than a task's batch, beside small ones; pieces are in order whatever their order was."""
    pieces = [("long.md", i, f"line {i}") for i in range(30_000)] + [("a/b.md", 2, "second"), ("a/b.md", 1, "first"), ("a/c.md", 1, ""), ("a/c.md", 2, "x"), ("n.md", 1, None)]
    frame = spark.createDataFrame(pieces, "rel string, at int, content string").repartition(6)
    sinks.write_pieces(frame, str(tmp_path / "out"), "at")
    assert all_files(tmp_path / "out") == ["a/b.md", "a/c.md", "long.md"]
    assert (tmp_path / "out/long.md").read_text() == "\n".join(f"line {i}" for i in range(30_000))
    assert (tmp_path / "out/a/b.md").read_text() == "first\nsecond" and (tmp_path / "out/a/c.md").read_text() == "\nx"


def test_registry_in_pieces_reads_back(spark, tmp_path):
    rows = [("b", "/srv/b", "2026-01-01", True), ("a", "/srv/a", "", False)]
    registry = spark.createDataFrame(rows, "name string, path string, registered string, searchable boolean")
    sinks.write_pieces(sinks.registry_pieces(registry), str(tmp_path / "out"), "name", between="\n\n")
    assert (tmp_path / "out/sources.md").read_text() + "\n" == sinks.registry_text(registry).first()["content"]
