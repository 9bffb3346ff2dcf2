"""The kept facet index over many batches, and over a tree."""

import os
import random
import time
from datetime import datetime, timedelta

from marginalia.sources.markdown import stream_corpus
from marginalia.streaming import refresh


def folders(path):
    return sum(len(dirs) for _, dirs, _ in os.walk(path))


def test_many_batches(spark, tmp_path):
    rng, newest, target, counts = random.Random(6), {}, str(tmp_path / "out"), []
    names = ["plain", "with space", "a/b", "é=1"]
    for number in range(23):
        rows = [(rng.choice(names), f"s{rng.randrange(4)}", datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(10_000)), f"{number}-{i}") for i in range(3)]
        batch = spark.createDataFrame(rows, refresh.SCHEMA)
        refresh.refresh_batch(batch, number, target, compact=4)
        if number % 3 == 0:
            refresh.refresh_batch(batch, number, target, compact=4)  # a repeated batch changes nothing
        for c, s, at, text in rows:
            if (c, s) not in newest or at > newest[c, s][0]:
                newest[c, s] = (at, text)
        counts.append((len(os.listdir(f"{target}/heads")), folders(f"{target}/state")))
        if number % 5 == 4 or number == 22:
            found = {(r["collection"], r["stem"]): (r["mtime"], r["content"]) for r in refresh.current_index(spark, target).collect()}
            assert {k: v[1] for k, v in found.items()} == {k: v[1] for k, v in newest.items()}
    # notes since the last manifest; of four collections and the batches since then a folder for each batch and what it touched
    assert max(c[0] for c in counts) <= 4 + 1 and max(c[1] for c in counts) <= 2 * 4 + 5 * (1 + 3)


def test_a_tree_keeps_its_index(spark, tmp_path):
    tree = tmp_path / "tree"
    for folder in ("a", "b"):
        (tree / folder).mkdir(parents=True)
        for i in range(3):
            (tree / folder / f"n{i}.md").write_text(f"first {folder}{i}")

    def trigger():
        rows = refresh.versions(stream_corpus(spark, str(tree), suffix=".md", settle=0))
        refresh.stream_refresh(spark, rows, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return {(r["collection"], r["stem"]): r["content"] for r in refresh.current_index(spark, str(tmp_path / "out")).collect()}

    want = {(f, f"n{i}"): f"first {f}{i}" for f in "ab" for i in range(3)}
    assert trigger() == want
    time.sleep(0.05)
    (tree / "b" / "n1.md").write_text("second")
    assert trigger() == want | {("b", "n1"): "second"} == trigger()
    assert len([d for d in os.listdir(tmp_path / "out" / "state") if os.path.isdir(tmp_path / "out" / "state" / d / "collection=a")]) == 1
