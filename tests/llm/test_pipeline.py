import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.staged(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] > kept[3] > 0
    out = pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == kept[4] and pipeline.run(spark, sf).count() == kept[4]


def test_odd_rows(spark, sf, odd, empty):
    for frame in (odd, empty):
        docs = frame
        for name, stage in pipeline.STAGES:
            docs = pipeline.staged(stage(spark, docs, sf), f"odd-{name}")
            assert docs.columns == odd.columns or name == "token_output"
        assert (docs.count() > 0) == (frame is odd)


def test_stages_against_brute_force(spark, sf, tmp_path):
    """What each stage keeps of its own input, by plain Python, on short documents with planted copies and passages."""
    from test_decontamination import brute as overlapping
    from test_jaccard import brute as grouped
    from test_language import brute_model
    from test_mixing import by_hand

    source = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 70 and length(text) between 1 and 2500").collect()]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [r[:4] + (len(r[1]),) for r in source]
    near = rows[3][1].split(" ")
    near[len(near) // 2] = "changed"
    rows += [(1000, rows[3][1], "en", "s", 1), (1001, " ".join(near), "en", "s", 1), (1002, f"{rows[5][1]} {benchmark[0][1]} end", "en", None, 1), (1003, "12 34", "en", "s", 1), (1004, None, None, "s", 1), (1005, "", "en", None, 1)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    step, folder = dict(pipeline.STAGES), str(tmp_path)

    def run(name, frame):
        out = pipeline.staged(step[name](spark, frame, folder), f"brute-{name}")
        return out, [tuple(r) for r in out.collect()]

    judged = brute_model([(r[1], r[2]) for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2])
    found, kept = run("language_id", docs)
    verdict = {r[0]: judged(r[1]) for r in rows}
    assert sorted(kept) == sorted(r for r in rows if verdict[r[0]][0] != "und" and verdict[r[0]][1] >= pipeline.LEAST_SCORE)

    groups = grouped([(r[0], r[1]) for r in kept], 5, 80)
    want = sorted(r for r in kept if groups[r[0]][1] == r[0])
    found, after = run("near_duplicates", found)
    assert sorted(after) == want and {1000, 1001} & {r[0] for r in kept} and not {1000, 1001} & {r[0] for r in after}

    dirty = {i for i, _ in overlapping([(r[0], r[1]) for r in after], benchmark)}
    found, clean = run("decontamination", found)
    assert sorted(clean) == sorted(r for r in after if r[0] not in dirty) and 1002 in dirty

    copies = by_hand([(r[0], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1])), 1.0) for r in clean], 1.5)
    found, mixed = run("mixing", found)
    assert Counter(r[0] for r in mixed) == Counter({k: n for k, n in copies.items() if n})

    tokenizer = Tokenizer.from_file(pipeline.public_tokenizer("byte_bpe_50k.json"))
    written = sorted(step["token_output"](spark, found, folder).collect(), key=lambda r: r["start"])
    at, texts = 0, {r[0]: r[1] for r in mixed}
    assert [r["doc_id"] for r in written] == sorted(r[0] for r in mixed)
    for r in written:
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
