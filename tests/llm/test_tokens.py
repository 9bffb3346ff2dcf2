import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import tokens
from marginalia.llm.queries import op9_token_output, public_tokenizer, read_tokens

PATH = public_tokenizer("byte_bpe_50k.json")


def plain(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_words_equal_whole_texts():
    rng = random.Random(1)
    bits = ["'s", "'re", " ", "  ", "\n", "a", "é", "B", "1", "!", "'", "''s", "…", "ب", "\t", "<|endoftext|>", "ß", "Ω", "!'s", "'ll", " 'd", "\xa0", "-", "%%%", "²", "ǃ", "ʼ"]
    whole, coder = Tokenizer.from_file(PATH), tokens.encoder(PATH)
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    coder = tokens.WordEncoder(PATH)
    for text in ("a b c d e", "a z y", "b c w v", "a b c"):
        assert np.frombuffer(coder.encode(text), coder.kind).tolist() == plain(text)
        assert len(coder.cache) <= 3 + 6


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in op9_token_output(spark, sf).collect()}
    start = 0
    whole = Tokenizer.from_file(PATH)
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        got = rows.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_random_access_and_checksums(tmp_path):
    path = str(tmp_path / "x.mgtk")
    writer = tokens.FrameWriter(path, 2)
    for k in range(50):
        writer.add(k if k else None, np.full(k, k, "<u2").tobytes())
    writer.close()
    reader = tokens.FrameReader(path)
    assert reader.doc_ids[:3] == [None, 1, 2] and {k: len(v) for k, v in reader.documents([7, 30])} == {7: 7, 30: 30}
    data = bytearray(open(path, "rb").read())
    data[int(reader.starts[30]) + 8] ^= 0xFF
    open(path, "wb").write(bytes(data))
    broken = tokens.FrameReader(path)
    assert len(broken.frame(29)) == 29
    with pytest.raises(Exception):
        broken.frame(30)


def test_frames_are_a_plain_zstandard_stream(tmp_path):
    import zstandard

    path = str(tmp_path / "y.mgtk")
    writer = tokens.FrameWriter(path, 4)
    for k in (3, 0, 5):
        writer.add(k, np.arange(k, dtype="<u4").tobytes())
    writer.close()
    with open(path, "rb") as file:
        data = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert np.frombuffer(data, "<u4").tolist() == [0, 1, 2, 0, 1, 2, 3, 4]


def test_odd_rows(odd, empty):
    rows = read_tokens(tokens.write_tokens(odd, PATH)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7, 8, 9] and rows[1]["n_tokens"] == 1
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:]))
    assert read_tokens(tokens.write_tokens(empty, PATH)).count() == 0
