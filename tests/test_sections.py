"""Files of sections read by byte ranges, against the whole file."""

import random

import pytest

from marginalia.sources import parsers, sections
from marginalia.sources.markdown import read_corpus

LINES = ["## a", "## name-1", "##\tb ", "## two words", "### c", "##", "- path: /srv/x", "- Path : y z", "- searchable: no", "- registered: 2026-01-01", "é 𝄞", "", "text ## a", " ## a", "## é"]


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\r"])
def test_pieces_make_up_the_file(tmp_path, sep):
    """Every byte is in one piece, and all pieces but a file's first begin with a heading, wherever ranges are cut."""
    rng = random.Random(sep)
    for turn in range(150):
        text, size, piece = sep.join(rng.choices(LINES, k=rng.randint(1, 25))), rng.randint(1, 60), rng.choice([1, 30, 1000])
        path = tmp_path / f"{turn}.md"
        path.write_bytes(text.encode())
        length = len(text.encode())
        found = [r for start in range(0, length, size) for b in sections._pieces(str(path), start, min(size, length - start), piece) for r in b.to_pylist()]
        assert [r["start"] for r in found] == sorted({r["start"] for r in found})
        assert "".join(r["content"] for r in found) == text.replace("\r\n", "\n").replace("\r", "\n")
        assert all(sections.HEAD.match(r["content"].encode() + b"\n") for r in found[1:])


def test_registry_by_sections(spark, tmp_path):
    rng = random.Random(4)
    texts = {"one.md": "\n".join(rng.choices(LINES, k=400)), "two.md": "# Sources\n\n## only", "three.md": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "broken.md").write_bytes(b"## x\n- path: /x\n" * 50 + b"## y\n\xff")
    whole = parsers.registry(read_corpus(spark, str(tmp_path))).drop("at")
    pieces = sections.read_sections(spark, str(tmp_path), range_bytes=64, piece_bytes=32)
    assert pieces.count() > 10
    assert sorted(map(tuple, parsers.registry(pieces).drop("at").collect())) == sorted(map(tuple, whole.collect()))
    order = [[r["name"] for r in parsers.registry(f).orderBy("at").collect()] for f in (read_corpus(spark, str(tmp_path)).filter("rel = 'one.md'"), pieces.filter("rel like '%one.md'"))]
    assert order[0] == order[1]


def test_a_long_registry_is_many_rows(spark, tmp_path):
    """No row has the whole file, so no task has either."""
    (tmp_path / "sources.md").write_text("# Sources" + "".join(f"\n\n## n{i}\n- path: /srv/{i}" for i in range(40_000)))
    pieces = sections.read_sections(spark, str(tmp_path), range_bytes=1 << 18)
    assert pieces.selectExpr("max(length(content))").first()[0] < 1 << 17
    assert parsers.registry(pieces).count() == 40_000
