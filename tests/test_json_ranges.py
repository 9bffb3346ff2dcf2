"""JSON arrays and lines by byte ranges, against the standard library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.sources import json_ranges, parsers
from marginalia.sources.json_ranges import json_values, structure


def by_hand(data: bytes, state: int):
    """Byte by byte."""
    out, ends = [], state
    for i, b in enumerate(data):
        c = chr(b)
        if ends == 2:
            ends = 1
        elif ends == 1:
            ends = 2 if c == "\\" else 0 if c == '"' else 1
        elif c == '"':
            ends = 1
        elif c in "[]{},\n":
            out.append((i, {"[": 1, "{": 1, "]": -1, "}": -1}.get(c, 0)))
    return out, ends


def test_structure_from_every_state():
    rng = random.Random(1)
    for _ in range(4000):
        inside = "".join(rng.choice(['a', '\\\\', '\\"', '[', '}', ',', "é"]) for _ in range(rng.randint(0, 6)))
        data = "".join(rng.choice(['"' + inside + '"', "[", "]", "{", "}", ",", "\n", " ", "1", '\\', '"']) for _ in range(rng.randint(0, 9))).encode()
        for cut in (0, rng.randint(0, len(data))):
            for state in range(3):
                if b"\\" in data and by_hand(data, state)[1] == 0 and outside_slash(data, state):
                    continue  # no JSON has a backslash outside strings
                at, deeper, ends = structure(data[cut:], state)
                want, after = by_hand(data[cut:], state)
                if not outside_slash(data[cut:], state):
                    assert (list(zip(at.tolist(), deeper.tolist())), ends) == (want, after), (data[cut:], state)


def outside_slash(data, state):
    for i in range(len(data)):
        if data[i : i + 1] == b"\\" and by_hand(data[:i], state)[1] == 0:
            return True
    return False


def random_value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return rng.choice(["", "plain", 'quote " and \\', "],[", "}{", "\\\\", "\\\"", "line\nbreak", "é𝄞", "[" * 40, 3, -2.5, True, None, "x" * rng.randint(0, 90)])
    if kind < 0.7:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f"k{i}{rng.choice(['', '}', ',', ':'])}": random_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("style", ["one line", "indented", "spaced", "lines", "plain utf-8"])
def test_ranges_of_every_size(spark, tmp_path, style):
    rng = random.Random(style)
    values = [{"i": i, "v": random_value(rng)} for i in range(120)]
    text = {"one line": json.dumps(values), "indented": json.dumps(values, indent=3), "spaced": "\n  " + json.dumps(values, separators=(" ,\n", " : ")) + "\n\n", "lines": "\n".join(json.dumps(v) for v in values), "plain utf-8": json.dumps(values, ensure_ascii=False)}[style]
    path = tmp_path / "data.json"
    path.write_text(text)
    for size in (61, 1000, 1 << 20):
        rows = json_values(spark, str(path), range_bytes=size).orderBy("start").collect()
        assert [json.loads(r["value"]) for r in rows] == values


def test_every_border_falls_everywhere(tmp_path):
    """All range sizes over one text, with the task functions alone."""
    import pyarrow as pa

    path = tmp_path / "a.json"
    values = [{"a": "\\\" ],[ {\\"}, [[], {}, "x"], "\\\\", {}, "é", 5]
    for text in (json.dumps(values), json.dumps(values, ensure_ascii=False, indent=1), "\n".join(map(json.dumps, values)), " [ ] ", "[]", "  \n"):
        path.write_text(text)
        n = len(text.encode())
        for size in range(1, n + 1):
            ranges = pa.RecordBatch.from_pylist([{"file": str(path), "start": s, "size": min(size, n - s)} for s in range(0, n, size)])
            summaries = pa.Table.from_batches(json_ranges._summaries(iter([ranges]))).combine_chunks().to_batches()
            rows = summaries[0].to_pylist()
            first = next((r["first"] for r in rows if r["first"]), None)
            summaries = [pa.RecordBatch.from_pylist([r | {"first": first} for r in rows], schema=summaries[0].schema)]
            found = [r for b in json_ranges._values(json_ranges._scanned(iter(summaries))) for r in b.to_pylist()]
            assert [json.loads(r["value"]) for r in found] == (values if "a" in text else [])
            assert [r["start"] for r in found] == sorted({r["start"] for r in found})


def test_many_files_of_both_kinds(spark, tmp_path):
    rows = [{"question_id": f"q{i}", "question_type": "t", "question": "?", "haystack_session_ids": [f"s{i}"], "haystack_sessions": [[{"role": "user", "content": f"] {i} ["}]], "answer_session_ids": []} for i in range(60)]
    for k in range(6):
        own = rows[k * 10 : k * 10 + 10]
        (tmp_path / f"part-{k}.json").write_text(json.dumps(own) if k % 2 else "\n".join(map(json.dumps, own)) + "\n")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.json").write_text("")
    found = parsers.questions(spark, str(tmp_path), range_bytes=150)
    assert {r["question_id"] for r in found.collect()} == {r["question_id"] for r in rows} and found.count() == 60
    turns = parsers.candidate_turns(found)
    assert {(r["session_id"], r["text"]) for r in turns.collect()} == {(f"s{i}", f"] {i} [") for i in range(60)}
    with pytest.raises(FileNotFoundError):
        json_values(spark, str(tmp_path / "absent.json"))


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    values = [{"i": i, "text": f'"{i}" ' + "[{,\\" * 200} for i in range(20_000)]
    path.write_text(json.dumps(values))
    found = json_values(spark, str(path), range_bytes=1 << 20)
    read = found.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert path.stat().st_size > 20_000_000 and len(read) >= 10 and sum(r["count"] for r in read) == 20_000
    same = found.select(F.from_json("value", "i long, text string").alias("r")).filter(F.col("r.text") == F.concat(F.lit('"'), F.col("r.i").cast("string"), F.lit('" ' + "[{,\\" * 200)))
    assert same.count() == 20_000
