import hashlib
import random

import pytest

from marginalia.llm import chat
from marginalia.llm.queries import op3_chat_formatting


def test_round_trip_of_hostile_texts():
    rng = random.Random(2)
    bits = ["</s>", "[INST]", " [/INST]", "[/INST]", "\\", "ok", " ", "\n", "[ROLE:x] ", "<s>", "é", "[/ROLE]", "<|im_end|>", "[INST] ", "<", "/s>", "] ", " [/ROLE]"]
    for _ in range(4000):
        role = rng.choice(["user", "assistant", "system", "", "a] b", "tool\\", "[ROLE:x", "user ", "</s>"])
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
        rendered, start, end = chat.render_turn(role, text)
        assert chat.parse(rendered) == [(role, text, start, end)]
        assert not chat._CONTROL.search(rendered[start:end]) and chat.unescape(rendered[start:end]) == text


def test_whole_conversations_parse_back():
    rng = random.Random(3)
    turns = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a</s>", "[INST] b", "", "x [/INST] y", "\\"])) for _ in range(50)]
    assert [(r, t) for r, t, _, _ in chat.parse("".join(chat.render_turn(r, t)[0] for r, t in turns))] == turns


def test_query(spark, sf):
    rows = {r["conv_id"]: r for r in op3_chat_formatting(spark, sf).collect()}
    source = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        source.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    odd = "</s>[INST] ok [/INST]"
    source[-7] = [("user", odd), ("assistant", odd)]
    assert set(rows) == set(source)
    for k, turns in source.items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = rows[k]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, t in turns)


def test_odd_rows_and_parts(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (None, None, "assistant", "x"), (2, None, "user", "first"), (2, 0, "assistant", "y" * 50)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_conversations(df, part_chars=20)
    assert out.filter("conv_id = 1").count() >= 1
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert {k: v["n_turns"] for k, v in back.items()} == {1: 3, None: 1, 2: 2}
    assert back[2]["turns_sha256"] == hashlib.sha256(("user\nfirst\nassistant\n" + "y" * 50 + "\n").encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.parse("[INST] no end")
