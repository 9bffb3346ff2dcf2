"""Chat formatting with a grammar round trip.

    turn := "[INST] " text " [/INST]"          a user's
          | text "</s>"                         an assistant's
          | "[ROLE:" role "] " text " [/ROLE]"  any other

A deterministic parser reads the rendered turn back and the result is compared
with the source.  Where they differ, or where the text holds a control string,
conflicting content is escaped and the turn rendered again until they are
identical.  Escapes: a backslash keeps the character after it from starting
markup; backslashes in the source are doubled.  Unescaping is the same for
every text: drop a backslash and keep what follows.

The loss mask covers the text of every assistant turn, as half-open spans of
code points; the closing mark is outside.

Turns are ordered by turn number (nulls first), then role and text.  A
conversation longer than `part_chars` goes on in further parts, so memory is
bounded by a part and its longest turn, not by the conversation.

Defined results: null role and text are empty; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: The template's marks and the control strings of widespread chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE:", "[/ROLE]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PART_CHARS = 4 << 20


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def _marks(role: str) -> tuple[str, str]:
    if role == "user":
        return "[INST] ", " [/INST]"
    if role == "assistant":
        return "", "</s>"
    return f"[ROLE:{role}] ", " [/ROLE]"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the escaped text."""
    turns, at, n = [], 0, len(rendered)
    while at < n:
        if rendered.startswith("[INST] ", at):
            role, start, close = "user", at + 7, " [/INST]"
        elif rendered.startswith("[ROLE:", at):
            stop = _plain(rendered, "] ", at + 6)
            role, start, close = unescape(rendered[at + 6 : stop]), stop + 2, " [/ROLE]"
        else:
            role, start, close = "assistant", at, "</s>"
        end = _plain(rendered, close, start)
        turns.append((role, unescape(rendered[start:end]), start, end))
        at = end + len(close)
    return turns


def _plain(text: str, mark: str, at: int) -> int:
    """The first place of `mark` from `at` on that isn't escaped; the mark's first character may be a space."""
    while True:
        found = text.find(mark, at)
        if found < 0:
            raise ValueError(f"no {mark!r}")
        k = found
        while k > at and text[k - 1] == "\\":
            k -= 1
        if (found - k) % 2 == 0:
            return found
        at = found + 1


def _escapes(text: str) -> Iterator[str]:
    """The text with more and more of it escaped."""
    yield text
    doubled = text.replace("\\", "\\\\")
    yield doubled
    broken = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)
    yield broken
    yield _ESCAPED_ALL.sub(r"\\\1", text)


_ESCAPED_ALL = re.compile(r"([\\<>\[\]/|:\s])")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of the text in it)."""
    for label in _escapes(role) if role not in ("user", "assistant") else (role,):
        open_mark, close = _marks(label)
        for body in _escapes(text):
            if _CONTROL.search(body) or _CONTROL.search(label):
                continue
            rendered = open_mark + body + close
            try:
                turns = parse(rendered)
            except ValueError:
                continue
            if len(turns) == 1 and turns[0][:2] == (role, text):
                return rendered, turns[0][2], turns[0][3]
    raise ValueError("no rendering reads back as the turn")


_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
PARTS = "conv_id long, part int, formatted string, last boolean, n_turns long, loss_spans array<struct<start:bigint,end:bigint>>"


def format_conversations(turns: DataFrame, *, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, last, n_turns, loss_spans); `last` marks the part that ends a conversation."""
    prepare(turns.sparkSession)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, part, pieces, spans, n, length = [], None, 0, [], [], 0, 0

        def emitted(last: bool) -> dict:
            return {"conv_id": current[0], "part": part, "formatted": "".join(pieces), "last": last, "n_turns": n, "loss_spans": spans}

        for batch in batches:
            for conv, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if current is not None and (conv != current[0] or length >= part_chars):
                    out.append(emitted(conv != current[0]))
                    part = part + 1 if conv == current[0] else 0
                    pieces, spans, n, length = [], [], 0, 0
                    if len(out) == 500 or part:
                        yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
                        out = []
                current = (conv,)
                rendered, start, end = render_turn(role or "", text or "")
                if role == "assistant":
                    spans.append({"start": length + start, "end": length + end})
                pieces.append(rendered)
                n, length = n + 1, length + len(rendered)
        if current is not None:
            out.append(emitted(True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PARTS)

    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].alias("turn"), turns["role"].alias("role"), turns["text"].alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(assemble, PARTS)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted parts hold, from parsing them and from their loss spans alone; in any order of rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if current is None or current["conv_id"] != row["conv_id"] or row["part"] == 0:
                    if current is not None:
                        out.append(current)
                    current = {"conv_id": row["conv_id"], "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                text = row["formatted"]
                for role, said, _, _ in parse(text):
                    current["n_turns"] += 1
                    current["turns_sha256"].update(f"{role}\n{said}\n".encode())
                for span in row["loss_spans"]:
                    said = unescape(text[span["start"] : span["end"]])
                    current["loss_chars"] += len(said)
                    current["loss_sha256"].update(said.encode())
                current["formatted_chars"] += len(text)
        if current is not None:
            out.append(current)
        for at in range(0, len(out), 4000):
            yield pa.RecordBatch.from_pylist([{k: v.hexdigest() if hasattr(v, "hexdigest") else v for k, v in r.items()} for r in out[at : at + 4000]], schema=_DIGEST)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    # a conversation in one part is read where it lies, the parts of a longer one are brought together
    alone = F.col("last") & (F.col("part") == 0)
    together = formatted.filter(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.filter(alone).mapInArrow(digest, schema).unionByName(together.mapInArrow(digest, schema))
