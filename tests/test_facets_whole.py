"""Every facet of every conversation and document of the tables against plain Python."""

import os
import re
from collections import Counter

import pytest

from marginalia.catalog import QUERIES
from marginalia.functions import facets as fx
from marginalia.functions import patterns as P
from marginalia.session import configured

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return configured(spark)


def phrases(text, families, trim):
    return [m.group(0).strip().rstrip(trim) for p in families for m in re.finditer(p, text)]


def first_of_each(found, cap):
    out, seen = [], set()
    for p in found:
        if p.lower() not in seen and len(out) < cap:
            seen.add(p.lower())
            out.append(p)
    return out


def dates(text):
    return first_of_each([p for p in (re.sub(r"\s+", " ", p) for p in phrases(text, P.DATES, ".,!?;:")) if len(p) >= 3], 10)


def initials(name):
    return " ".join(w.capitalize() for w in name.split(" "))


def heaviest(weighted, cap):
    weight, first = Counter(), {}
    for at, (name, w) in enumerate(weighted):
        weight[name] += w
        first.setdefault(name, at)
    return sorted(weight, key=lambda n: (-weight[n], first[n], n))[:cap]


def people(text):
    capitals = [(m.group(0), 2) for m in re.finditer(P.CAPITALIZED, text) if m.group(0).split()[0] not in P.NOT_NAMES and len(m.group(0)) >= 3]
    related = [(n, 3) for m in re.finditer(P.RELATION_NAME, text) for n in [initials(m.group(1).strip())] if n not in P.NOT_NAMES and len(n) >= 3]
    named = [(n, 3) for m in re.finditer(P.NAMED, text) for n in [initials(m.group(1).strip())] if n not in P.NOT_NAMES and n]
    return heaviest(capitals + related + named, 8)


def subjects(turns, full):
    sentences = [re.split(r"(?<=[.!?])\s+", t.strip())[0][:120] for t in turns if t.strip()]
    acronyms = [a for a in heaviest([(m.group(0), 1) for m in re.finditer(P.CAPITALS, full)], 8) if a not in P.NOT_CAPITALS]
    found = sentences + [m for p in (P.QUOTED, P.LIST_ITEM, P.HEADING) for m in re.findall(p, full)] + acronyms
    return first_of_each([p for p in (p.strip().rstrip(".,!?;:") for p in found) if len(p) >= 4], 12)


def entry(turns):
    user, assistant = ([t for r, t in turns if r == role] for role in ("user", "assistant"))
    full = "\n".join(t for _, t in turns)
    both = "\n".join(user) + "\n" + "\n".join(assistant)
    parts = {
        "subjects": ("; ", subjects(user, full)),
        "people": (", ", people(both)),
        "claims": ("; ", first_of_each(phrases("\n".join(user), P.CLAIMS, ".,!?"), 6)),
        "decisions": ("; ", first_of_each(phrases("\n".join(assistant) + "\n" + "\n".join(user), P.DECISIONS, ".,!?"), 4)),
        "dates": ("; ", dates(both)),
    }
    text = " | ".join(f"{name}: {sep.join(found)}" for name, (sep, found) in parts.items() if found)
    return text if len(text) <= 1500 else text[:1500] + "..."


def test_entries_of_all_conversations(tables):
    turns = {}
    for r in tables.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    found = {r["session_id"]: r["entry"] for r in QUERIES["facet_entries"](tables, SF).collect()}
    assert found == {c: entry(t) for c, t in turns.items()} and len(found) >= 20


def test_dates_of_all_documents(tables):
    rows = QUERIES["facet_dates"](tables, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in tables.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["dates"] for r in rows if r["dates"]} == {i: "; ".join(dates(t)) for i, t in texts.items() if dates(t)}


def test_entries_of_planted_sentences(spark):
    said = [
        ("user", 'I prefer tea. My sister Anna lives near NASA. "quoted words here" on 2024-05-06 at 10:30.\n- first item of a list\n# Heading one'),
        ("assistant", "I decided on tea over coffee. We met last week, in May 2023; my friend called Bob Ray came 3 days ago. NASA and ESA. I'll use Rust."),
        ("user", "I'm a baker, I can't eat nuts! Allergic to cashew nuts. Zoë said so on Monday the 5th."),
        ("system", "ESA ESA"),
    ]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(said)] + [(2, 0, "user", None), (3, 0, "assistant", "word " * 900)]
    found = {r["session_id"]: r["entry"] for r in fx.facets(spark.createDataFrame(rows, "session_id long, turn int, role string, text string")).collect()}
    assert found == {1: entry(said), 2: entry([("user", "")]), 3: entry([("assistant", "word " * 900)])}
