"""Facet extractors against plain Python, over whole tables."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.catalog import QUERIES
from marginalia.functions import patterns as P

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def phrases(text, families, trim, group=0):
    return [m[group].strip().rstrip(trim) for p in families for m in re.finditer(p, text)]


def first_of_each(found, cap):
    out, seen = [], set()
    for p in found:
        if p.lower() not in seen and len(out) < cap:
            out.append(p)
            seen.add(p.lower())
    return out


def dates(text):
    every = [re.sub(r"\s+", " ", p) for p in phrases(text, P.DATES, ".,!?;:")]
    return first_of_each([p for p in every if len(p) >= 3], 10)


def people(text):
    weights, first = Counter(), {}
    names = [(m[0], 2) for m in re.finditer(P.CAPITALIZED, text) if m[0].split()[0] not in P.NOT_NAMES and len(m[0]) >= 3]
    related = [m[1].strip().title() for m in re.finditer(P.RELATION_NAME, text)]
    names += [(m, 3) for m in related if m not in P.NOT_NAMES and len(m) >= 3]
    named = [m[1].strip().title() for m in re.finditer(P.NAMED, text)]
    names += [(m, 3) for m in named if m not in P.NOT_NAMES and m]
    for at, (name, w) in enumerate(names):
        weights[name] += w
        first.setdefault(name, at)
    return sorted(weights, key=lambda n: (-weights[n], first[n]))[:8]


def acronyms(text):
    found = [m[0] for m in re.finditer(P.CAPITALS, text)]
    counts = Counter(found)
    top = sorted(counts, key=lambda a: (-counts[a], found.index(a)))[:8]
    return [a for a in top if a not in P.NOT_CAPITALS]


def subjects(users, content):
    sentences = [re.split(r"(?<=[.!?])\s+", t.strip())[0][:120] for t in users if t.strip()]
    every = [*sentences, *(m[1] for m in re.finditer(P.QUOTED, content)), *(m[1] for m in re.finditer(P.LIST_ITEM, content)), *(m[1] for m in re.finditer(P.HEADING, content)), *acronyms(content)]
    every = [p.strip().rstrip(".,!?;:") for p in every]
    return first_of_each([p for p in every if len(p) >= 4], 12)


def entry(turns):
    turns = [(role, text or "") for role, text in turns]
    users = [t for r, t in turns if r == "user"]
    user, assistant, content = "\n".join(users), "\n".join(t for r, t in turns if r == "assistant"), "\n".join(t for _, t in turns)
    full = f"{user}\n{assistant}"
    fields = {
        "subjects": "; ".join(subjects(users, content)), "people": ", ".join(people(full)), "claims": "; ".join(first_of_each(phrases(user, P.CLAIMS, ".,!?"), 6)),
        "decisions": "; ".join(first_of_each(phrases(f"{assistant}\n{user}", P.DECISIONS, ".,!?"), 4)), "dates": "; ".join(dates(full)),
    }
    text = " | ".join(f"{k}: {v}" for k, v in fields.items() if v)
    return text[:1500] + "..." if len(text) > 1500 else text


def read(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_dates(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in read(spark, "documents").collect()}
    found = {r["doc_id"]: r["dates"] or "" for r in QUERIES["facet_dates"](spark, FOLDER).collect()}
    assert found == {k: "; ".join(dates(t)) for k, t in texts.items()}


def test_entries(spark):
    turns = {}
    for r in sorted(read(spark, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    found = {r["session_id"]: r["entry"] for r in QUERIES["facet_entries"](spark, FOLDER).collect()}
    assert found == {k: entry(t) for k, t in turns.items()}


def test_leads_leave_no_date_out(spark):
    """With what a pattern begins with looked for first, it finds the same: in any case, with a long s, Kelvin signs and digits of other scripts."""
    import random

    from marginalia.functions import facets as fx

    rng = random.Random(7)
    words = """january FEBRUARY Mar april may May MAY june jul August ſeptember ſept Sept october NOV dec monday Tuesday WEDNESDAY thurſday friday ſaturday Sunday yeſterday Tomorrow today toniGht
        this morning thiſ afternoon last week next\tyear laſt night 1999 2024 ２０２４ 2024-05-06 ٢٠٢٤-٠٥-٠٦ 1/2 ١/٢/٢٠٢٤ 3 days ago ٣ weeKs later 12 hours from now 10:30 ١٠:٣٠ 09:15pm 11 AM 0:59
        xmay mayé émay _1999 1999_ éMonday İ ı K ſ é ٣ . , ! : ; \n""".split(" ")
    texts = [rng.choice(["", " "]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(3000)] + [w for w in words] + [None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    pairs = [(fx.found("text", fx._unicode(p)), fx.found("text", lead + fx._unicode(p))) for p, lead in zip(P.DATES, fx.DATE_LEADS, strict=True)]
    rows = frame.select(*[F.array(a, b).alias(f"f{i}") for i, (a, b) in enumerate(pairs)]).collect()
    assert all(row[i][0] == row[i][1] for row in rows for i in range(len(pairs)))
    assert all(any(row[i][0] for row in rows) for i in range(len(pairs)))
