"""Personal data by candidate spans and gradient-boosted trees.

Plain rules give the base spans (emails, IP addresses, cards, phones), which
always stay.  High-recall generators also propose overlapping candidates that
the rules miss: numbers that run into their neighbours, other separators,
digits written one by one, spelled-out emails; and secrets (passwords, keys,
tokens), which are kept apart from the four kinds.  National identifiers and
bank accounts are not proposed.  Boosted trees score candidates by format and
context; scores are calibrated on held-out examples, and each kind's threshold
is the least that keeps the wanted precision there.  Of overlapping candidates
the best stays, and none that overlaps a base span.

The trees are fitted on `EXAMPLES` seeded sentences on the driver and
broadcast.  Two thirds of the sentences stand in the corpus's own prose: at
most `CONTEXTS` windows, `EACH` of a document (half of them around digits,
where look-alikes are), with base spans masked, so what the corpus itself says
around numbers counts as clean.  Positives are made up in many formats,
look-alikes (order numbers, versions, dates, sums, checksums) too.

Offsets are code points, ends exclusive.  Null text is empty; very long texts
are scanned in linear time and scored in blocks; of equally good overlapping
candidates the longer, then the first by kind and place stays; repeated rows are judged alike;
an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import BoostedTrees, isotonic
from .common import prepare

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
EXAMPLES, SEED, PRECISION = 12_000, 11, 0.98
#: Bounds of the sample of surroundings: windows in all and from one document, code points on either side.
CONTEXTS, EACH, WINDOW = 4000, 4, 80
#: Candidates scored at a time.
SCORED = 4096

#: The base rules.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_INTEREST = re.compile(r"[0-9@]|\b[Aa][Tt]\b")

Span = tuple[str, int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by kind in order, then start."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        lo, hi = at, at + 1
        while lo and text[lo - 1] in _LOCAL:
            lo -= 1
        while hi < len(text) and (text[hi] in _LOCAL or text[hi] == "@"):
            hi += 1
        out += [("email", lo + m.start(), lo + m.end()) for m in _EMAIL.finditer(text[lo:hi])]
        at = text.find("@", hi)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


#: Candidate formats: wider than the rules.
_RUN = re.compile(r"[+(]?[0-9](?:[ ().\-/·–]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+) ?(?:[\[({] ?(?:at|AT|@) ?[\])}]|(?: (?:at|AT) )) ?([A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT )[A-Za-z0-9-]+)+)")
_DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,] ?[0-9]{1,3}){3,}")
#: Digits of the longest card; a candidate ends there.
MAX_DIGITS = 19
#: Names that secrets are assigned to, and published prefixes of keys.
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passwd|pwd|pass|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|credentials?)[\"']?\s{0,3}$")
_ASSIGNED = re.compile(r"(?:[:=]+>?|\bis\b)\s{0,3}[\"'`]?([^\s\"'`,;<>]{4,})")
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|AIza|eyJ|ya29\.|SG\.|hf_|npm_)")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=\-]{16,}")


def _inner(text: str, groups: list[tuple[int, int]]) -> list[bool]:
    """Whether a group goes on with the one before: in digits written one by one with one separator nothing starts or ends."""
    gaps = [text[a[1] : b[0]] for a, b in zip(groups, groups[1:])]
    single = [b - a == 1 for a, b in groups]
    inner = [False] * (len(groups) + 1)
    for k in range(1, len(groups)):
        inner[k] = single[k - 1] and single[k] and (k == 1 or not single[k - 2] or gaps[k - 2] == gaps[k - 1])
    return inner


def candidates(text: str) -> Iterator[Span]:
    """High recall: overlapping spans that may be personal data, kind by kind in page order, some of them twice."""
    if re.search(r"(?i)\bat\b|@", text):
        for m in _SPELLED.finditer(text):
            yield "email", m.start(), m.end()
    for m in _DOTTED.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for k in range(len(groups) - 3):
            yield "ip", groups[k][0], groups[k + 3][1]
    for m in _RUN.finditer(text):
        if sum("0" <= c <= "9" for c in m[0]) < 7:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        inner = _inner(text, groups)
        for i, (start, _) in enumerate(groups):
            if inner[i]:
                continue
            total = 0
            for j in range(i, len(groups)):
                total += groups[j][1] - groups[j][0]
                if total > MAX_DIGITS:
                    break
                if inner[j + 1]:
                    continue
                if 13 <= total and luhn(digits_of(text[start : groups[j][1]])):
                    yield "card", start, groups[j][1]
                if 7 <= total <= 15:
                    lead = start
                    while lead > m.start() and text[lead - 1] in "+(":
                        lead -= 1
                    yield "phone", lead, groups[j][1]


def secret_candidates(text: str) -> Iterator[Span]:
    """High recall: values assigned to names of secrets, and opaque strings with digits among their letters."""
    for m in _ASSIGNED.finditer(text):
        if not _NAMED.search(text[max(0, m.start() - 24) : m.start()]):
            continue
        yield SECRET, m.start(1), m.start(1) + len(m[1].rstrip(".:!?)]}"))
    for m in _OPAQUE.finditer(text):
        body = m[0].rstrip("=-_")
        if any("0" <= c <= "9" for c in body) and any(c.isalpha() for c in body):
            yield SECRET, m.start(), m.start() + len(body)
            cut = max(body.rfind("="), body.rfind("/")) + 1
            if 0 < cut and len(body) - cut >= 6:
                yield SECRET, m.start() + cut, m.start() + len(body)


#: Context words: what they speak for.
_CONTEXT = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|courriel|correo|kontakt)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address|adresse|ping|client)\b"),
    "card": re.compile(r"(?i)\b(card|visa|master|credit|debit|karte|carte|tarjeta|pay|paid|account)\b"),
    "secret": re.compile(r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_ -]?key|key|auth|credential|bearer)[\"']?\s*(:|=|=>|is|:=)?\s*[\"'`]?$"),
    "phone": re.compile(r"(?i)\b(tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|whatsapp|ring)\b"),
}
_AGAINST = re.compile(r"(?i)\b(order|invoice|version|isbn|serial|ref|id|item|sku|no|nr|number|total|sum|price|page|chapter|section|release|build|date|year|code|ticket|art)\b|[$€£v#]\s?$")


_AGAINST_SECRET = re.compile(r"(?i)\b(commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|file|path|revision|isbn|id|etag)\b\W*$")
_ORDER = {k: n for n, k in enumerate((*KINDS, SECRET))}


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 12]
    prev, following = before[-1:], after[:1]
    numbers = _GROUP.findall(body)
    groups = [len(g) for g in numbers]
    digits = "".join(numbers)
    pads = (groups + [0] * 5)[:5]
    parts = [int(g) for g in numbers if len(g) < 6]
    same = 1.0 if len(set(groups)) == 1 else 0.0
    upper, lower = sum("A" <= c <= "Z" for c in body), sum("a" <= c <= "z" for c in body)
    counts = [body.count(c) for c in set(body)]
    entropy = -sum(c / len(body) * math.log2(c / len(body)) for c in counts) if body else 0.0
    secret = kind == SECRET
    return [
        float(_ORDER[kind]), float(len(digits)), float(len(groups)), *map(float, pads), same,
        float(not secret and bool(digits) and luhn(digits)), float(digits[:1] in "3456" and bool(digits)), float(body.startswith("+")), float("(" in body), float(body.count("(") == body.count(")")), float(body.count(".")), float(body.count("-")), float(body.count(" ")),
        float(prev.isalnum()), float(following.isalnum()), float(prev in ".,-/+:" and bool(prev)), float(following in "-/%:" and bool(following)), float(bool(re.match(r"[.,]\s*[0-9]", after))), float(bool(re.search(r"[0-9][ -]$", before))), float(bool(re.match(r"[ -][0-9]", after))),
        float(bool(_CONTEXT[kind].search(before))), float(bool((_AGAINST_SECRET if secret else _AGAINST).search(before))), float(max(parts, default=0)), float(all(map(_small, numbers))), float(body[:1] == "0"),
        float(bool(re.search(r"[\[({]", body))), float(bool(re.search(r"(?i)\bdot\b|\.", body))), float(len(re.findall(r"[A-Za-z0-9-]+", body))), float(len(re.split(r"[^A-Za-z]+", body.strip("])} "))[-1])), float(len(set(digits))),
        float(len(body)), entropy, upper / max(1, len(body)), lower / max(1, len(body)), float(bool(_PREFIX.match(body))), float(all(c in "0123456789abcdefABCDEF" for c in body)), float("=" in body), float("/" in body),
    ]


def _check_digit(prefix: str) -> str:
    return next(d for d in "0123456789" if luhn(prefix + d))


def made_up(rng: random.Random, contexts: tuple[tuple[str, str], ...] = ()) -> tuple[str, list[Span]]:
    """A sentence and what is to be found in it; two thirds of them in the given surroundings."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    opaque = lambda k, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "er", "on", "th", "re", "sh", "ing", "le", "ou", "ch")) for _ in range(rng.randint(1, 3)))
    kind = rng.choice((*KINDS, SECRET, "none", "none", "none", "none"))
    lead = {"email": ["email", "mail me:", "contact"], "ip": ["from host", "server", "IP"], "card": ["card", "Visa", "paid with"], "phone": ["call", "tel.", "phone", "mobile"], SECRET: ["key", "use", "the token", "secret"], "none": ["order", "invoice no.", "version", "ISBN", "ref", "total", "page", "build", "id", "dated", "item", "commit", "sha1", "checksum", "file"]}[kind]
    opened = ""
    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."), ("(at)", "."), (" {at} ", " {dot} "), (" [at] ", " [dot] "), (" (at) ", ".")))
        body = f"{word()}{rng.choice(('.', '', '_'))}{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io'))}"
    elif kind == "ip":
        body = rng.choice((".", ".", ". ", ",")).join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        d = rng.choice("45") + n(14)
        d += _check_digit(d)
        sep, each = rng.choice((("", 4), (" ", 4), ("-", 4), (".", 4), (" - ", 4), ("/", 4), ("/", 1), (" ", 2)))
        body = sep.join(d[i : i + each] for i in range(0, 16, each))
    elif kind == "phone":
        a, b, c = str(rng.randint(201, 989)), str(rng.randint(200, 999)), n(4)
        body = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{rng.choice(('33', '34', '49', '44'))} {n(3)} {n(3)} {n(3)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+49 {n(3)} {n(7)}", " ".join(a + b + c), "-".join(a + b + c)))
    elif kind == SECRET:
        body = rng.choice(("AKIA" + opaque(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), hexa(40), hexa(32), hexa(18), opaque(24), opaque(40), "ghp_" + opaque(36), "sk-" + opaque(32), opaque(12), word() + n(3)))
        if not _PREFIX.match(body):
            name, sign = rng.choice(("password", "passwd", "token", "secret", "api_key", "pwd", "auth")), rng.choice(("=", ": ", " = ", "="))
            quote = rng.choice(("", "", '"', "'"))
            opened = f"{name}{sign}{quote}"
    else:
        body = rng.choice((n(rng.randint(7, 18)), f"{n(2)}.{n(1)}.{n(1)}.{n(2)}", f"{rng.randint(1990, 2030)}-{n(2)}-{n(2)} {n(2)}:{n(2)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(4)} {n(4)} {n(4)} {n(4)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"{n(5)}-{n(4)}", f"{n(4)}/{n(4)}/{n(2)}", f"{word()} at {word()}. {word()}", f"{n(10)}", f"{n(3)} {n(3)} {n(4)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(6)}-{n(6)}", " ".join(n(rng.randint(7, 14))), hexa(40), hexa(32), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"{word()}-{word()}-{n(4)}_{word()}-{word()}", f"docs/{word()}{n(2)}/{word()}/{word()}{n(3)}", f"{word()}{word()}{word()}{word()}{n(1)}", f"password: {word()}{word()}", f"token={rng.choice(('null', 'string', 'undefined', '<token>', '********'))}"))
    given = rng.choice(contexts) if contexts and rng.random() < 2 / 3 else None
    head = given[0] if given else " ".join(word() for _ in range(rng.randint(2, 6))) + " "
    if rng.random() < (0.5 if kind != "none" else 0.75):
        head += rng.choice(lead) + " "
    head += opened
    text = head + body
    spans = [(kind, len(head), len(text))] if kind != "none" else []
    if opened and quote:
        text += quote
    if kind in ("card", "phone") and rng.random() < 0.4:  # what follows runs into it
        text += rng.choice((" ", " ", "-")) + n(rng.randint(3, 16))
    return text + (given[1] if given and given[1] else rng.choice((" ", ", ", ". ", "; ")) + word()), spans


def calibrated(raw: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return steps[1][np.minimum(np.searchsorted(steps[0], raw), len(steps[1]) - 1)]


@functools.lru_cache(maxsize=4)
def fitted(examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION, contexts: tuple[tuple[str, str], ...] = ()):
    """(trees, calibration by kind, thresholds by kind) from seeded sentences."""
    rng = random.Random(seed)
    rows, labels, kinds, held = [], [], [], []
    for k in range(examples):
        text, spans = made_up(rng, contexts)
        taken = Intervals([(a, b) for _, a, b in base_spans(text)])
        for span in dict.fromkeys([*candidates(text), *secret_candidates(text)]):
            if taken.meets(span[1], span[2]):  # the rules settle it, here as in a document
                continue
            rows.append(features(text, span))
            labels.append(span in spans)
            kinds.append(span[0])
            held.append(k % 3 == 0)
    x, y, held, kinds = np.array(rows), np.array(labels, dtype=float), np.array(held), np.array(kinds)
    trees = BoostedTrees(trees=120, depth=4, rate=0.2).fit(x[~held], y[~held])
    raw = trees.predict(x[held])
    steps, thresholds = {}, {}
    for kind in (*KINDS, SECRET):
        own = kinds[held] == kind
        steps[kind] = isotonic(raw[own], y[held][own])
        p, t = calibrated(raw[own], steps[kind]), y[held][own]
        thresholds[kind] = next((float(c) for c in np.unique(p) if c >= 0.5 and t[p >= c].mean() >= precision), 1.1)
    return trees, steps, thresholds


def corpus_contexts(docs: DataFrame, text_col: str = "text", *, windows: int = CONTEXTS, seed: int = SEED) -> tuple[tuple[str, str], ...]:
    """(what stands before, what stands after) at EACH places of the first documents, base spans masked; only as many are read as it takes."""
    schema = pa.schema([("before", pa.string()), ("after", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                rng = random.Random(f"{seed}:{len(text)}")
                numbers = [m.start() for m in itertools.islice(_GROUP.finditer(text), 64 * EACH)]
                places = rng.sample(numbers, min(len(numbers), EACH // 2))
                places += [rng.randrange(len(text)) for _ in range(EACH - len(places))]
                for at in places:
                    at = text.find(" ", at) + 1 or len(text)
                    lo, hi = max(0, at - WINDOW), min(len(text), at + WINDOW)
                    before, after = (_masked(text[a:b]) for a, b in ((lo, at), (at, hi)))
                    out.append({"before": before, "after": " " + after if after else ""})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(docs[text_col].alias("text")).filter("length(text) > 0").mapInArrow(cut, "before string, after string")
    return tuple(sorted({(r["before"], r["after"]) for r in rows.limit(windows).collect()}))


def _masked(text: str) -> str:
    """The text with base spans, secrets' candidates and cut numbers at its ends blanked."""
    spans = [*base_spans(text), *secret_candidates(text)]
    for _, s, e in spans:
        text = text[:s] + "x" * (e - s) + text[e:]
    return re.sub(r"^\S*[0-9@]\S*|\S*[0-9@]\S*$", "", text)


class Intervals:
    """Disjoint intervals; overlap is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]] = ()) -> None:
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start

    def add(self, start: int, end: int) -> None:
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start), self.ends.insert(k, end)


class Redactor:
    def __init__(self, model) -> None:
        self.trees, self.steps, self.thresholds = model

    def accepted(self, text: str, proposed: Iterator[Span], taken: Intervals) -> list[Span]:
        """The best of overlapping candidates over their kind's threshold, clear of `taken`; scored block by block."""
        good: list[tuple[float, int, Span]] = []
        stream = (c for c in proposed if not taken.meets(c[1], c[2]))
        while block := list(dict.fromkeys(itertools.islice(stream, SCORED))):
            raw, kinds = self.trees.predict(np.array([features(text, c) for c in block])), np.array([c[0] for c in block])
            for kind in np.unique(kinds):
                p = calibrated(raw, self.steps[kind])
                # of equal chances the higher raw score is the better one
                good += [(-float(p[k]), -float(raw[k]), c[1] - c[2], c) for k, c in enumerate(block) if c[0] == kind and p[k] >= self.thresholds[kind]]
        added, held = [], Intervals()
        for *_, c in sorted(set(good)):
            if not held.meets(c[1], c[2]):
                held.add(c[1], c[2])
                added.append(c)
        return added

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind in order, then start."""
        if not _INTEREST.search(text):
            return [], []
        base = base_spans(text)
        added = self.accepted(text, candidates(text), Intervals([(s, e) for _, s, e in base]))
        return base, sorted(base + added, key=lambda x: (_ORDER[x[0]], x[1]))

    def secrets(self, text: str, spans: list[Span]) -> list[Span]:
        """Secrets clear of the personal data, by start."""
        return sorted(self.accepted(text, secret_candidates(text), Intervals([(s, e) for _, s, e in spans])), key=lambda x: x[1])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.schema([("doc_id", pa.int64()), ("base", _SPANS), ("spans", _SPANS), ("secrets", _SPANS)])
_SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint>>"
FOUND = f"doc_id long, base {_SPANS_SQL}, spans {_SPANS_SQL}, secrets {_SPANS_SQL}"


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, windows: int = CONTEXTS) -> DataFrame:
    """(doc_id, base, spans, secrets) for every row, one narrow pass after the sample."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(fitted(examples, contexts=corpus_contexts(docs, text_col, windows=windows)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(model.value)
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [(*both, redactor.secrets(t, both[1])) for t in texts for both in [redactor.spans(t)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([as_rows(f[k]) for f in found], _SPANS) for k in range(3)]], schema=_FOUND)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(find, FOUND)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in square brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])
