"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The likelihood of a word is the sum over all its segmentations into pieces, by
the forward algorithm; a text's is the product over its words.

Learning counts the words of all learning documents, by one shuffle on the
word, so every different word is segmented once.  Piece probabilities start
from the vocabulary's own segmentation and go through `ROUNDS` rounds of
expectation-maximisation, with the expected piece counts of the forward and
backward sums.

Words are runs of letters and the marks that belong to them, lower-cased; all
else parts words.  Very long words are scored whole, in bounded memory.  Scoring moves no rows: it is one narrow pass.  The scores of
the most frequent words are sent to all tasks, other words are scored where
they occur, with a bounded cache.

The model has the vocabulary's size times the languages; more than
`MAX_LANGUAGES` different values are refused.

Defined results: null text or a text without a letter is `und` with score 0;
with nothing to learn from every text is `und`; ties go to the language that
is first by code point; very long texts and words are scored whole; repeated
rows are scored alike; an empty table gives an empty table; the input record
travels as a struct where extra columns are to be kept, so they cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, release_memory, scratch, staged

UNDETERMINED = "und"
SMOOTHING = 0.5
ROUNDS = 1
#: Least probability of a piece: LONG of them in a row are still a normal double; longer words are rescaled on the way.
FLOOR, LONG = 1e-9, 32
#: With so many languages a model has 125 MB.
MAX_LANGUAGES = 500
#: Words whose scores are sent to all tasks, of at most so many bytes, and words in a task's own cache.
KNOWN_WORDS, KNOWN_BYTES, CACHE_WORDS = 200_000, 256, 300_000
#: Longer words are scored by blocks of so many positions; when learning they count as stretches of that length.
WHOLE, BLOCK = 4096, 512
#: Words in a lattice at a time, and positions times words times languages.
CHUNK, CELLS = 2000, 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTERS = bytes(range(97, 123))


class Vocabulary:
    """The pieces of a sentencepiece model; prefixes map to a piece's row or -1."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        plain = [i for i in range(n) if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i))]
        self.row = {i: k for k, i in enumerate(plain)}
        self.prefix: dict[str, int] = {}
        for i in plain:
            piece = self.processor.id_to_piece(i)
            for k in range(1, len(piece)):
                self.prefix.setdefault(piece[:k], -1)
            self.prefix[piece] = self.row[i]
        self.size = len(plain)
        self.longest = max(map(len, self.prefix))
        self.unknown = self.size  # one more row, alike in all languages


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=1 << 16)
def _parts_words(c: str) -> bool:
    return c > "\x7f" and not c.isalpha() and unicodedata.category(c)[0] != "M"


def letter_words(text: str) -> list[bytes]:
    """Runs of letters and marks, ASCII case folded."""
    if not text.isascii():
        others = {ord(c): " " for c in set(text) if _parts_words(c)}
        if others:
            text = text.translate(others)
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def has_letter(words: list[bytes]) -> bool:
    return any(w.translate(None, _LETTERS) != w or any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in words)


def spelled(word: bytes) -> str:
    return "▁" + word.decode("utf-8", "replace").lower()


def word_counts(docs: DataFrame, languages: list[str], *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(word, total, counts by language): one row for each different word of all documents with a language."""
    prepare(docs.sparkSession)
    schema = pa.schema([("word", pa.binary()), ("lang", pa.int32()), ("n", pa.int64())])
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, Counter] = {}

        def settle() -> Iterator[pa.RecordBatch]:
            for lang, counter in words.items():
                keys, times = list(counter), list(counter.values())
                for at in range(0, len(keys), 20_000):
                    own = keys[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([lang] * len(own), pa.int32()), pa.array(times[at : at + 20_000], pa.int64())], schema=schema)
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(place[lang], Counter()).update(letter_words(text))
            if sum(map(len, words.values())) > CACHE_WORDS:
                yield from settle()
        yield from settle()
        release_memory()

    rows = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    counted = rows.mapInArrow(count, "word binary, lang int, n long")
    by_language = [F.sum(F.when(F.col("lang") == k, F.col("n"))).alias(f"n{k}") for k in range(len(languages))]
    return counted.groupBy("word").agg(F.sum("n").alias("total"), *by_language).select("word", "total", F.array(*[F.coalesce(f"n{k}", F.lit(0)) for k in range(len(languages))]).alias("counts"))


@dataclass
class Lattice:
    """All pieces in a batch of words, in order of their ends; `longest` positions."""

    lengths: np.ndarray
    who: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, words: list[str], prefix: dict[str, int], unknown: int) -> Lattice:
        who, start, end, piece = [], [], [], []
        for k, s in enumerate(words):
            n = len(s)
            for i in range(n):
                single = False
                for j in range(i + 1, n + 1):
                    row = prefix.get(s[i:j])
                    if row is None:
                        break
                    if row >= 0:
                        who.append(k), start.append(i), end.append(j), piece.append(row)
                        single |= j == i + 1
                if not single:
                    who.append(k), start.append(i), end.append(i + 1), piece.append(unknown)
        who, start, end, piece = (np.array(x, dtype=np.int64) for x in (who, start, end, piece))
        order = np.lexsort((who, end))
        return cls(np.array([len(s) for s in words]), who[order], start[order], end[order], piece[order])

    def sums(self, table: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Summed probabilities up to (or from) every position, by word and language, and the logs they are scaled by where words are long."""
        longest, n = int(self.lengths.max()), len(self.lengths)
        words = np.arange(n)
        alpha = np.zeros((longest + 1, n, table.shape[1]))
        scales = np.zeros_like(alpha) if longest > LONG + 1 else None
        if backward:
            order = np.lexsort((self.who, -self.start))
            who, here, there, piece = self.who[order], self.start[order], self.end[order], self.piece[order]
            alpha[self.lengths, words] = 1
            edge = np.searchsorted(-here, -np.arange(longest - 1, -2, -1))
            steps = range(longest - 1, -1, -1)
        else:
            who, here, there, piece = self.who, self.end, self.start, self.piece
            alpha[0] = 1
            edge = np.searchsorted(here, np.arange(1, longest + 2))
            steps = range(1, longest + 1)
        for k, j in enumerate(steps):
            a, b = edge[k], edge[k + 1]
            if a == b:
                continue
            own = who[a:b]
            firsts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            held = own[firsts]
            terms = alpha[there[a:b], own] * table[piece[a:b]]
            if scales is None:
                alpha[j, held] = np.add.reduceat(terms, firsts, axis=0)
                continue
            before = j + 1 if backward else j - 1
            scales[j, held] = scales[before, held]
            sums = np.add.reduceat(terms * np.exp(scales[there[a:b], own] - scales[j, own]), firsts, axis=0)
            alpha[j, held] = 1
            scales[j, held] += np.log(sums)
        return alpha, scales

    def likelihood(self, table: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each word, by language."""
        alpha, scales = self.sums(table)
        at = self.lengths, np.arange(len(self.lengths))
        return np.log(alpha[at]) + (0 if scales is None else scales[at])

    def expected(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of every piece by language, for words that occur `counts` times."""
        alpha, up = self.sums(table)
        beta, down = self.sums(table, backward=True)
        at = self.lengths, np.arange(len(self.lengths))
        p = alpha[self.start, self.who] * table[self.piece] * beta[self.end, self.who] / alpha[at][self.who]
        if up is not None:
            p *= np.exp(up[self.start, self.who] + down[self.end, self.who] - up[at][self.who])
        p *= counts[self.who]
        return np.stack([np.bincount(self.piece, weights=c, minlength=len(table)) for c in p.T], axis=1)


def blocked_likelihood(word: str, own: Vocabulary, table: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """As `Lattice.likelihood` for one word of any length, in memory that does not grow with it.

    The sum at a position needs those of the `longest` positions before it
    only, and is linear in them.  So a block of positions is a matrix from the
    sums before it to its last ones; the matrices of many blocks are made side
    by side, and then applied one after the other.
    """
    reach, languages = own.longest, table.shape[1]
    many = max(1, min(256, 4 * CELLS // (reach * reach * languages)))
    sums, logs = np.zeros((reach, languages)), np.zeros(languages)
    sums[0] = 1  # by position modulo `reach`; before the word there is nothing
    base = 0
    while base < len(word):
        left = len(word) - base
        size, n = (block, min(many, left // block)) if left >= block else (left, 1)
        who, end, length, piece = [], [], [], []
        for k in range(n):
            first = base + k * size
            # pieces that end in the block, also those that begin before it
            for i in range(max(0, first - reach + 1), first + size):
                single = False
                for j in range(i + 1, min(first + size, i + reach) + 1):
                    row = own.prefix.get(word[i:j])
                    if row is None:
                        break
                    if row >= 0 and j > first:
                        who.append(k), end.append(j - first), length.append(j - i), piece.append(row)
                        single |= j == i + 1
                if not single and i >= first and own.prefix.get(word[i], -1) < 0:
                    who.append(k), end.append(i + 1 - first), length.append(1), piece.append(own.unknown)
        who, end, length, piece = (np.array(x, dtype=np.int64) for x in (who, end, length, piece))
        order = np.lexsort((who, end))
        who, end, length, piece = who[order], end[order], length[order], piece[order]
        edge = np.searchsorted(end, np.arange(1, size + 2))
        # positions relative to the block, modulo `reach`; each of those before it is a start of its own
        ring, scale = np.zeros((n, reach, reach, languages)), np.zeros((n, languages))
        ring[:, np.arange(reach), np.arange(reach)] = 1
        for j in range(1, size + 1):
            a, b = edge[j - 1], edge[j]
            terms = ring[who[a:b], (j - length[a:b]) % reach] * table[piece[a:b], None]
            own_who = who[a:b]
            ring[:, j % reach] = np.add.reduceat(terms, np.flatnonzero(np.concatenate([[True], own_who[1:] != own_who[:-1]])), axis=0)
            if j % 8 == 0:
                most = ring.max(axis=(1, 2))
                ring /= most[:, None, None]
                scale += np.log(most)
        for k in range(n):
            # starts are by position modulo `reach` from the block on, as sums are
            sums = np.einsum("ouc,uc->oc", ring[k], sums)
            most = sums.max(axis=0)
            sums /= most
            logs += np.log(most) + scale[k]
            sums = np.roll(sums, -size, axis=0)
        base += n * size
    return logs + np.log(sums[0])


def scored_words(words: list[str], own: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Log likelihoods of words of any length, by language."""
    out = np.zeros((len(words), table.shape[1]))
    short = np.array([k for k, w in enumerate(words) if len(w) <= WHOLE], dtype=np.int64)
    for places, lattice in lattices([words[k] for k in short], own, table.shape[1]):
        out[short[places]] = lattice.likelihood(table)
    for k, word in enumerate(words):
        if len(word) > WHOLE:
            out[k] = blocked_likelihood(word, own, table)
    return out


def lattices(words: list[str], own: Vocabulary, languages: int) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(places, lattice) of batches of words of like length."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    short = int(np.searchsorted(ordered, LONG + 1, side="right"))
    at = 0
    while at < len(order):
        # the long words' batches hold no short ones, which need no scaling
        end = min(short if at < short else len(order), at + CHUNK)
        while end - at > 1 and (end - at) * int(ordered[end - 1]) * languages > CELLS:
            end = (at + end + 1) // 2
        chunk = order[at:end]
        yield chunk, Lattice.of([words[k] for k in chunk], own.prefix, own.unknown)
        at = end


def _piece_table(counted: DataFrame, size: int, languages: int) -> np.ndarray:
    """Probabilities from (piece, counts by language) sums; one row a piece."""
    table = np.full((size, languages), SMOOTHING)
    for batch in counted.toArrow().to_batches():
        table[batch.column("piece").to_numpy()] += np.asarray(batch.column("counts").flatten()).reshape(-1, languages)
    table = np.maximum(table / table.sum(axis=0), FLOOR)
    table[-1] = FLOOR
    return table


def count_pieces(words: DataFrame, vocabulary_path: str, languages: int, table: np.ndarray | None) -> DataFrame:
    """(piece, counts by language) of all words: of the vocabulary's own segmentation, or expected ones under a table."""
    size = vocabulary(vocabulary_path).size + 1
    schema = pa.schema([("piece", pa.int32()), ("counts", pa.list_(pa.float64()))])
    sent = words.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = vocabulary(vocabulary_path), np.zeros((size, languages))
        words: list[bytes] = []
        times: list[list[int]] = []

        def settle() -> None:
            spellings, counts = [spelled(w) for w in words], np.array(times, dtype=np.float64).reshape(-1, languages)
            words.clear(), times.clear()
            if sent.value is None:
                ids = own.processor.encode([s[1:] for s in spellings], num_threads=1)
                rows = np.fromiter((own.row.get(i, own.unknown) for one in ids for i in one), dtype=np.int64)
                weights = np.repeat(counts, [len(one) for one in ids], axis=0)
                sums[:] += np.stack([np.bincount(rows, weights=c, minlength=size) for c in weights.T], axis=1)
            else:
                stretches = [(w[i : i + WHOLE], k) for k, w in enumerate(spellings) for i in range(0, len(w), WHOLE)]
                owner = np.array([k for _, k in stretches], dtype=np.int64)
                for places, lattice in lattices([w for w, _ in stretches], own, languages):
                    sums[:] += lattice.expected(sent.value, counts[owner[places]])

        for batch in batches:
            words += batch.column("word").to_pylist()
            times += batch.column("counts").to_pylist()
            if len(words) >= 5 * CHUNK:
                settle()
        if words:
            settle()
        rows = np.flatnonzero(sums.any(axis=1))
        for at in range(0, len(rows), 2000):
            own_rows = rows[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(own_rows.astype(np.int32)), pa.array(list(sums[own_rows]), pa.list_(pa.float64()))], schema=schema)
        release_memory()

    each = [F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(languages)]
    counted = words.select("word", "counts").mapInArrow(count, "piece int, counts array<double>").groupBy("piece").agg(*each)
    return counted.select("piece", F.array(*[f"n{k}" for k in range(languages)]).alias("counts"))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    words: list[bytes]
    scores: np.ndarray


def learn(docs: DataFrame, vocabulary_path: str, *, rounds: int = ROUNDS, known: int = KNOWN_WORDS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Piece probabilities by language, and the scores of the most frequent words."""
    found = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].alias("lang")).distinct().limit(MAX_LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in found)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different values of {lang_col}")
    own = vocabulary(vocabulary_path)
    if not languages:
        return Model([], np.zeros((own.size + 1, 0)), [], np.zeros((0, 0)))
    with scratch(docs.sparkSession):
        words = staged(word_counts(docs, languages, text_col=text_col, lang_col=lang_col), "language-words")
        table = None
        for _ in range(rounds + 1):
            table = _piece_table(count_pieces(words, vocabulary_path, len(languages), table), own.size + 1, len(languages))
        top = words.filter(F.length("word") <= KNOWN_BYTES).orderBy(F.desc("total"), "word").limit(known).select("word")
        sent = words.sparkSession.sparkContext.broadcast(table)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = vocabulary(vocabulary_path)
            for batch in batches:
                logs = scored_words([spelled(w) for w in batch.column("word").to_pylist()], own, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(list(logs), pa.list_(pa.float64()))], names=["word", "scores"])

        scored = top.repartition(16).mapInArrow(score, "word binary, scores array<double>").toArrow()
    return Model(languages, table, scored.column("word").to_pylist(), np.array(scored.column("scores").to_pylist(), dtype=np.float64).reshape(-1, len(languages)))


class Scorer:
    def __init__(self, vocabulary_path: str, model: Model) -> None:
        self.own, self.model = vocabulary(vocabulary_path), model
        self.rows = {w: k for k, w in enumerate(model.words)}
        self.scores = model.scores if len(model.words) else np.zeros((1, model.table.shape[1]))  # doubled when full

    def totals(self, words: list[list[bytes]]) -> list[np.ndarray]:
        """Log likelihood of every text's words, by language."""
        rows, known = self.rows, len(self.model.words)
        if len(rows) > known + CACHE_WORDS:
            rows = self.rows = dict(itertools.islice(rows.items(), known))
        missing = list({w for own in words for w in own if w not in rows})
        base = len(rows)
        while base + len(missing) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[base : base + len(missing)] = scored_words([spelled(w) for w in missing], self.own, self.model.table)
        rows.update((w, base + k) for k, w in enumerate(missing))
        get = rows.__getitem__
        return [self.scores[np.fromiter(map(get, own), dtype=np.int64, count=len(own))].sum(axis=0) for own in words]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, vocabulary_path: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep`'s columns in a struct `record`, lang_pred and score."""
    spark = prepare(docs.sparkSession)
    languages = model.languages
    sent = spark.sparkContext.broadcast(model)
    kept = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("record"), docs[text_col].alias("text"))
    schema = rows.select("record").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary_path, sent.value)
        for batch in batches:
            words = [letter_words(t or "") for t in batch.column("text").to_pylist()]
            found, scores = [], []
            for own, total in zip(words, scorer.totals(words)):
                if not languages or not has_letter(own):
                    found.append(UNDETERMINED), scores.append(0.0)
                    continue
                best = int(np.argmax(total))
                found.append(languages[best])
                scores.append(1 / math.fsum(np.exp(total - total[best])))
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["record", "lang_pred", "score"])
        del scorer
        release_memory()

    return rows.mapInArrow(score, schema)
