"""A kept vector index for ranking over the whole corpus (RK2-RK5): cells with residual product codes, exact re-ranking, and an exact scan.

Vectors are filed under the nearest of a bounded number of centroids (cells).
What a vector differs from its centroid by is coded with a byte for each of
PARTS stretches of its components: the nearest of 256 code words.  A question
reads the codes of its `probes` best cells, which score by table look-up, and
the `keep` best of all are scored exactly from their vectors.  An index is a
folder with two tables:

    model     centroids, code words and cell sizes
    vectors   (cell, doc_id, code, embedding), sorted by cell; a search reads
              the codes of cells, and embeddings of the kept rows only

Centroids and code words are fitted on a sample of bounded size; every vector
is filed.  A cell's codes are held by one task in groups of GROUP_ROWS; the
questions that read it stream past.  `probes` and `keep` are fitted to the
sample: what finds FOUND of the ten nearest of some of its vectors.  Scores are inner products in double
precision, of vectors of one length; null vectors take no part.

`exact` gives the same rows by a scan: tasks hold the questions, MOST_QUESTIONS
at a time, and their best scores so far, and vectors stream past in small blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled
from .ranking import PLACES, best, dot

SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
CELL_ROWS, MOST_CELLS, PARTS, WORDS = 500, 4096, 16, 256
GROUP_ROWS, MOST_QUESTIONS, QUESTION_ROWS = 65_536, 20_000, 128
#: Vectors and questions that an exact scan multiplies at once (2 MB of scores).
SCAN_ROWS, SCAN_QUESTIONS = 1024, 256
#: Of the nearest, what the fitted cells and the fitted number of kept rows each have to find; least values of both, and the vectors they are fitted with.
FOUND, PROBES, KEEP, TRIED = 0.98, 16, 200, 256
#: Rows of a cell that are passed on at least, where a question reads more than PROBES cells.
CELL_KEEP = 32


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means; a centre that loses all its points takes a random one."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        label = _nearest(x, centres)
        size = np.bincount(label, minlength=k)
        for j in range(x.shape[1]):
            centres[:, j] = np.bincount(label, weights=x[:, j], minlength=k) / np.maximum(size, 1)
        lost = np.flatnonzero(size == 0)
        centres[lost] = x[rng.choice(len(x), len(lost))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)
    return np.concatenate([np.argmin(square - 2 * (x[i : i + 8192] @ centres.T), axis=1) for i in range(0, len(x), 8192)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


class Model:
    def __init__(self, centres: np.ndarray, words: list[np.ndarray]) -> None:
        self.centres, self.words = centres, words
        self.edges = np.concatenate([[0], np.cumsum([w.shape[1] for w in words])])

    def codes(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(rest[:, a:b], w) for a, b, w in zip(self.edges, self.edges[1:], self.words)], axis=1).astype(np.uint8)


def _fitted(model: Model, sample: np.ndarray, n: int, rng: np.random.Generator) -> list[float]:
    """The cells to read and the rows to keep for an index of n rows, by the nearest of some of the sample among the sample."""
    cell = _nearest(sample, model.centres)
    code = model.codes(sample - model.centres[cell])
    tried = rng.choice(len(sample), min(TRIED, len(sample)), replace=False)
    many = min(11, len(sample))
    cells, rows = [], []
    for i in range(0, len(tried), 32):
        q = sample[tried[i : i + 32]]
        true = np.argpartition(-(q @ sample.T), many - 1, axis=1)[:, :many]
        near = q @ model.centres.T
        rough = near[:, cell]
        for p, words in enumerate(model.words):
            rough += (q[:, model.edges[p] : model.edges[p + 1]] @ words.T)[:, code[:, p]]
        for a, b, t in zip(near, rough, true):
            cells.extend(np.searchsorted(np.sort(-a), -a[cell[t]], side="right"))
            rows.extend(np.searchsorted(np.sort(-b), -b[t], side="right"))
    probes, keep = (float(np.quantile(x, FOUND, method="higher")) for x in (cells, rows))
    return [max(PROBES, probes), max(KEEP, np.ceil(keep * max(1.0, n / len(sample))))]


def write_index(vectors: DataFrame, path: str, *, cells: int | None = None, parts: int = PARTS) -> None:
    """File vectors (doc_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select("doc_id", "embedding").filter("embedding is not null and size(embedding) > 0")
    n, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("no vectors to index")
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(-(-n // wanted))) == 0).select("embedding").toArrow().column("embedding").combine_chunks()
    sample = _matrix(chosen if len(chosen) else rows.limit(1).select("embedding").toArrow().column("embedding").combine_chunks())
    rng = np.random.default_rng(7)
    k = max(1, min(cells or n // CELL_ROWS, MOST_CELLS, len(sample)))
    centres = _means(sample, k, rng)
    rest = sample - centres[_nearest(sample, centres)]
    edges = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
    model = Model(centres, [_means(rest[:, a:b], min(WORDS, len(rest)), rng) for a, b in zip(edges, edges[1:])])
    sent = spark.sparkContext.broadcast(model)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                cell = _nearest(x, own.centres)
                code = own.codes(x - own.centres[cell])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("doc_id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding")], names=["cell", "doc_id", "code", "embedding"])

    kinds = dict(rows.dtypes)
    filed = rows.mapInArrow(file, f"cell int, doc_id {kinds['doc_id']}, code binary, embedding {kinds['embedding']}")
    filed.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/vectors")
    sizes = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").count().collect()}  # a row a cell
    tables = [("centres", i, c.tolist() + [float(sizes.get(i, 0))]) for i, c in enumerate(centres)] + [(f"words{p:04d}", i, w.tolist()) for p, own in enumerate(model.words) for i, w in enumerate(own)]
    tables.append(("search", 0, [float(x) for x in _fitted(model, sample, n, rng)]))
    spark.createDataFrame(tables, "name string, at int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def _model(spark: SparkSession, path: str) -> tuple[Model, np.ndarray, list[int]]:
    tables: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/model").orderBy("name", "at").collect():  # bounded by MOST_CELLS and WORDS
        tables.setdefault(r["name"], []).append(r["values"])
    centres, fitted = np.array(tables.pop("centres")), tables.pop("search", [[PROBES, KEEP]])[0]
    return Model(centres[:, :-1], [np.array(tables[name]) for name in sorted(tables)]), centres[:, -1].astype(np.int64), [int(x) for x in fitted]


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 10, *, probes: int | None = None, keep: int | None = None, itself: bool = True) -> DataFrame:
    """(qid, doc_id, score, rank) of the k best found for questions (qid, embedding); without `itself` not the document of the question's own number.

    `probes` and `keep` are the fitted ones unless given.
    """
    model, sizes, fitted = _model(spark, path)
    probes = probes or fitted[0]
    of_cell = keep or (fitted[1] if probes <= PROBES else max(CELL_KEEP, fitted[1] * PROBES // probes))
    keep = keep or fitted[1]
    groups = np.maximum(1, -(-sizes // GROUP_ROWS))
    sent = spark.sparkContext.broadcast((model, groups))
    asked = questions.select(F.col("qid").cast("long").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).filter("embedding is not null")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("embedding"))
            score = q @ own.centres.T
            n = min(probes, score.shape[1])
            cell = np.argpartition(-score, n - 1, axis=1)[:, :n]
            row, cell = np.repeat(np.arange(len(q)), n), cell.ravel()
            again = np.repeat(np.arange(len(row)), parts[cell])
            salt = np.arange(len(again)) - np.repeat(np.cumsum(parts[cell]) - parts[cell], parts[cell])
            row, cell = row[again], cell[again]
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(salt, pa.int32()), batch.column("qid").take(pa.array(row)), pa.array([v.tobytes() for v in q[row]], pa.binary())], names=["cell", "salt", "qid", "question"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = sent.value
        now, codes, ids = None, [], []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "salt", "kind")])
            cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                cell, salt, kind = key[:, a]
                piece = batch.slice(a, b - a)
                if (cell, salt) != now:
                    now, codes, ids = (cell, salt), [], []
                if kind == 0:
                    codes.append(np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(len(piece), -1))
                    ids.append(piece.column("doc_id").to_numpy())
                    continue
                if not codes:
                    continue
                held, names = np.concatenate(codes), np.concatenate(ids)
                codes, ids = [held], [names]
                q = np.frombuffer(b"".join(piece.column("question").to_pylist()), np.float64).reshape(len(piece), -1)
                for at in range(0, len(q), QUESTION_ROWS):
                    some = q[at : at + QUESTION_ROWS]
                    score = np.repeat((some @ own.centres[cell])[:, None], len(held), axis=1)
                    for p, words in enumerate(own.words):
                        score += (some[:, own.edges[p] : own.edges[p + 1]] @ words.T)[:, held[:, p]]
                    n = min(of_cell, len(held))
                    top = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    qids = piece.column("qid").slice(at, len(some)).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(np.full(top.size, cell, np.int32)), pa.array(names[top.ravel()]), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["qid", "cell", "doc_id", "rough"])

    table = spark.read.parquet(f"{path}/vectors")
    salted = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), F.col("cell") + 1) if groups.max() > 1 else F.lit(1)
    null = F.lit(None)
    held = table.select("cell", F.pmod(F.xxhash64("doc_id"), salted).cast("int").alias("salt"), F.lit(0).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), "code", null.cast("long").alias("qid"), null.cast("binary").alias("question"))
    ask_rows = asked.mapInArrow(ask, "cell int, salt int, qid long, question binary").select("cell", "salt", F.lit(1).alias("kind"), null.cast("long").alias("doc_id"), null.cast("binary").alias("code"), "qid", "question")
    both = held.unionByName(ask_rows).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    rough = both.mapInArrow(scan, "qid long, cell int, doc_id long, rough double")
    if not itself:
        rough = rough.filter("qid <> doc_id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rough"), "doc_id"))
    kept = settled(rough.withColumn("place", place).filter(F.col("place") <= keep).select("qid", "cell", "doc_id"))
    exact_rows = kept.join(table.select("cell", F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").alias("dv")), ["cell", "doc_id"]).join(asked.withColumnRenamed("embedding", "qv"), "qid")
    scores = exact_rows.select("qid", "doc_id", F.col("doc_id").alias("pos"), F.round(dot("qv", "dv"), PLACES).alias("score"))
    return best(scores, k).select("qid", "doc_id", "score", "rank")


def exact(vectors: DataFrame, questions: DataFrame, k: int = 10, *, itself: bool = True) -> DataFrame:
    """The k best of all vectors (doc_id, embedding): a scan for every MOST_QUESTIONS questions."""
    spark = vectors.sparkSession
    asked = questions.select(F.col("qid").cast("long").alias("qid"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).filter("embedding is not null")
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").filter("embedding is not null and size(embedding) > 0")
    blocks = max(1, -(-asked.count() // MOST_QUESTIONS))
    found = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()  # MOST_QUESTIONS or so
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast((own.column("qid").to_numpy(), _matrix(own.column("embedding").combine_chunks())))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            # each question's k best scores so far in this task: what is below them can't be among its best
            held = np.full((len(q), k), -np.inf)
            for batch in batches:
                for start in range(0, batch.num_rows, SCAN_ROWS):
                    piece = batch.slice(start, SCAN_ROWS)
                    ids, x = piece.column("doc_id").to_numpy(), _matrix(piece.column("embedding"))
                    for at in range(0, len(q), SCAN_QUESTIONS):
                        own = slice(at, at + SCAN_QUESTIONS)
                        score = q[own] @ x.T
                        if not itself:
                            score[qids[own, None] == ids] = -np.inf
                        held[own] = np.partition(np.hstack([held[own], score]), -k, axis=1)[:, -k:]
                        # ties at the border are all passed on
                        row, col = np.nonzero((score >= held[own].min(axis=1, keepdims=True) - 10.0**-PLACES) & (score > -np.inf))
                        if len(row):
                            yield pa.RecordBatch.from_arrays([pa.array(qids[own][row]), pa.array(ids[col]), pa.array(score[row, col])], names=["qid", "doc_id", "score"])

        found.append(rows.mapInArrow(scan, "qid long, doc_id long, score double"))
    if not found:
        return spark.createDataFrame([], "qid long, doc_id long, score double, rank int")
    scores = reduce(DataFrame.unionByName, found).withColumn("score", F.round("score", PLACES)).withColumn("pos", F.col("doc_id"))
    return best(scores, k).select("qid", "doc_id", "score", "rank")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(n, share): of the true neighbours (qid, doc_id) the share found."""
    hit = found.select("qid", "doc_id", F.lit(1).alias("hit"))
    return true.select("qid", "doc_id").join(hit, ["qid", "doc_id"], "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
