"""Approximate nearest neighbours by balanced posting lists.

Lists are the leaves of a balanced hierarchical clustering of a bounded sample;
every vector is filed under its nearest centroid and, near a boundary, under
further ones that lie in other directions (replicas).  Centroids are searched
by a graph in the memory of each task.  A query reads all lists whose centroid
is at most `ratio` times as far as its nearest one; the ratio is the smallest
that finds enough true neighbours of the sample's own vectors, so easy data
read few lists and hard data many.  What the lists hold is scored exactly.

Nearness is the largest inner product.  For the choice of lists it is turned
into a distance: a further component fills every vector up to the largest
norm, queries are scaled to that norm.  Scores are sums of products in double
precision, component by component from the first on, over the given vectors.

Scale: equal vectors are one entry with its k + 1 smallest identifiers, which
loses no result, so copies cost nothing.  Lists are packed into groups of a
bounded number of rows, long lists cut into several; a task holds one group and
queries stream past it.  A query meets a group at most once.  Only the sample,
centroids, their graph and list sizes are on the driver, bounded in bytes.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without identifier and vectors of another
length than the commonest (the smaller of two equally common).  Of a query
identifier with several vectors the smallest asks; a candidate with several
counts by its best.  An empty table gives an empty table; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import prepare, scratch, staged

#: The sample that centroids are fitted on: at most so many vectors and bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 262_144, 64 << 20
#: Vectors a list is meant to hold; the sample has at least LIST_SAMPLE for each list.
LIST_ROWS, LIST_SAMPLE = 256, 16
#: A vector has at most so many replicas, under centroids at most CLOSE times as far as the nearest.
REPLICAS, CLOSE = 3, 1.1
#: Links of a centroid, entry points and least breadth of the graph search.
DEGREE, PIVOTS, BEAM = 24, 64, 8
#: The share of the sample's true neighbours that the lists read must hold, the queries that measure it, and the ratios tried.
RECALL, PROBES = 0.97, 256
RATIOS = (1.02, 1.05, 1.1, 1.15, 1.2, 1.25, 1.3, 1.4, 1.5, 1.75, 2.0, 3.0)
#: Rows that a task holds at once, and queries scored together.
GROUP_ROWS, QUERY_ROWS = 16_384, 128


def _clusters(points: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Index arrays of at most `most` points; neighbours in the list are siblings."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        members = stack.pop()
        if len(members) <= most:
            out.append(members)
            continue
        k = min(8, -(-len(members) // most))
        x = points[members]
        centres = x[rng.choice(len(x), k, replace=False)].copy()
        toll = np.zeros(k, np.float32)
        for _ in range(8):
            far = (centres * centres).sum(1) - 2 * (x @ centres.T)
            spread = far.std() + 1e-12
            label = np.argmin(far + toll, axis=1)
            size = np.bincount(label, minlength=k)
            # full clusters get dearer
            toll += (0.3 * spread * (size * k / len(x) - 1)).astype(np.float32)
            for j in np.flatnonzero(size):
                centres[j] = x[label == j].mean(0)
        if size.max() > 0.9 * len(x):
            stack.extend(np.array_split(members[np.argsort(x[:, 0], kind="stable")], k))
        else:
            stack.extend(members[label == j] for j in np.flatnonzero(size))
    return out


@dataclass
class Centroids:
    """Centroids with their graph, and how lists are packed into groups."""

    points: np.ndarray
    links: np.ndarray
    pivots: np.ndarray
    norm: float
    ratio: float = 1.0
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    @staticmethod
    def of(points: np.ndarray, norm: float) -> Centroids:
        n = len(points)
        degree = min(DEGREE, n - 1)
        square = (points * points).sum(1)
        # siblings are linked as well, which connects the graph
        links = np.empty((n, degree + 2), np.int32)
        links[:, 0], links[:, 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n
        for at in range(0, n if degree else 0, 1024):
            far = square - 2 * (points[at : at + 1024] @ points.T)
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            links[at : at + 1024, 2:] = np.argpartition(far, degree - 1, axis=1)[:, :degree]
        return Centroids(points, links, np.unique(np.linspace(0, n - 1, min(n, PIVOTS)).astype(np.int64)), norm)

    def filled(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that fills them up to the norm."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)

    def asking(self, q: np.ndarray) -> np.ndarray:
        """Queries, scaled to the norm."""
        q = q * (self.norm / np.maximum(np.sqrt((q * q).sum(1)), 1e-300))[:, None]
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)

    def near(self, x: np.ndarray, ratio: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, squared distance) of what a search of the graph from the pivots visits, by row and distance.

        A row's search goes on from every centroid among its `beam` nearest or
        at most `ratio` times as far as the nearest, until there is none left.
        """
        b, k = len(x), len(self.points)
        square, own = (self.points * self.points).sum(1), (x * x).sum(1)
        row, node = np.repeat(np.arange(b), len(self.pivots)), np.tile(self.pivots, b)
        far = np.maximum(own[:, None] + square[self.pivots] - 2 * (x @ self.points[self.pivots].T), 0).ravel()
        seen = np.zeros((b, k), bool)
        seen[:, self.pivots] = True
        done = np.zeros(len(row), bool)
        while True:
            order = np.lexsort((far, row))
            row, node, far, done = row[order], node[order], far[order], done[order]
            start = np.searchsorted(row, np.arange(b + 1))
            reach = np.maximum(far[start[:-1]] * ratio * ratio, far[np.minimum(start[:-1] + beam, start[1:]) - 1])
            go = ~done & (far <= reach[row])
            if not go.any():
                return row, node, far
            done |= go
            r, c = np.repeat(row[go], self.links.shape[1]), self.links[node[go]].ravel()
            fresh = ~seen[r, c]
            r, c = np.divmod(np.unique(r[fresh] * k + c[fresh]), k)
            seen[r, c] = True
            d = np.concatenate([np.einsum("ij,ij->i", x[r[i : i + 65536]], self.points[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0, np.float32)])
            row, node, done = np.concatenate([row, r]), np.concatenate([node, c]), np.concatenate([done, np.zeros(len(r), bool)])
            far = np.concatenate([far, np.maximum(own[r] + square[c] - 2 * d, 0)])

    def filed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every vector's lists: the nearest, and others near it that are not behind one taken."""
        row, node, far = self.near(x, CLOSE)
        start = np.searchsorted(row, np.arange(len(x)))
        place = np.arange(len(row)) - start[row]
        taken = place == 0
        count = np.ones(len(x), np.int64)
        for p in range(1, BEAM):
            at = np.flatnonzero((place == p) & (far <= CLOSE * CLOSE * far[start[row]]) & (count[row] < REPLICAS))
            free = np.ones(len(at), bool)
            for back in range(1, p + 1):
                step = self.points[node[at]] - self.points[node[at - back]]
                free &= ~taken[at - back] | ((step * step).sum(1) > far[at])
            taken[at[free]] = True
            count[row[at[free]]] += 1
        return row[taken], node[taken]

    def batches(self, n: int) -> Iterator[slice]:
        step = max(8, min(256, (1 << 20) // len(self.points)))
        return (slice(i, i + step) for i in range(0, n, step))


def fit(sample: np.ndarray, norm: float, lists: int, k: int) -> Centroids:
    """Centroids of the sample's clusters, with the ratio that finds RECALL of its own vectors' neighbours."""
    rng = np.random.default_rng(13)
    base = Centroids(sample[:0], sample[:0], sample[:0], norm)
    full = base.filled(sample)
    leaves = _clusters(full, max(1, -(-len(full) // lists)), rng)
    index = Centroids.of(np.stack([full[m].mean(0) for m in leaves]), norm)
    if len(leaves) == 1:
        return index
    filed = [index.filed(full[s]) for s in index.batches(len(full))]
    row = np.concatenate([r + s.start for (r, _), s in zip(filed, index.batches(len(full)))])
    lst = np.concatenate([c for _, c in filed])
    start = np.searchsorted(row, np.arange(len(full) + 1))
    need = []
    for q in np.array_split(rng.choice(len(full), min(PROBES, len(full)), replace=False), 8):
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(-score, min(k, len(full) - 1) - 1, axis=1)[:, : min(k, len(full) - 1)]
        asking = index.asking(sample[q].astype(np.float64))
        far = np.sqrt(np.maximum((asking * asking).sum(1)[:, None] + (index.points**2).sum(1) - 2 * (asking @ index.points.T), 0))
        far /= np.maximum(far.min(1, keepdims=True), 1e-12)
        # the ratio from which on a neighbour is found is that of its nearest list
        need.extend(far[i, lst[start[j] : start[j + 1]]].min() for i in range(len(q)) for j in best[i])
    need = np.array(need)
    index.ratio = next((r for r in RATIOS if (need <= r).mean() >= RECALL), float("inf"))
    return index


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _packed(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _unpacked(column: pa.Array, dtype, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


_FILED = pa.schema([("list", pa.int32()), ("cls", pa.int64()), ("ids", pa.list_(pa.int64())), ("vector", pa.binary())])
_ASKED = pa.schema([("grp", pa.int32()), ("key", pa.binary()), ("vector", pa.binary())])
_FOUND = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


@dataclass
class Index:
    """Posting lists of `vectors`, as a table (list, cls, ids, vector), with their centroids."""

    lists: DataFrame | None
    centroids: Centroids | None
    dim: int
    dtype: type
    k: int

    def search(self, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest of every query but itself."""
        spark = prepare(queries.sparkSession)
        nothing = "query_id long, rank int, vec_id long, score double"
        if self.lists is None:
            return spark.createDataFrame([], nothing)
        centroids, dim, dtype, k = spark.sparkContext.broadcast(self.centroids), self.dim, self.dtype, self.k

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = centroids.value
            for batch in batches:
                x = _packed(batch.column("v"), dim)
                for s in index.batches(len(x)):
                    row, node, far = index.near(index.asking(x[s].astype(np.float64)), index.ratio)
                    start = np.searchsorted(row, np.arange(len(x[s])))
                    read = far <= far[start][row] * index.ratio**2
                    row, node = row[read], node[read]
                    again = np.repeat(np.arange(len(row)), index.parts[node])
                    part = np.arange(len(again)) - np.repeat(np.cumsum(index.parts[node]) - index.parts[node], index.parts[node])
                    row, group = np.divmod(np.unique(row[again] * (1 << 32) + index.first[node[again]] + part), 1 << 32)
                    key, vector = batch.column("key")[s.start : s.stop].to_pylist(), [v.tobytes() for v in x[s].astype(dtype)]
                    for at in range(0, len(row), 4000):
                        r = row[at : at + 4000]
                        yield pa.RecordBatch.from_arrays([pa.array(group[at : at + 4000], pa.int32()), pa.array([key[i] for i in r], pa.binary()), pa.array([vector[i] for i in r], pa.binary())], schema=_ASKED)

        with scratch(spark):
            asking = _rows(queries, id_col, vector_col, dim).groupBy("id").agg(F.min("v").alias("v"))
            asking = staged(asking.withColumn("key", F.unhex(F.sha2(F.col("v").cast("string"), 256))), "asking", result=True)
            asked = asking.select("key", "v").distinct().mapInArrow(ask, "grp int, key binary, vector binary")
            none = F.lit(None).cast("long")
            first, parts = (F.array(*[F.lit(int(n)) for n in a]) if len(a) <= 64 else None for a in (self.centroids.first, self.centroids.parts))
            if first is None:
                where = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(self.centroids.first, self.centroids.parts))], "list int, first int, parts int")
                filed = self.lists.join(F.broadcast(where), "list")  # at most SAMPLE_ROWS / LIST_SAMPLE rows
            else:
                filed = self.lists.withColumn("first", first[F.col("list")]).withColumn("parts", parts[F.col("list")])
            group = (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))).cast("int")
            held = filed.select(group.alias("grp"), F.lit(0).alias("kind"), "cls", "ids", F.lit(None).cast("binary").alias("key"), "vector")
            asks = asked.select("grp", F.lit(1).alias("kind"), none.alias("cls"), F.lit(None).cast("array<bigint>").alias("ids"), "key", "vector")
            both = held.unionByName(asks).repartition("grp").sortWithinPartitions("grp", "kind")
            found = both.mapInArrow(_scorer(dim, dtype, k), "key binary, ids array<bigint>, scores array<double>")
            best = found.repartition("key").sortWithinPartitions("key").mapInArrow(_merger(k), "key binary, ids array<bigint>, scores array<double>")
            best = staged(best, "nearest", result=True)
        pairs = F.filter(F.arrays_zip("ids", "scores"), lambda p: p["ids"] != F.col("id"))
        ranked = asking.select("id", "key").join(best, "key").select("id", F.posexplode(F.slice(pairs, 1, k)).alias("at", "pair"))
        return ranked.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("pair.ids").alias("vec_id"), F.col("pair.scores").alias("score"))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed from the first component on."""
    return np.concatenate([np.add.accumulate(q[i : i + 8192] * v[i : i + 8192], axis=1)[:, -1] for i in range(0, len(q), 8192)])


def _scorer(dim: int, dtype: type, k: int) -> Callable:
    """Every query's k + 1 best identifiers in each group; the group's vectors come before its queries."""

    def score(held: np.ndarray, ids: list, keys: list, q: np.ndarray) -> pa.RecordBatch:
        n, q = len(held), q.astype(np.float64)
        rough = q @ held.T
        least = np.partition(rough, n - min(k + 1, n), axis=1)[:, n - min(k + 1, n)]
        slack = 1e-9 * np.sqrt((q * q).sum(1)) * np.sqrt((held * held).sum(1).max())
        out: tuple[list, list] = ([], [])
        for i in range(len(q)):
            c = np.flatnonzero(rough[i] >= least[i] - slack[i])
            exact = _scores(np.broadcast_to(q[i], (len(c), dim)), held[c])
            own = [ids[j] for j in c]
            flat, said = np.concatenate(own), np.repeat(exact, [len(o) for o in own])
            order = np.lexsort((flat, -said))[: k + 1]
            out[0].append(flat[order])
            out[1].append(said[order])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out[0], _FOUND.types[1]), pa.array(out[1], _FOUND.types[2])], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, held, ids, cls = None, [], None, [], []
        for batch in batches:
            code = batch.column("grp").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            for at, stop in zip(*[np.concatenate(p) for p in (([0], np.flatnonzero(np.diff(code)) + 1), (np.flatnonzero(np.diff(code)) + 1, [len(code)]))]):
                piece = batch.slice(at, stop - at)
                if code[at] >> 1 != group:
                    group, blocks, held, ids, cls = code[at] >> 1, [], None, [], []
                if code[at] & 1 == 0:
                    blocks.append(_unpacked(piece.column("vector"), dtype, dim))
                    ids.extend(np.array(i, np.int64) for i in piece.column("ids").to_pylist())
                    cls.extend(piece.column("cls").to_pylist())
                    continue
                if not blocks:
                    continue
                if held is None:
                    one = np.unique(np.array(cls), return_index=True)[1]  # replicas in one group are one
                    held, ids = np.concatenate(blocks)[one].astype(np.float64), [ids[j] for j in one]
                q, keys = _unpacked(piece.column("vector"), dtype, dim), piece.column("key").to_pylist()
                for i in range(0, len(q), QUERY_ROWS):
                    yield score(held, ids, keys[i : i + QUERY_ROWS], q[i : i + QUERY_ROWS])

    return run


def _merger(k: int) -> Callable:
    """The k + 1 best identifiers of each key from rows sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, scores = None, np.zeros(0, np.int64), np.zeros(0)
        out: list[tuple] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOUND.types)], schema=_FOUND)
                out.clear()

        for batch in batches:
            for own, more, said in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), batch.column("scores").to_pylist()):
                if own != key:
                    if key is not None:
                        out.append((key, ids, scores))
                        if len(out) == 1000:
                            yield from flushed()
                    key, ids, scores = own, np.zeros(0, np.int64), np.zeros(0)
                ids, scores = np.concatenate([ids, np.array(more, np.int64)]), np.concatenate([scores, np.array(said)])
                order = np.lexsort((ids, -scores))
                ids, scores = ids[order], scores[order]
                once = np.sort(np.unique(ids, return_index=True)[1])[: k + 1]
                ids, scores = ids[once], scores[once]
        if key is not None:
            out.append((key, ids, scores))
        yield from flushed()

    return run


def _rows(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).filter(F.col("id").isNotNull() & _valid(F.col("v")))
    return rows if dim is None else rows.filter(F.size("v") == dim)


def build_index(vectors: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS, group_rows: int = GROUP_ROWS) -> Index:
    """Posting lists for searches of the k nearest."""
    spark = prepare(vectors.sparkSession)
    double = isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType)
    dtype = np.float64 if double else np.float32
    rows = _rows(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return Index(None, None, 0, dtype, k)
    dim = common["dim"]
    with scratch(spark):
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        smallest = _rows(vectors, id_col, vector_col, dim).distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
        classes = staged(smallest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cls", F.monotonically_increasing_id()), "classes")
        norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, largest = classes.agg(F.count("*"), F.max(norm2)).first()
        wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * dim)))
        share = max(1, -(-n // wanted))
        sample = _packed(classes.filter(F.pmod(F.xxhash64("v"), F.lit(share)) == 0).select("v").toArrow().column("v").combine_chunks(), dim).astype(np.float32)
        if not len(sample):  # fewer rows than one share
            sample = _packed(classes.limit(1).select("v").toArrow().column("v").combine_chunks(), dim).astype(np.float32)
        lists = max(1, min(n // list_rows, len(sample) // LIST_SAMPLE))
        index = fit(sample, float(np.sqrt(largest)), lists, k)
        sent = spark.sparkContext.broadcast(index)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = sent.value
            for batch in batches:
                x = _packed(batch.column("v"), dim)
                for s in centroids.batches(len(x)):
                    row, lst = centroids.filed(centroids.filled(x[s].astype(np.float64)))
                    at = pa.array(row + s.start)
                    vector = pa.array([v.tobytes() for v in x[s][row].astype(dtype)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(lst, pa.int32()), batch.column("cls").take(at), batch.column("ids").take(at).cast(_FILED.types[2]), vector], schema=_FILED)

        filed = staged(classes.mapInArrow(file, "list int, cls long, ids array<bigint>, vector binary"), "lists", result=True)
    sizes = np.zeros(len(index.points), np.int64)
    for r in filed.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    first, parts, group, load = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for i, size in enumerate(sizes):
        if load and load + size > group_rows:
            group, load = group + 1, 0
        first[i], parts[i] = group, max(1, -(-size // group_rows))
        load += size
        if parts[i] > 1:
            group, load = group + parts[i], 0
    index.first, index.parts = first, parts
    return Index(filed, index, dim, dtype, k)
