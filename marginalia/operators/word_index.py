"""A kept word index for BM25 over a corpus (RK1): block-max postings, written once, added to by batch, read with pruning.

Documents are dealt over blocks of about BLOCK_DOCS by a hash.  An index is a
folder with two tables, each parted by the batch that was written:

    postings  (bucket, token, block, most, shortest, docs, words, entries): for
              a token and a block the largest count and the shortest document,
              and then the documents with count and length; parted by a hash of
              the token and sorted by it, so other tokens' row groups are
              skipped.  Rows without a token have a block's documents and words
    counts    (token, df, length): documents with a token; the row without one
              has the number of documents and their words

A text's words are counted where it lies.  Its counts are shuffled once, to
tasks that each have the tokens of a bucket in FILE_BLOCKS blocks; there are
more of them as the documents grow.

A search reads no text.  From `most` and `shortest` alone, without the entries,
it bounds what a block can add to a question's score, reads the entries of each
question's most promising blocks, and takes the least score of the k best in
them.  Then it reads the entries of those other blocks whose bounds reach that
score; the rest can't matter.  A block's entries meet all questions at once:
tasks multiply its small matrix of tokens and documents by that of questions and
tokens, and pass on each question's best k.  Weights are those of all batches
together, as of the search.

Results equal `bm25_corpus` over all documents added.  A document belongs to
one batch; a batch written again replaces itself.  Texts of one identifier are
one document, but counted as often as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import tokens
from ..session import settled
from .ranking import B, BROADCAST_ROWS, EPSILON, K1, PLACES, _idf, best, term_counts

BLOCK_DOCS, BUCKETS, FILE_BLOCKS = 1024, 64, 256
#: Documents for which there is a task that writes postings; blocks that a task scores.
TASK_DOCS, TASK_BLOCKS = 2048, 8
#: Questions scored together, and tokens multiplied at once.
QUESTIONS, PRODUCT = 128, 512
#: A question's blocks that are read first; their documents give the score to beat.
FIRST_BLOCKS = 4
#: Tokens named in a filter, which skips row groups; more are joined.
NAMED = 5_000


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def add_documents(documents: DataFrame, path: str, batch: int = 0, *, block_docs: int = BLOCK_DOCS) -> None:
    """Add documents (doc_id, text) as a batch; null texts are no documents."""
    texts = documents.select("doc_id", "text").filter("text is not null")
    n = texts.count()
    blocks = max(1, -(-n // block_docs))
    rows = _counted(texts).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("bucket", _bucket(F.col("token"))).withColumn("part", (F.col("block") / FILE_BLOCKS).cast("int"))
    # a file for each bucket and FILE_BLOCKS blocks, so there are more as the documents grow
    rows = rows.repartition(max(1, -(-n // TASK_DOCS)), "bucket", "part")
    documents_in = F.sum(F.when(F.col("token").isNull(), F.col("tf")).otherwise(1))
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "tf", "dl")))
    postings = rows.groupBy("bucket", "part", "token", "block").agg(F.max("tf").alias("most"), F.min("dl").alias("shortest"), documents_in.alias("docs"), F.sum("dl").alias("words"), entries.alias("entries"))
    postings.drop("part").sortWithinPartitions("bucket", "token", "block").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings/batch={batch}")
    written = documents.sparkSession.read.parquet(f"{path}/postings/batch={batch}")
    counts = written.groupBy("token").agg(F.sum("docs").alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("words"))).alias("length"))
    counts.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def _counted(texts: DataFrame) -> DataFrame:
    """(doc_id, token, tf, dl) of each document, and a row without a token, with the texts of the identifier as tf.

    Only texts of an identifier that comes more than once meet.
    """
    again = settled(texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("again")))
    small = F.broadcast if again.count() <= BROADCAST_ROWS else (lambda df: df)
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    words = texts.join(small(again), same, "left_anti").select("doc_id", F.sort_array(tokens("text")).alias("words")).withColumn("dl", F.size("words"))
    # where a token's run begins in the sorted words, and so how long it is
    begins = F.filter(F.transform("words", lambda x, i: F.when((i == 0) | (x != F.get("words", i - 1)), i)), lambda i: i.isNotNull())
    words = words.withColumn("begins", F.array_append(begins, F.col("dl")))
    runs = F.transform(F.slice("begins", F.lit(1), F.size("begins") - 1), lambda i, j: F.struct(F.get("words", i).alias("token"), (F.get("begins", j + 1) - i).alias("tf")))
    whole = F.struct(F.lit(None).cast("string").alias("token"), F.lit(1).alias("tf"))
    one = words.select("doc_id", "dl", F.inline(F.array_append(runs, whole)))
    more = texts.join(small(again), same, "left_semi").select("doc_id", F.explode(F.array_append(tokens("text"), F.lit(None).cast("string"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").cast("int").alias("tf"))
    more = more.withColumn("dl", F.coalesce(F.sum(F.when(F.col("token").isNotNull(), F.col("tf"))).over(Window.partitionBy("doc_id")), F.lit(0)).cast("int"))
    return one.unionByName(more)


def _weights(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(qid, token, qtf, idf, avgdl) of the asked tokens that some document has."""
    counts = spark.read.parquet(f"{path}/counts").groupBy("token").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    sums = counts.filter("token is null").select(F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl"))
    raw = counts.filter("token is not null").select("token", "df").crossJoin(F.broadcast(sums)).withColumn("raw", _idf(F.col("df"), F.col("n")))
    mean = raw.agg(F.avg("raw").alias("mean"))  # over the whole vocabulary
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return asked.join(raw, "token").crossJoin(F.broadcast(mean)).select("qid", "token", "qtf", idf.alias("idf"), "avgdl")


def _part(tf: Column, dl: Column) -> Column:
    return F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))


def _best_of_block(rows: list[pa.RecordBatch], k: int) -> pa.RecordBatch | None:
    """(qid, doc_id, score) of the best k of one block's documents, for each question that wants the block.

    Rows have a token's askers (qid, weight) and entries; those without a token
    have the questions that want the block.
    """
    token, wanted, askers, entries = (pa.concat_arrays([r.column(name) for r in rows]) for name in ("token", "wanted", "askers", "entries"))
    mark = pc.is_null(token)
    questions = pc.unique(pc.list_flatten(wanted.filter(mark)))
    known = pc.invert(mark)
    askers, entries = askers.filter(known), entries.filter(known)
    if not len(questions) or not len(entries):
        return None
    asks, found = pc.list_flatten(askers), pc.list_flatten(entries)
    of = pc.fill_null(pc.index_in(asks.field("qid"), questions), -1).to_numpy(zero_copy_only=False)
    weight, avgdl = asks.field("weight").to_numpy(), pc.max(pa.concat_arrays([r.column("avgdl") for r in rows])).as_py()
    coded = found.field("doc_id").dictionary_encode(null_encoding="encode")
    place, ids = coded.indices.to_numpy(), coded.dictionary
    tf, dl = found.field("tf").to_numpy().astype(float), found.field("dl").to_numpy()
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    ask_at = np.concatenate([[0], np.cumsum(pc.list_value_length(askers).to_numpy())])
    entry_at = np.concatenate([[0], np.cumsum(pc.list_value_length(entries).to_numpy())])
    score, shared = np.zeros((len(questions), len(ids))), np.zeros((len(questions), len(ids)), bool)
    for at in range(0, len(entries), PRODUCT):
        to = min(at + PRODUCT, len(entries))
        own, here = slice(ask_at[at], ask_at[to]), slice(entry_at[at], entry_at[to])
        left, right = np.zeros((len(questions), to - at)), np.zeros((to - at, len(ids)))
        row, asked = np.repeat(np.arange(to - at), np.diff(ask_at[at : to + 1])), of[own]
        left[asked[asked >= 0], row[asked >= 0]] = weight[own][asked >= 0]
        right[np.repeat(np.arange(to - at), np.diff(entry_at[at : to + 1])), place[here]] = part[here]
        score += left @ right
        if (weight[own] <= 0).any():  # else a score tells that a token is shared
            left[:] = 0
            left[asked[asked >= 0], row[asked >= 0]] = 1
            shared |= left @ (right > 0) > 0
    shared |= score > 0
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    kept = []
    for q in range(len(questions)):
        docs = np.flatnonzero(shared[q])
        rounded = np.floor(score[q, docs] * 10.0**PLACES + 0.5)
        if len(docs) > k:
            some = rounded >= np.partition(rounded, -k)[-k]
            docs, rounded = docs[some], rounded[some]
            docs = docs[np.lexsort((order[docs], -rounded))[:k]]
        kept.append(docs)
    row, col = np.repeat(np.arange(len(questions)), [len(d) for d in kept]), np.concatenate(kept)
    return pa.RecordBatch.from_arrays([questions.take(pa.array(row)), ids.take(pa.array(col)), pa.array(score[row, col])], names=["qid", "doc_id", "score"])


def _by_block(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in ("part", "batch", "block")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, end in pairwise(cuts):
                key = tuple(keys[:, start])
                if key != own:
                    if held and (out := _best_of_block(held, k)):
                        yield out
                    held, own = [], key
                held.append(batch.slice(start, end - start))
        if held and (out := _best_of_block(held, k)):
            yield out

    return scored


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 10) -> DataFrame:
    """(qid, doc_id, score, rank) of the best k that share a token with each question (qid, text)."""
    asked = settled(_weights(spark, path, term_counts(questions, "qid").withColumnRenamed("tf", "qtf")))
    rows = asked.count()
    small = F.broadcast if rows <= BROADCAST_ROWS else (lambda df: df)
    postings = spark.read.parquet(f"{path}/postings")
    named = [r["token"] for r in asked.select("token").distinct().limit(NAMED + 1).collect()]
    if len(named) <= NAMED:
        buckets = [r["b"] for r in asked.select(_bucket(F.col("token")).alias("b")).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(buckets) & F.col("token").isin(named))
    # the bounds: no entries are read
    bound = F.greatest(_part(F.col("most"), F.col("shortest")), F.lit(0.0))
    bounds = settled(postings.select("batch", "block", "token", "most", "shortest").join(small(asked), "token").groupBy("qid", "batch", "block").agg(F.sum(bound).alias("bound")))
    first = bounds.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "batch", "block"))).filter(F.col("place") <= FIRST_BLOCKS).select("qid", "batch", "block")

    parts = max(1, -(-asked.select("qid").distinct().count() // QUESTIONS))
    part = F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part")
    askers = settled(asked.groupBy(part, "token").agg(F.collect_list(F.struct("qid", (F.col("qtf") * F.col("idf")).cast("double").alias("weight"))).alias("askers"), F.first("avgdl").alias("avgdl")))
    qid, doc_id = asked.schema["qid"].dataType, postings.schema["entries"].dataType.elementType["doc_id"].dataType
    result = StructType([StructField("qid", qid), StructField("doc_id", doc_id), StructField("score", DoubleType())])

    def scored(blocks: DataFrame) -> DataFrame:
        """Whole scores of the best documents in the blocks of each question."""
        wanted = settled(blocks.groupBy(part, "batch", "block").agg(F.collect_list("qid").alias("wanted")))
        n = wanted.count()
        keys, few = ["part", "batch", "block"], F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
        rows = postings.select("batch", "block", "token", "entries").join(small(askers), "token").join(few(wanted.select(*keys)), keys, "left_semi")
        rows = rows.unionByName(wanted, allowMissingColumns=True).repartition(max(1, -(-n // TASK_BLOCKS)), *keys).sortWithinPartitions(*keys)
        return rows.mapInArrow(_by_block(k), result).withColumn("score", F.round("score", PLACES)).withColumn("pos", F.col("doc_id"))

    early = settled(best(scored(first), k))
    least = early.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    rest = bounds.join(first, ["qid", "batch", "block"], "left_anti").join(small(least), "qid", "left")
    rest = settled(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)).select("qid", "batch", "block"))
    late = best(scored(rest), k)
    return best(early.select("qid", "doc_id", "score", "pos").unionByName(late.select("qid", "doc_id", "score", "pos")), k).select("qid", "doc_id", "score", "rank")
