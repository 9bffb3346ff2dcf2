"""The corpus pipeline: five stages over `documents`, each of which works on all that the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents.  All stages but the last return the
columns of `documents`, extra ones included.

Defined results, for all stages: an empty table gives an empty table with the
same columns; null, empty and very long texts are judged whole, by the rule
each stage states; extra columns travel along and cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontamination, jaccard, language, mixing, tokens
from marginalia.llm.common import dropped, new_path, scratch, staged
from marginalia.llm.queries import public_tokenizer, read_tokens, table

#: A document whose best language has less than this posterior is rejected.
LEAST_SCORE = 0.5

#: SQL can't express the language model, the join's components over shingles at this size, spaced seeds or the tokenizer.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents without a letter or without a clear language go.

    Null and empty texts have no letter and go; repeated rows are judged alike;
    ties between languages go to the first by code point.  Where no document
    has a language to learn from, all go.
    """
    vocabulary = public_tokenizer("piece_bpe_32k.model")
    model = language.learn(docs.filter(~language.held_out(F.col("doc_id"))), vocabulary)
    found = language.identify(docs, model, vocabulary)
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("record.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8; of each group the smallest identifier stays.

    Null and empty texts link with nothing and stay.  Rows with the same
    identifier are one document and stay or go together; rows without one stay.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = staged(groups.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct(), "gone")
    few = gone.count() <= jaccard.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination against the benchmark table: documents that overlap a passage go.

    Null and empty texts overlap nothing and stay; passages without words match
    nothing; repeated rows are judged alike.
    """
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mixing; a document with two copies is two rows, one with none is left out.

    Null and empty texts have no words; their copies are those of their rank.
    The null source is one source.  Repeated rows are drawn one by one.
    """
    return mixing.repeated(mixing.mix_sources(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold for each document, by ascending identifier.

    Null and empty texts are an end identifier alone; a null identifier comes
    first; repeated rows (a document's copies) are documents of their own.
    """
    return read_tokens(tokens.write_tokens(docs, public_tokenizer("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            written = new_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(written)
        if path:
            dropped(spark, path)
        docs, path = spark.read.parquet(written), written
    return STAGES[-1][1](spark, docs, sf_dir)
