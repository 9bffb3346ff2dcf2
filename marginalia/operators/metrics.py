"""Retrieval metrics (MT1-MT5), their means (AG14, AG15) and skip counters (AG16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("hit1", "hit5", "hit10", "recall5", "recall10", "mrr", "ndcg10")


def ideal_gain(n: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def per_question(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """MT5: a row a question with all metrics; rankings have 0-based ranks, gold is (qid, doc_id)."""
    sizes = gold.distinct().groupBy("qid").agg(F.count("*").alias("n_gold"))
    marked = ranking.select("qid", "doc_id", "rank").join(gold.distinct().withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    found = lambda k: F.count_if((F.col("g") == 1) & (F.col("rank") < k))
    rows = marked.groupBy("qid").agg(*[found(k).alias(f"f{k}") for k in (1, 5, 10)], F.min(F.when(F.col("g") == 1, F.col("rank"))).alias("first"), F.sum(F.when((F.col("g") == 1) & (F.col("rank") < 10), 1 / F.log2(F.col("rank") + 2.0)).otherwise(0.0)).alias("gain"), F.count("*").alias("n_haystack"))
    rows = rows.join(sizes, "qid", "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    share = lambda k: F.when(F.col("n_gold") > 0, F.col(f"f{k}") / F.col("n_gold")).otherwise(0.0)
    hit = lambda k: (F.col(f"f{k}") > 0).cast("double")
    ndcg = F.when(F.col("n_gold") > 0, F.col("gain") / ideal_gain(F.greatest(F.col("n_gold"), F.lit(1)), 10)).otherwise(0.0)
    return rows.select("qid", hit(1).alias("hit1"), hit(5).alias("hit5"), hit(10).alias("hit10"), F.round(share(5), 6).alias("recall5"), F.round(share(10), 6).alias("recall10"), F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("mrr"), F.round(ndcg, 6).alias("ndcg10"), "n_gold", "n_haystack")


def summary(rows: DataFrame) -> DataFrame:
    """AG14, AG15: means overall (qtype null) and by question type, in one pass."""
    return rows.groupingSets([[], [F.col("qtype")]], "qtype").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 9).alias(m) for m in METRICS])


def usable(questions: DataFrame, candidates: DataFrame, gold: DataFrame, texts: DataFrame) -> DataFrame:
    """PF20, PF21, J5, J7: (qid, no_gold, cache_miss, used); a question goes if no relevant candidate exists or any candidate's text is missing."""
    relevant = candidates.join(gold.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("n_relevant"))
    missing = candidates.join(texts.select("doc_id", F.col("text")), "doc_id", "left").groupBy("qid").agg(F.bool_or(F.col("text").isNull()).alias("miss"))
    q = questions.select("qid").join(relevant, "qid", "left").join(missing, "qid", "left")
    no_gold = F.coalesce("n_relevant", F.lit(0)) == 0
    miss = ~no_gold & F.coalesce("miss", F.lit(False))
    return q.select("qid", no_gold.alias("no_gold"), miss.alias("cache_miss"), (~no_gold & ~miss).alias("used"))


def skip_counters(marked: DataFrame) -> DataFrame:
    """AG16"""
    return marked.agg(F.count_if("no_gold").alias("skipped_no_gold"), F.count_if("cache_miss").alias("skipped_cache_miss"), F.count_if("used").alias("n_questions"))
