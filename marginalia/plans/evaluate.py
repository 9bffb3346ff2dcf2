"""Evaluation of strategies extractor:ranker in one job (PR20, PF19-PF22)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, ranking
from ..session import settled

EXTRACTORS = ("content", "summary", "firstmsg", "haiku", "closets")
RANKERS = ("bm25", "embed", "mvembed", "mvmean", "emax", "emaxhyb", "hybrid", "hybrid2", "rerank")


def parse_strategy(text: str) -> tuple[str, str]:
    """PF22: exactly two parts, both known."""
    parts = text.split(":")
    if len(parts) != 2 or parts[0] not in EXTRACTORS or parts[1] not in RANKERS:
        raise ValueError(f"strategy {text!r}: expected extractor:ranker")
    return parts[0], parts[1]


def limited(questions: DataFrame, n: int | None) -> DataFrame:
    """PF19: the first n questions by identifier."""
    return questions if not n else questions.orderBy("qid").limit(n)


class Rankings:
    """All rankers over one extractor's texts and vectors; what several of them fuse is ranked once."""

    def __init__(self, questions: DataFrame, texts: DataFrame, vectors: DataFrame | None, field_vectors: DataFrame | None, candidates: DataFrame) -> None:
        self.questions, self.texts, self.vectors, self.field_vectors, self.candidates = questions, texts, vectors, field_vectors, candidates
        self.made: dict[str, DataFrame] = {}

    def once(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = settled(getattr(self, f"_{name}")())
        return self.made[name]

    def _bm25(self) -> DataFrame:
        return ranking.bm25(self.questions, self.texts, self.candidates)

    def _embed(self) -> DataFrame:
        return ranking.embed(self.questions, self.vectors, self.candidates)

    def _emax(self) -> DataFrame:
        return ranking.emax(self.questions, self.vectors, self.field_vectors, self.candidates)

    def by(self, ranker: str) -> DataFrame:
        """The ranking of one of RANKERS."""
        if ranker in ("mvembed", "mvmean"):
            return getattr(ranking, ranker)(self.questions, self.field_vectors, self.candidates)
        if ranker == "rerank":
            return ranking.rerank(self.questions, self.texts, self.once("embed"))
        if ranker in ("hybrid", "hybrid2"):
            return getattr(ranking, ranker)(self.once("bm25"), self.once("embed"))
        if ranker == "emaxhyb":
            return ranking.hybrid2(self.once("bm25"), self.once("emax"))
        return self.once(ranker)


def evaluate(strategies: list[str], questions: DataFrame, texts: dict[str, DataFrame], candidates: DataFrame, gold: DataFrame, *, vectors: dict[str, DataFrame] | None = None, field_vectors: dict[str, DataFrame] | None = None) -> DataFrame:
    """(strategy, qid, qtype, metrics...) for all strategies, as one union; texts and vectors by extractor.

    Questions without a relevant candidate, or with a missing text, are left out.
    """
    out, rankings, inside = [], {}, {}
    for name in strategies:
        extractor, ranker = parse_strategy(name)
        if extractor not in rankings:
            used = settled(metrics.usable(questions, candidates, gold, texts[extractor]).filter("used").select("qid"))
            q, c = questions.join(used, "qid", "left_semi"), candidates.join(used, "qid", "left_semi")
            rankings[extractor] = Rankings(q, texts[extractor], (vectors or {}).get(extractor), (field_vectors or {}).get(extractor), c)
            inside[extractor] = gold.join(c.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
        order = rankings[extractor].by(ranker)
        out.append(metrics.per_question(order, inside[extractor]).join(questions.select("qid", "qtype"), "qid").withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def headline(rows: DataFrame) -> DataFrame:
    """SK12: means of each strategy, best recall first."""
    return rows.groupBy("strategy").agg(F.count("*").alias("n"), *[F.round(F.avg(m), 9).alias(m) for m in metrics.METRICS]).orderBy(F.desc("recall5"), "strategy")
