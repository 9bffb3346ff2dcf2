import re

from pyspark.sql import functions as F

from marginalia.operators import links
from marginalia.sources.markdown import with_names

TEXT = "See Alpha-One and alpha one; the gamma.\n" + " ".join(f"alpha one w{i} gamma" for i in range(300)) + "\nalpha-oneish\nsee [[gamma]] only"


def corpus(spark):
    rows = [("v", "a/one-alpha.md", TEXT), ("v", "b/alpha-one.md", "own name: alpha one, gamma"), ("v", "c/gamma.md", "---\nx: y\n---\nno names"), ("v", "c/w7 gamma alpha.md", None)]
    return with_names(spark.createDataFrame(rows, "corpus string, rel string, content string").withColumn("mtime", F.timestamp_seconds(F.lit(0))))


def test_names_that_recur_in_a_long_line_come_once(spark):
    found = sorted(tuple(r) for r in links.mentions(corpus(spark)).select("rel", "line_no", "original_line_no", "text", "stem").collect())
    assert found == [
        ("a/one-alpha.md", 1, 1, "Alpha-One", "alpha-one"),
        ("a/one-alpha.md", 1, 1, "gamma", "gamma"),
        ("a/one-alpha.md", 2, 2, "alpha one", "alpha-one"),
        ("a/one-alpha.md", 2, 2, "gamma", "gamma"),
        ("a/one-alpha.md", 2, 2, "w7 gamma alpha", "w7 gamma alpha"),
        ("b/alpha-one.md", 1, 1, "gamma", "gamma"),
    ]


def test_lines_are_not_shuffled_with_their_words(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = links.mentions(corpus(spark))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set(key, before)
    blocks = [b for b in plan.split("\n\n") if re.search(r"hashpartitioning\(gram#", b)]
    assert blocks
    for block in blocks:
        columns = re.findall(r"(\w+)#", re.search(r"Input \[\d+\]: \[(.*?)\]", block)[1])
        assert not {"line", "low", "raw", "words"} & set(columns)
