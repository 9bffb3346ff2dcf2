"""The end of a session as one plan (PR6): what each step does, and whether it held (SE1)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, facet_index, lifecycle, links


@dataclass
class Closing:
    """What a session leaves: each table as it is to be written."""

    status: DataFrame
    log: DataFrame
    decisions: DataFrame
    refreshed: DataFrame
    broken: DataFrame
    due: DataFrame

    def steps(self) -> DataFrame:
        """(step, n): rows that each step writes or reports."""
        counts = [
            ("1 status", self.status), ("2 log kept", self.log.filter("not archived")), ("3 log archived", self.log.filter("archived")), ("4 decisions", self.decisions),
            ("5 index refreshed", self.refreshed.filter("refresh")), ("6 broken links", self.broken), ("7 due", self.due.filter("due")),
        ]
        return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("step"), F.count("*").alias("n")) for name, rows in counts])

    def self_test(self, entry: DataFrame) -> DataFrame:
        """SE1: (check, ok): the new entry is on top, the log is within its cap, ordinals of decisions are unique, nothing of the old log is lost."""
        log = self.log.agg(F.min("ordinal").alias("first"), F.count_if(~F.col("archived")).alias("kept"), F.count("*").alias("all"), F.max("ordinal").alias("last"))
        top = self.log.join(entry.select(F.col("text").alias("_new")), F.col("text") == F.col("_new"), "left_semi").agg(F.min("ordinal").alias("new_at"))
        ids = self.decisions.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"))
        row = log.crossJoin(top).crossJoin(ids)
        return lifecycle.self_test({"entry on top": F.col("new_at") == 1, "log within cap": F.col("kept") <= lifecycle.LOG_CAP, "log whole": F.col("all") == F.col("last"), "decisions unique": F.col("n") == F.col("d")}, row)


def closed(old_status: DataFrame, new_status: DataFrame, log: DataFrame, entry: DataFrame, decisions: DataFrame, new_decisions: DataFrame, files: DataFrame, indexes: DataFrame, runs: DataFrame, as_of: Column) -> Closing:
    """PR6: status written if its substance changed (SK9), log prepended (SK8) and rotated (WN7), decisions appended (SK8), newer files marked for their index (J24), links verified (J2), overdue upkeep named (CO1)."""
    on_top = lifecycle.prepended(log, entry)
    return Closing(
        status=lifecycle.changed(old_status, new_status),
        # ordinals are places, so the newest `cap` need no order of the whole log
        log=on_top.withColumn("archived", F.col("ordinal") > lifecycle.LOG_CAP),
        decisions=lifecycle.appended(decisions, new_decisions),
        refreshed=facet_index.to_refresh(files.withColumnRenamed("folder", "collection").select("collection", "stem", "mtime"), indexes),
        broken=links.broken_links(files),
        due=audit.last_runs(runs, as_of),
    )
