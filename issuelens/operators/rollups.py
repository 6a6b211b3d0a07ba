"""Mergeable dashboard rollups of the prediction log.

A batch of predictions becomes one partial row per (hour or day, repository, class): counts and whole-number sums that add up
in any order.  Partials lie under a commit log, one part per batch (a batch sent twice counts once), and every
dashboard answer is taken from them alone; the log itself is not read again.  ``compact`` adds the parts up into one.

Means are sums of whole ten-thousandths over counts, so they equal those of the whole log bit by bit.  Periods are cut at whole
grains: exact if the anchor and the records lie on them, else a period begins with the grain that holds its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators.analytics import advice
from issuelens.operators.commit_log import CommitLog

SUMS = ["n", "n_confidence", "confidence_sum", "n_high"]
SCHEMA = "at timestamp_ntz, repo string, complexity string, " + ", ".join(f"{c} bigint" for c in SUMS)
PARTS = 32


class Rollups:
    def __init__(self, spark: SparkSession, root: str, grain: str = "hour", parts: int = PARTS):
        self.log, self.grain, self.parts = CommitLog(spark, root, schema=SCHEMA), grain, parts

    def partial(self, pred: DataFrame) -> DataFrame:
        tenths = F.round(F.col("confidence") * 10000).cast("bigint")
        at = F.date_trunc(self.grain, F.col("timestamp")).cast("timestamp_ntz")
        return pred.groupBy(at.alias("at"), "repo", "complexity").agg(
            F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confidence"),
            F.coalesce(F.sum(tenths), F.lit(0).cast("bigint")).alias("confidence_sum"),
            F.count_if(F.col("confidence") > C.HIGH_CONFIDENCE).alias("n_high"))

    def add(self, pred: DataFrame, batch: str) -> int | None:
        """Take in a batch of predictions; None if it was taken in before.  Many parts are added up into one."""
        version = self.log.write(self.partial(pred), batch)
        if version and len(self.log.manifest()["parts"]) > self.parts:
            self.compact()
        return version

    def merged(self, version: int | None = None) -> DataFrame:
        return self.log.read(version).groupBy("at", "repo", "complexity").agg(*[F.sum(c).alias(c) for c in SUMS])

    def compact(self) -> int:
        base = self.log.manifest()["version"]
        return self.log.commit([self.log.stage(self.merged(base))], replace=True, parent=base)

    # ------------------------------------------------------------------ answers
    @staticmethod
    def _mean() -> Column:
        return F.try_divide(F.sum("confidence_sum").cast("double"), F.sum("n_confidence") * F.lit(10000.0))

    def kpis(self) -> DataFrame:
        return self.merged().agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("complexity") == "complex", F.col("n"))), F.lit(0)).alias("complex_count"),
            self._mean().alias("avg_confidence"), F.coalesce(F.sum("n_high"), F.lit(0)).alias("high_confidence_count"))

    def distribution(self) -> DataFrame:
        each = self.merged().groupBy("complexity").agg(F.sum("n").alias("n"))
        # The window runs over one row per class.
        return each.select("complexity", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))

    def trend(self) -> DataFrame:
        """Per day and class: count and mean confidence."""
        return self.merged().groupBy(F.date_trunc("day", "at").alias("day"), "complexity").agg(F.sum("n").alias("n"), self._mean().alias("avg_confidence"))

    def resource_advice(self) -> DataFrame:
        """Advice per repository plus the overall row (repo = null)."""
        agg = self.merged().rollup("repo").agg(
            F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("complexity") == "complex", F.col("n"))), F.lit(0)).alias("complex_count"))
        return agg.withColumn("advice", advice(F.col("total"), F.col("complex_count")))

    def period_kpis(self, anchor=None) -> DataFrame:
        """KPIs of All Time / Last 7 Days / Last 30 Days before the anchor (default: the newest grain)."""
        rows = self.merged()
        anchor = anchor or rows.agg(F.max("at")).first()[0]
        out = None
        for name, days in (("all_time", None), ("last_7_days", 7), ("last_30_days", 30)):
            inside = rows if days is None or anchor is None else rows.where(
                F.col("at") >= F.date_trunc(self.grain, F.lit(anchor) - F.expr(f"INTERVAL {days} DAYS")).cast("timestamp_ntz"))
            one = inside.agg(
                F.lit(name).alias("period"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                F.coalesce(F.sum(F.when(F.col("complexity") == "complex", F.col("n"))), F.lit(0)).alias("complex_count"),
                self._mean().alias("avg_confidence"), F.coalesce(F.sum("n_high"), F.lit(0)).alias("high_confidence_count"))
            out = one if out is None else out.unionByName(one)
        return out
