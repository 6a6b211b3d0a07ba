"""Dashboard analytics over the prediction log.

Every aggregate is a partial/final hash aggregate (map-side combine), every
top-k a ``TakeOrderedAndProject``; no raw rows reach the driver.  The
reference computes these over the newest 500 log records; here the window
is a parameter and defaults to the whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from issuelens import config as C
from issuelens.functions import text as TX


def recent(df: DataFrame, n: int | None, ts: str = "timestamp", tie: str = "issue_number") -> DataFrame:
    """Newest ``n`` records in append order (None -> all; 0 -> none)."""
    if n is None:
        return df
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(max(0, n))


def mean_4dp(c: Column) -> Column:
    """Exact mean of values rounded to 4 dp (probabilities always are).

    Summed as integer ten-thousandths, then one division: the result does
    not depend on summation order, so every engine and partitioning agrees.
    """
    k = F.round(c * 10000).cast("bigint")
    return F.sum(k) / (F.count(c) * F.lit(10000.0))


def kpi_columns(cls: Column | None = None, conf: Column | None = None) -> list[Column]:
    cls = F.col("complexity") if cls is None else cls
    conf = F.col("confidence") if conf is None else conf
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(cls == "complex").alias("complex_count"),
        mean_4dp(conf).alias("avg_confidence"),
        F.count_if(conf > C.HIGH_CONFIDENCE).alias("high_confidence_count"),
    ]


def dashboard_kpis(pred: DataFrame) -> DataFrame:
    return pred.agg(*kpi_columns())


def advice(total: Column, complex_count: Column) -> Column:
    """Load advice: >30 % complex -> high volume; <10 % (non-empty) -> healthy; else standard."""
    return (
        F.when(complex_count > total * C.HIGH_VOLUME_SHARE, F.lit(C.ADVICE_HIGH))
        .when((total > 0) & (complex_count / total < C.HEALTHY_SHARE), F.lit(C.ADVICE_HEALTHY))
        .otherwise(F.lit(C.ADVICE_STANDARD))
    )


def resource_advice(pred: DataFrame) -> DataFrame:
    """Advice per repository plus the overall row (repo = null) from one rollup."""
    agg = pred.rollup("repo").agg(F.count(F.lit(1)).alias("total"),
                                  F.count_if(F.col("complexity") == "complex").alias("complex_count"))
    return agg.withColumn("advice", advice(F.col("total"), F.col("complex_count")))


def complexity_distribution(pred: DataFrame) -> DataFrame:
    """Count and share per predicted class (share over the 3-row aggregate only)."""
    agg = pred.groupBy("complexity").agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def label_items(labels: Column, dtype) -> Column:
    """Label list of a record: names, names of label objects, or comma text trimmed with blanks dropped."""
    names = F.coalesce(TX.label_array(labels, dtype), F.array().cast("array<string>"))
    return F.filter(names, lambda x: x.isNotNull())


def top_labels(pred: DataFrame, k: int = C.TOP_LABELS) -> DataFrame:
    dtype = pred.schema["labels"].dataType
    ex = pred.select(F.explode(label_items(F.col("labels"), dtype)).alias("label"))
    return ex.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("label")).limit(k)


def high_priority(pred: DataFrame, k: int = C.HIGH_PRIORITY_ROWS) -> DataFrame:
    return (pred.where(F.col("complexity") == "complex")
            .orderBy(F.col("timestamp").desc(), F.col("issue_number").desc())
            .limit(k)
            .select("timestamp", "issue_number", "title", "confidence"))


def complexity_trend(pred: DataFrame) -> DataFrame:
    """Per day and class: count and mean confidence (re-aim of the scatter)."""
    return pred.groupBy(F.date_trunc("day", F.col("timestamp")).alias("day"), "complexity").agg(
        F.count(F.lit(1)).alias("n"), mean_4dp(F.col("confidence")).alias("avg_confidence"))


def period_kpis(pred: DataFrame, anchor=None) -> DataFrame:
    """KPIs for All Time / Last 7 Days / Last 30 Days in one pass.

    ``anchor`` defaults to the newest record time (one scalar aggregate), so
    results are deterministic.  A row may count in several periods, so the
    periods are produced by conditional aggregation, not by a join.
    """
    if anchor is None:
        anchor = pred.agg(F.max("timestamp").alias("a")).first()["a"]
    ts = F.col("timestamp")
    periods = [("all_time", None), ("last_7_days", 7), ("last_30_days", 30)]
    cols = []
    for name, days in periods:
        inside = F.lit(True) if days is None else (ts >= F.lit(anchor) - F.expr(f"INTERVAL {days} DAYS"))
        cls, conf = F.col("complexity"), F.col("confidence")
        cols += [
            F.count_if(inside).alias(f"{name}__total"),
            F.count_if(inside & (cls == "complex")).alias(f"{name}__complex_count"),
            mean_4dp(F.when(inside, conf)).alias(f"{name}__avg_confidence"),
            F.count_if(inside & (conf > C.HIGH_CONFIDENCE)).alias(f"{name}__high_confidence_count"),
        ]
    wide = pred.agg(*cols)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("period"),
                 *[F.col(f"{name}__{m}").alias(m) for m in
                   ["total", "complex_count", "avg_confidence", "high_confidence_count"]])
        for name, _ in periods]))
    return wide.select(stacked.alias("p")).select("p.*")


def probability_breakdown(pred: DataFrame) -> DataFrame:
    """One row per (record, class) with its probability."""
    return pred.select(
        "issue_number",
        F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("probability"))
                            for c in C.CLASSES])).alias("x"),
    ).select("issue_number", "x.class", "x.probability")
