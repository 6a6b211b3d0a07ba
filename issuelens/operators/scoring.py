"""Scoring operators: heuristic scorer, batch scoring, fallback chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.score import argmax_class, confidence_of, with_heuristic

PROB_COLS = ["p_simple", "p_moderate", "p_complex"]


def heuristic_score(df: DataFrame, title="title", body="body", labels="labels", keep: list[str] | None = None) -> DataFrame:
    """Score every row with the closed-form heuristic (narrow, one codegen stage)."""
    keep = keep if keep is not None else [c for c in df.columns]
    scored = with_heuristic(df, title, body, labels)
    return scored.select(*keep, "complexity", "confidence", *PROB_COLS)


def valid_issue(title: Column) -> Column:
    """A scorable issue needs a title (the request model's only required field)."""
    return title.isNotNull()


def batch_score(df: DataFrame, number="number", repo="repo", title="title", body="body", labels="labels") -> DataFrame:
    """Batch scoring where a bad row never fails the batch.

    Rows that cannot be scored come back as ``unknown`` with zero
    probabilities and an ``error`` text instead of raising.
    """
    scored = with_heuristic(df, title, body, labels)
    ok = valid_issue(F.col(title))
    zero = F.lit(0.0)
    return scored.select(
        F.col(number).alias("issue_number"),
        F.col(repo).alias("repo"),
        F.when(ok, F.col("complexity")).otherwise(F.lit("unknown")).alias("complexity"),
        F.when(ok, F.col("confidence")).otherwise(zero).alias("confidence"),
        *[F.when(ok, F.col(p)).otherwise(zero).alias(p) for p in PROB_COLS],
        F.when(ok, F.lit(None).cast("string")).otherwise(F.lit("title is required")).alias("error"),
    )


def fallback_score(df: DataFrame, stacked: list[str] | None, text: list[str] | None, title="title", body="body",
                   labels="labels") -> DataFrame:
    """Row-level fallback chain: stacked model -> text model -> heuristic.

    ``stacked`` / ``text`` name three probability columns (simple, moderate,
    complex) that may be null where that model failed or is absent.  The
    chosen probabilities are rounded to 4 dp and the class is the first
    maximum in the fixed class order.
    """
    h = with_heuristic(df, title, body, labels).withColumnRenamed("complexity", "_h_cls").drop("confidence")
    chosen = []
    source = F.lit("heuristic")
    for i, p in enumerate(PROB_COLS):
        c = F.col(p)
        if text:
            c = F.when(F.col(text[0]).isNotNull(), F.round(F.col(text[i]), 4)).otherwise(c)
        if stacked:
            c = F.when(F.col(stacked[0]).isNotNull(), F.round(F.col(stacked[i]), 4)).otherwise(c)
        chosen.append(c.alias(f"_{p}"))
    if text:
        source = F.when(F.col(text[0]).isNotNull(), F.lit("text")).otherwise(source)
    if stacked:
        source = F.when(F.col(stacked[0]).isNotNull(), F.lit("stacked")).otherwise(source)
    out = h.select("*", *chosen, source.alias("model"))
    for p in PROB_COLS:
        out = out.drop(p).withColumnRenamed(f"_{p}", p)
    cls = argmax_class(F.col("p_simple"), F.col("p_moderate"), F.col("p_complex"))
    out = out.withColumn("complexity", cls)
    out = out.withColumn("confidence", confidence_of(F.col("complexity"), *[F.col(p) for p in PROB_COLS]))
    return out.drop("_h_cls")


def class_name_map(idx: Column) -> Column:
    """Class id -> lower-case name; unknown ids default to simple."""
    names = F.array(*[F.lit(c) for c in C.CLASSES])
    return F.coalesce(F.try_element_at(names, (idx + 1).cast("int")), F.lit(C.CLASSES[0]))
