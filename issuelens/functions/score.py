"""Closed-form heuristic complexity scorer as column expressions.

The reference computes a float score
    s = 0.6*min(1, chars/4000) + 0.4*min(1, words/800)
        + 0.25*security + 0.15*perf + 0.10*bug - 0.10*docs,   clamped to [0, 1]
and maps it to triangular class probabilities.  We evaluate it in the exact
integer form S = 20000*s so every engine produces the same probabilities and
the same class on ties (S = 5000 -> simple, S = 15000 -> moderate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions import text as T


def text_stats(ts: Column, bs: Column) -> tuple[Column, Column]:
    """(chars, words) of ``f"{ts}\\n\\n{bs}".strip()`` for already stripped parts.

    Computed from the parts, so the (possibly very long) joined text is
    never materialised.
    """
    lt, lb = F.length(ts), F.length(bs)
    chars = (F.when(lt == 0, lb).when(lb == 0, lt).otherwise(lt + 2 + lb)).cast("bigint")
    words = T.py_word_count(ts) + T.py_word_count(bs)
    return chars, words


def points_from_parts(ts: Column, bs: Column, norm: Column) -> Column:
    """Integer score S in [0, 20000] from stripped title/body and lower-cased labels."""
    chars, words = text_stats(ts, bs)
    security = T.any_label_in(norm, C.SECURITY_LABELS)
    perf = T.any_label_in(norm, C.PERF_LABELS) | F.lower(ts).contains(C.PERF_TITLE_TOKEN)
    bug = T.any_label_in(norm, C.BUG_LABELS)
    docs = T.any_label_in(norm, C.DOCS_LABELS)
    raw = (
        F.lit(C.CHAR_WEIGHT) * F.least(chars, F.lit(C.CHAR_CAP))
        + F.lit(C.WORD_WEIGHT) * F.least(words, F.lit(C.WORD_CAP))
        + F.when(security, C.SECURITY_POINTS).otherwise(0)
        + F.when(perf, C.PERF_POINTS).otherwise(0)
        + F.when(bug, C.BUG_POINTS).otherwise(0)
        - F.when(docs, C.DOCS_POINTS).otherwise(0)
    )
    return F.least(F.greatest(raw, F.lit(0)), F.lit(C.SCORE_SCALE)).cast("bigint")


def heuristic_points(title, body, labels) -> Column:
    """Integer score S in [0, 20000] (single expression form)."""
    ts = T.py_strip(F.coalesce(T.col_(title), F.lit("")))
    bs = T.py_strip(F.coalesce(T.col_(body), F.lit("")))
    return points_from_parts(ts, bs, T.lowered_label_array(labels))


def probabilities_from_points(points: Column) -> dict[str, Column]:
    half = C.SCORE_SCALE // 2
    simple_k = F.greatest(F.lit(half) - points, F.lit(0))
    complex_k = F.greatest(points - F.lit(half), F.lit(0))
    moderate_k = F.lit(half) - simple_k - complex_k
    return {
        "p_simple": (simple_k / F.lit(float(half))).cast("double"),
        "p_moderate": (moderate_k / F.lit(float(half))).cast("double"),
        "p_complex": (complex_k / F.lit(float(half))).cast("double"),
    }


def argmax_class(p_simple: Column, p_moderate: Column, p_complex: Column) -> Column:
    """First maximum in the fixed order simple, moderate, complex."""
    return (
        F.when((p_simple >= p_moderate) & (p_simple >= p_complex), F.lit("simple"))
        .when(p_moderate >= p_complex, F.lit("moderate"))
        .otherwise(F.lit("complex"))
    )


def confidence_of(cls: Column, p_simple: Column, p_moderate: Column, p_complex: Column) -> Column:
    return (
        F.when(cls == "simple", p_simple).when(cls == "moderate", p_moderate).when(cls == "complex", p_complex)
    )


def with_heuristic(df, title="title", body="body", labels="labels", keep_points: bool = False):
    """Add heuristic columns.

    The stripped title/body and the lower-cased labels are staged in their
    own projection so each is computed once per row, then the points once,
    then the probabilities and class.
    """
    staged = df.select(
        "*",
        T.py_strip(F.coalesce(T.col_(title), F.lit(""))).alias("_ts"),
        T.py_strip(F.coalesce(T.col_(body), F.lit(""))).alias("_bs"),
        T.lowered_label_array(T.label_array(labels, df.schema[labels].dataType)).alias("_lab"),
    )
    out = staged.withColumn("_pts", points_from_parts(F.col("_ts"), F.col("_bs"), F.col("_lab"))).drop(
        "_ts", "_bs", "_lab")
    probs = probabilities_from_points(F.col("_pts"))
    out = out.select("*", *[v.alias(k) for k, v in probs.items()])
    cls = argmax_class(F.col("p_simple"), F.col("p_moderate"), F.col("p_complex"))
    out = out.withColumn("complexity", cls).withColumn(
        "confidence", confidence_of(F.col("complexity"), F.col("p_simple"), F.col("p_moderate"), F.col("p_complex"))
    )
    if keep_points:
        return out.withColumnRenamed("_pts", "score_points")
    return out.drop("_pts")


def complexity_label(comments) -> Column:
    """Comment count -> 0/1/2; null (missing) comparisons fall through to 2."""
    c = T.col_(comments)
    return (
        F.when(c <= C.SIMPLE_MAX_COMMENTS, 0).when(c <= C.MODERATE_MAX_COMMENTS, 1).otherwise(2).cast("int")
    )
