"""Consolidation: unify original + feedback rows, key, rank, keep the best per key.

One shuffle: the per-key aggregate (``min_by`` over a total preference
order) collapses duplicates map-side, so a key repeated in a third of all
rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from issuelens import config as C
from issuelens.functions import text as T
from issuelens.operators.skew import best_per_key


def _pick(cols: list[str], candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in cols), None)


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def unify_schema(df: DataFrame, source: str) -> DataFrame:
    """Map one source onto the 9 consolidated columns.

    Candidate columns are chosen on the driver from the schema (first one
    present wins), then a single projection runs per row.  Blank or missing
    target labels become null (not the text "NAN").
    """
    cols = df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    repo = _pick(cols, C.REPO_CANDIDATES)
    num = _pick(cols, C.NUMBER_CANDIDATES)
    tgt = _pick(cols, C.TARGET_CANDIDATES)

    if "labels" in cols:
        if isinstance(types["labels"], ArrayType):
            labels = F.array_join(T.label_array(F.col("labels"), types["labels"]), ",")
        else:
            labels = F.col("labels").cast("string")
    else:
        labels = _null("string")
    if tgt:
        t = T.py_strip(F.col(tgt).cast("string"))
        target = F.when(t != "", F.upper(t))
    else:
        target = _null("string")
    comments = F.coalesce(T.whole_number(F.col("comments")), F.lit(0).cast("bigint")) \
        if "comments" in cols else F.lit(0).cast("bigint")
    return df.select(
        (F.col("timestamp").cast("string") if "timestamp" in cols else _null("string")).alias("timestamp"),
        (F.col(repo).cast("string") if repo else _null("string")).alias("repo"),
        (T.whole_number(F.col(num)) if num else _null("bigint")).alias("issue_number"),
        (F.col("title").cast("string") if "title" in cols else _null("string")).alias("title"),
        (F.col("body").cast("string") if "body" in cols else _null("string")).alias("body"),
        labels.alias("labels"),
        comments.alias("comments"),
        target.alias("target_label"),
        F.lit(source).alias("source"),
    )


def dedup_key() -> Column:
    """``repo:number`` when the number is known, else ``repo:`` + first 128 chars of the lower-cased title."""
    repo = T.py_strip(F.coalesce(F.col("repo"), F.lit("")))
    title = F.substring(F.lower(T.py_strip(F.coalesce(F.col("title"), F.lit("")))), 1, C.DEDUP_TITLE_CHARS)
    return F.when(
        F.col("issue_number").isNotNull(), F.concat(repo, F.lit(":"), F.col("issue_number").cast("string"))
    ).otherwise(F.concat(repo, F.lit(":"), title))


def epoch_seconds(ts_text: Column) -> Column:
    """Seconds since 1970-01-01 of an ISO timestamp text (null if unparsable).

    A UTC offset (``+05:30``, ``Z``) is honoured; naive text counts as UTC.
    Neither depends on the session time zone.
    """
    naive = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                             ts_text.try_cast("timestamp_ntz"))
    zoned = ts_text.rlike(r":[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.unix_seconds(ts_text.try_cast("timestamp"))).otherwise(naive)


def preference_score() -> Column:
    """2e9 * feedback + 1e7 * has_label + epoch seconds + comments (a sum, as in the reference)."""
    source_pts = F.when(F.col("source") == "feedback", F.lit(2)).otherwise(F.lit(0)).cast("bigint")
    label_pts = F.col("target_label").isNotNull().cast("bigint")
    return (
        source_pts * F.lit(C.SOURCE_BONUS)
        + label_pts * F.lit(C.LABEL_BONUS)
        + F.coalesce(epoch_seconds(F.col("timestamp")), F.lit(0)).cast("bigint")
        + F.coalesce(F.col("comments"), F.lit(0)).cast("bigint")
    )


def preference_order() -> list[Column]:
    """Total order: score desc, then explicit tie-breakers (input order is not used)."""
    ts = epoch_seconds(F.col("timestamp"))
    return [
        -F.col("_score"),
        F.col("source"),
        ts.isNull().cast("int"), -ts,
        F.col("title").isNull().cast("int"), F.col("title"),
        F.col("body").isNull().cast("int"), F.sha2(F.col("body"), 256),
        F.col("issue_number").isNull().cast("int"), F.col("issue_number"),
        F.col("labels").isNull().cast("int"), F.col("labels"),
        F.col("comments"),
        F.col("target_label").isNull().cast("int"), F.col("target_label"),
        F.col("timestamp").isNull().cast("int"), F.col("timestamp"),
    ]


def keyed(unified: DataFrame) -> DataFrame:
    return unified.withColumn("_key", dedup_key()).withColumn("_score", preference_score())


def consolidate(original: DataFrame, feedback: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Union both sources and keep the preferred row per key.

    ``payload`` names the columns to return (default: all 9).  A body outside
    the payload reaches the shuffle as its digest only.
    """
    u = unify_schema(original, "original").unionByName(unify_schema(feedback, "feedback"))
    k = keyed(u)
    return best_per_key(k, ["_key"], preference_order(), payload or C.CONSOLIDATED_COLUMNS).drop("_key")


def consolidation_summary(original: DataFrame, feedback: DataFrame) -> DataFrame:
    """total_rows_before, total_rows_after, duplicates_removed in one aggregate pass."""
    u = unify_schema(original, "original").unionByName(unify_schema(feedback, "feedback"))
    per_key = u.withColumn("_key", dedup_key()).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("total_rows_before"),
        F.count(F.lit(1)).cast("bigint").alias("total_rows_after"),
    ).withColumn("duplicates_removed", F.col("total_rows_before") - F.col("total_rows_after"))
