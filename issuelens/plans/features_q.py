"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import HAS_CODE_RE, HAS_URL_RE
from issuelens.operators.features import (
    apply_scaler,
    dedup_keep_last,
    feature_frame,
    fit_scaler,
    numeric_text_features,
    training_text,
    user_history,
    with_label,
)
from issuelens.plans.oracle_views import py_words, with_views
from issuelens.plans.registry import query
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.streaming.history_state import HistoryState

# RE2 has no UNIX_LINES flag; its '.' already stops only at '\n'.
HAS_IMAGE_RE2 = "(?i)" + C.IMAGE_PATTERN


def _feature_sql_cols(t: str = "coalesce(title, '')", b: str = "coalesce(body, '')") -> str:
    return f"""CAST(length({t}) AS BIGINT) AS len_title,
       CAST(length({b}) AS BIGINT) AS len_body,
       {py_words(b)} AS word_count,
       CAST(regexp_matches({b}, '{HAS_CODE_RE}') AS INTEGER) AS has_code,
       CAST(regexp_matches({b}, '{HAS_IMAGE_RE2}') AS INTEGER) AS has_image,
       CAST(regexp_matches({b}, '{HAS_URL_RE}') AS INTEGER) AS has_url,
       CAST(coalesce(len(labels), 0) AS BIGINT) AS labels_count,
       CAST(0 AS BIGINT) AS reactions"""


FEATURES_SQL = with_views("issues") + f"""
SELECT number, {_feature_sql_cols()} FROM issues"""


@query("issue_features", FEATURES_SQL)
def q_issue_features(spark, sf_dir):
    f = numeric_text_features(FX.issues(spark, sf_dir))
    return f.select("number", "len_title", "len_body", "word_count", "has_code", "has_image", "has_url",
                    "labels_count", "reactions")


USER_HISTORY_SQL = with_views("issues") + """
SELECT number, author,
       CAST(row_number() OVER (PARTITION BY author ORDER BY created_at, number) - 1 AS BIGINT) AS user_issue_count,
       CAST(CASE WHEN row_number() OVER (PARTITION BY author ORDER BY created_at, number) = 1 THEN 1 ELSE 0 END AS INTEGER)
         AS is_new_user
FROM issues"""


@query("user_history", USER_HISTORY_SQL)
def q_user_history(spark, sf_dir):
    iss = FX.issues(spark, sf_dir).select("number", "author", "created_at")
    return user_history(iss).select("number", "author", "user_issue_count", "is_new_user")


@query("user_history_append", USER_HISTORY_SQL)
def q_user_history_append(spark, sf_dir):
    """The same counts from four appends, the last of which arrives out of order."""
    iss = FX.issues(spark, sf_dir).select("author", "created_at", "repo", "number")
    state = HistoryState(spark, scratch_path(spark, "user-history"))
    lo, hi = iss.agg(F.min("created_at"), F.max("created_at")).first()
    late = F.col("number") % 17 == 0
    for k in range(3):
        inside = (F.col("created_at") >= F.lit(lo + (hi - lo) * k / 3)) & ((F.col("created_at") < F.lit(lo + (hi - lo) * (k + 1) / 3)) | F.lit(k == 2))
        state.advance(iss.where(inside & ~late), f"append-{k}")
    state.advance(iss.where(late), "late")
    return state.read().select("number", "author", "user_issue_count", "is_new_user")


LABEL_SQL = with_views("threads") + """
SELECT number, comments,
       CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label
FROM threads"""


@query("complexity_label", LABEL_SQL)
def q_complexity_label(spark, sf_dir):
    return with_label(FX.threads(spark, sf_dir)).select("number", "comments", "label")


TRAINING_TEXT_SQL = with_views("issues") + """
SELECT number, coalesce(title, '') || ' ' || coalesce(body, '') AS text,
       CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label
FROM issues"""


@query("training_text", TRAINING_TEXT_SQL)
def q_training_text(spark, sf_dir):
    iss = with_label(FX.issues(spark, sf_dir))
    return iss.select("number", training_text().alias("text"), "label")


DEDUP_SQL = with_views("issues") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY title, body ORDER BY number DESC) AS rn FROM issues)
SELECT number, repo, comments,
       CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label
FROM r WHERE rn = 1"""


@query("dedup_keep_last", DEDUP_SQL)
def q_dedup_keep_last(spark, sf_dir):
    iss = FX.issues(spark, sf_dir).select("number", "repo", "title", "body", "comments")
    d = dedup_keep_last(iss, ordinal="number")
    return with_label(d).select("number", "repo", "comments", "label")


CLASS_DIST_SQL = with_views("issues") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY title, body ORDER BY number DESC) AS rn FROM issues)
SELECT CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label,
       count(*) AS n
FROM r WHERE rn = 1 GROUP BY 1"""


@query("class_distribution", CLASS_DIST_SQL)
def q_class_distribution(spark, sf_dir):
    iss = FX.issues(spark, sf_dir).select("number", "title", "body", "comments")
    d = with_label(dedup_keep_last(iss, ordinal="number", payload=["comments"]))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_SCALED = C.NUMERIC_FEATURES
SCALING_SQL = with_views("issues") + f""",
f AS (SELECT number, {_feature_sql_cols()},
             CAST(row_number() OVER (PARTITION BY author ORDER BY created_at, number) - 1 AS BIGINT) AS user_issue_count,
             CAST(CASE WHEN row_number() OVER (PARTITION BY author ORDER BY created_at, number) = 1 THEN 1 ELSE 0 END
                  AS INTEGER) AS is_new_user
      FROM issues),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)} FROM f)
SELECT number, {", ".join(
    f"round((f.{c} - s.m_{c}) / (CASE WHEN s.s_{c} = 0 OR s.s_{c} IS NULL THEN 1.0 ELSE s.s_{c} END), 6) AS {c}_scaled"
    for c in _SCALED)}
FROM f, s"""


@query("feature_scaling", SCALING_SQL)
def q_feature_scaling(spark, sf_dir):
    f = feature_frame(FX.issues(spark, sf_dir))
    stats = fit_scaler(f, _SCALED)
    scaled = apply_scaler(f, stats, suffix="_scaled")
    return scaled.select("number", *[F.round(F.col(c + "_scaled"), 6).alias(c + "_scaled") for c in _SCALED])
