"""Registered scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.operators.scoring import batch_score, fallback_score, heuristic_score
from issuelens.plans.oracle_views import scored_cte, with_views
from issuelens.plans.registry import query
from issuelens.sources import fixtures as FX

# ---------------------------------------------------------------- M1 flagship
HEURISTIC_SQL = with_views("issues") + "," + scored_cte("s", "issues") + """
SELECT number, repo, complexity, confidence, p_simple, p_moderate, p_complex FROM s"""


@query("heuristic_score", HEURISTIC_SQL)
def q_heuristic_score(spark, sf_dir):
    iss = FX.issues(spark, sf_dir)
    return heuristic_score(iss, keep=["number", "repo"])


# ---------------------------------------------------------------- M10 / P8
BATCH_SQL = with_views("issues") + """,
src AS (SELECT number, repo, CASE WHEN number % 23 = 0 THEN NULL ELSE title END AS title, body, labels FROM issues),
""" + scored_cte("s", "src")[1:] + """
SELECT number AS issue_number, repo,
       CASE WHEN title IS NULL THEN 'unknown' ELSE complexity END AS complexity,
       CASE WHEN title IS NULL THEN 0.0 ELSE confidence END AS confidence,
       CASE WHEN title IS NULL THEN 0.0 ELSE p_simple END AS p_simple,
       CASE WHEN title IS NULL THEN 0.0 ELSE p_moderate END AS p_moderate,
       CASE WHEN title IS NULL THEN 0.0 ELSE p_complex END AS p_complex,
       CASE WHEN title IS NULL THEN 'title is required' END AS error
FROM s"""


@query("batch_score", BATCH_SQL)
def q_batch_score(spark, sf_dir):
    # Every 23rd issue arrives without a title: it must come back as 'unknown', not fail the batch.
    iss = FX.issues(spark, sf_dir).withColumn(
        "title", F.when(F.col("number") % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("title")))
    return batch_score(iss)


# ---------------------------------------------------------------- M8 / M9
# The stacked model is "available" for even issue numbers, the text model for
# multiples of 3; other rows fall through to the heuristic.  The model
# probabilities are derived from the data (a deterministic function of the
# text lengths) so the chain itself is what is checked.
FALLBACK_SQL = with_views("issues") + """,
m AS (
  SELECT number, repo, title, body, labels,
         CASE WHEN number % 2 = 0 THEN length(title) / (length(title) + length(body) + 1.0) END AS st_s,
         CASE WHEN number % 2 = 0 THEN 1.0 / (length(title) + 1.0) END AS st_m,
         CASE WHEN number % 2 = 0 THEN 1.0 - length(title) / (length(title) + length(body) + 1.0) - 1.0 / (length(title) + 1.0) END AS st_c,
         CASE WHEN number % 3 = 0 THEN 0.2 END AS tx_s,
         CASE WHEN number % 3 = 0 THEN 0.5 END AS tx_m,
         CASE WHEN number % 3 = 0 THEN 0.3 END AS tx_c
  FROM issues),
""" + scored_cte("h", "m")[1:] + """,
c AS (
  SELECT number, repo,
         CASE WHEN st_s IS NOT NULL THEN 'stacked' WHEN tx_s IS NOT NULL THEN 'text' ELSE 'heuristic' END AS model,
         CASE WHEN st_s IS NOT NULL THEN round(st_s, 4) WHEN tx_s IS NOT NULL THEN round(tx_s, 4) ELSE p_simple END AS ps,
         CASE WHEN st_s IS NOT NULL THEN round(st_m, 4) WHEN tx_s IS NOT NULL THEN round(tx_m, 4) ELSE p_moderate END AS pm,
         CASE WHEN st_s IS NOT NULL THEN round(st_c, 4) WHEN tx_s IS NOT NULL THEN round(tx_c, 4) ELSE p_complex END AS pc
  FROM h)
SELECT number, repo, model, ps AS p_simple, pm AS p_moderate, pc AS p_complex,
       CASE WHEN ps >= pm AND ps >= pc THEN 'simple' WHEN pm >= pc THEN 'moderate' ELSE 'complex' END AS complexity,
       CASE WHEN ps >= pm AND ps >= pc THEN ps WHEN pm >= pc THEN pm ELSE pc END AS confidence
FROM c"""


@query("fallback_score", FALLBACK_SQL)
def q_fallback_score(spark, sf_dir):
    iss = FX.issues(spark, sf_dir)
    lt, lb = F.length("title"), F.length("body")
    even, by3 = F.col("number") % 2 == 0, F.col("number") % 3 == 0
    m = iss.select(
        "number", "repo", "title", "body", "labels",
        F.when(even, lt / (lt + lb + 1.0)).alias("st_s"),
        F.when(even, 1.0 / (lt + 1.0)).alias("st_m"),
        F.when(even, 1.0 - lt / (lt + lb + 1.0) - 1.0 / (lt + 1.0)).alias("st_c"),
        F.when(by3, F.lit(0.2)).alias("tx_s"),
        F.when(by3, F.lit(0.5)).alias("tx_m"),
        F.when(by3, F.lit(0.3)).alias("tx_c"),
    )
    out = fallback_score(m, ["st_s", "st_m", "st_c"], ["tx_s", "tx_m", "tx_c"])
    return out.select("number", "repo", "model", "p_simple", "p_moderate", "p_complex", "complexity", "confidence")
