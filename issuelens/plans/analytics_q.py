"""Registered dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import analytics as A
from issuelens.operators.commit_log import CommitLog
from issuelens.operators.rollups import Rollups
from issuelens.plans.oracle_views import with_views
from issuelens.plans.registry import ORACLE, query
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.sources import readers as R

P = with_views("predictions")


@query("dashboard_kpis", P + f"""
SELECT count(*) AS total, CAST(count_if(complexity = 'complex') AS BIGINT) AS complex_count,
       sum(CAST(round(confidence * 10000) AS BIGINT)) / (count(confidence) * 10000.0) AS avg_confidence, CAST(count_if(confidence > {C.HIGH_CONFIDENCE}) AS BIGINT) AS high_confidence_count
FROM predictions""")
def q_dashboard_kpis(spark, sf_dir):
    return A.dashboard_kpis(FX.predictions(spark, sf_dir))


_ADVICE = f"""CASE WHEN complex_count > total * {C.HIGH_VOLUME_SHARE} THEN '{C.ADVICE_HIGH}'
            WHEN total > 0 AND complex_count / total < {C.HEALTHY_SHARE} THEN '{C.ADVICE_HEALTHY}'
            ELSE '{C.ADVICE_STANDARD}' END"""


@query("resource_advice", P + f""",
a AS (SELECT repo, count(*) AS total, CAST(count_if(complexity = 'complex') AS BIGINT) AS complex_count
      FROM predictions GROUP BY ROLLUP (repo))
SELECT repo, total, complex_count, {_ADVICE} AS advice FROM a""")
def q_resource_advice(spark, sf_dir):
    return A.resource_advice(FX.predictions(spark, sf_dir))


@query("complexity_distribution", P + """,
a AS (SELECT complexity, count(*) AS n FROM predictions GROUP BY complexity)
SELECT complexity, n, n / sum(n) OVER () AS share FROM a""")
def q_complexity_distribution(spark, sf_dir):
    return A.complexity_distribution(FX.predictions(spark, sf_dir))


@query("top_labels", P + f"""
SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM predictions)
WHERE label IS NOT NULL GROUP BY label ORDER BY n DESC, label LIMIT {C.TOP_LABELS}""")
def q_top_labels(spark, sf_dir):
    return A.top_labels(FX.predictions(spark, sf_dir))


@query("high_priority_issues", P + f"""
SELECT "timestamp", issue_number, title, confidence FROM predictions WHERE complexity = 'complex'
ORDER BY "timestamp" DESC, issue_number DESC LIMIT {C.HIGH_PRIORITY_ROWS}""")
def q_high_priority_issues(spark, sf_dir):
    return A.high_priority(FX.predictions(spark, sf_dir))


@query("complexity_trend", P + """
SELECT date_trunc('day', "timestamp") AS day, complexity, count(*) AS n, sum(CAST(round(confidence * 10000) AS BIGINT)) / (count(confidence) * 10000.0) AS avg_confidence
FROM predictions GROUP BY 1, 2""")
def q_complexity_trend(spark, sf_dir):
    return A.complexity_trend(FX.predictions(spark, sf_dir))


def _period_sql(name: str, days: int | None) -> str:
    inside = "TRUE" if days is None else f"\"timestamp\" >= (SELECT max(\"timestamp\") FROM predictions) - INTERVAL {days} DAY"
    return f"""SELECT '{name}' AS period, CAST(count_if({inside}) AS BIGINT) AS total,
       CAST(count_if(({inside}) AND complexity = 'complex') AS BIGINT) AS complex_count,
       sum(CAST(round(CASE WHEN {inside} THEN confidence END * 10000) AS BIGINT))
         / (count(CASE WHEN {inside} THEN confidence END) * 10000.0) AS avg_confidence,
       CAST(count_if(({inside}) AND confidence > {C.HIGH_CONFIDENCE}) AS BIGINT) AS high_confidence_count
FROM predictions"""


@query("dashboard_period_kpis", P + "\n" + "\nUNION ALL\n".join(
    _period_sql(n, d) for n, d in [("all_time", None), ("last_7_days", 7), ("last_30_days", 30)]))
def q_dashboard_period_kpis(spark, sf_dir):
    return A.period_kpis(FX.predictions(spark, sf_dir))


@query("probability_breakdown", P + """
SELECT issue_number, 'simple' AS class, p_simple AS probability FROM predictions
UNION ALL SELECT issue_number, 'moderate', p_moderate FROM predictions
UNION ALL SELECT issue_number, 'complex', p_complex FROM predictions""")
def q_probability_breakdown(spark, sf_dir):
    return A.probability_breakdown(FX.predictions(spark, sf_dir))


@query("recent_predictions", P + f"""
SELECT "timestamp", repo, issue_number, title, array_to_string(labels, ',') AS labels, comments, complexity,
       confidence, p_simple, p_moderate, p_complex
FROM predictions ORDER BY "timestamp" DESC, issue_number DESC LIMIT {C.RECENT_LIMIT}""")
def q_recent_predictions(spark, sf_dir):
    recent = A.recent(FX.predictions(spark, sf_dir), C.RECENT_LIMIT)
    return recent.withColumn("labels", F.array_join("labels", ","))


# ------------------------------------------------------- from rollups alone
def _rolled(spark, sf_dir) -> Rollups:
    """The log in three batches, one of them sent twice, added up in between."""
    pred = FX.predictions(spark, sf_dir).select("timestamp", "repo", "issue_number", "complexity", "confidence")
    rolled = Rollups(spark, scratch_path(spark, "rollups"))
    for k in (0, 1, 1, 2):
        rolled.add(pred.where(F.col("issue_number") % 3 == k), f"batch-{k}")
        if k == 1:
            rolled.compact()
    return rolled


def _register_rollups() -> None:
    answers = {"dashboard_kpis": Rollups.kpis, "complexity_distribution": Rollups.distribution, "complexity_trend": Rollups.trend,
               "resource_advice": Rollups.resource_advice, "dashboard_period_kpis": Rollups.period_kpis}
    for key, answer in answers.items():
        query(f"rollup_{key}", ORACLE[key])(lambda spark, sf_dir, answer=answer: answer(_rolled(spark, sf_dir)))


_register_rollups()


# ------------------------------------------------------- prediction log I/O
LOG_SQL = P + """
SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp", repo, issue_number, title,
       array_to_string(labels, ',') AS labels, comments, complexity, confidence, p_simple, p_moderate, p_complex
FROM predictions"""


@query("predictions_log_scan", LOG_SQL)
def q_predictions_log_scan(spark, sf_dir):
    """Write the log as JSON lines with blank and truncated lines mixed in, then scan it."""
    pred = FX.predictions(spark, sf_dir)
    lines = R.prediction_record(pred)
    # Damaged lines next to good ones: a blank line and a truncated record per 50 issues.
    bad = pred.where(F.col("issue_number") % 50 == 0)
    damaged = R.prediction_record(bad).select(F.substring("value", 1, 40).alias("value")).unionByName(
        bad.select(F.lit("").alias("value")))
    path = scratch_path(spark, "predictions-log")
    lines.unionByName(damaged).write.mode("overwrite").text(path)
    return R.flatten_prediction_log(R.read_prediction_log(spark, path))


APPEND_SQL = P + """
SELECT repo, issue_number, title, array_to_string(labels, ',') AS labels, comments, complexity, confidence,
       p_simple, p_moderate, p_complex FROM predictions"""


@query("predictions_log_append", APPEND_SQL)
def q_predictions_log_append(spark, sf_dir):
    """Two scoring batches appended to the log, each record stamped with the processing time; the second is sent twice."""
    pred = FX.predictions(spark, sf_dir).withColumn("timestamp", F.current_timestamp())
    log = CommitLog(spark, scratch_path(spark, "predictions-append"), "json", R.PREDICTION_LOG_SCHEMA, {"mode": "DROPMALFORMED"})
    for half in (0, 1, 1):
        log.write(R.prediction_rows(pred.where(F.col("issue_number") % 2 == half)), batch=f"batch-{half}")
    return R.flatten_prediction_log(log.read()).drop("timestamp")
