"""Registered streaming queries (S5, T1-T3, T5, T7): availableNow runs over
deliveries landed from the events table, compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.plans.events_q import RELABEL_HISTORY_SQL, ROUTED, TRIAGED
from issuelens.plans.oracle_views import with_views
from issuelens.plans.registry import ORACLE, query
from issuelens.session import scratch_path, table
from issuelens.sources import fixtures as FX
from issuelens.streaming import webhook_stream as S

SLICES = 4


def _landing(spark, sf_dir, redeliver: bool = False) -> str:
    wh = FX.webhook_events(spark, sf_dir)
    if redeliver:
        # Every 13th delivery arrives a second time, five minutes later.
        again = wh.where(F.col("delivery_id") % 13 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
        wh = wh.unionByName(again)
    # Every time slice lands as FILES files, so one micro-batch = one slice, in time order.
    return S.land_deliveries(wh, scratch_path(spark, "landing"), slices=SLICES, files_per_slice=_files(spark, sf_dir))


def _files(spark, sf_dir) -> int:
    """Files of a time slice: one a core, more where a file would hold more than ``FX.EVENTS_A_TASK`` events."""
    return max(1, spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "events").count() // (SLICES * FX.EVENTS_A_TASK)))


@query("stream_webhook_ingest", ROUTED + """
SELECT delivery_id, event, p_action AS action, p_number AS number, p_repo AS repo FROM pj""")
def q_stream_webhook_ingest(spark, sf_dir):
    out = S.stream_ingest(spark, _landing(spark, sf_dir), scratch_path(spark, "ingest"))
    return out.select("delivery_id", "event", "action", "number", "repo")


@query("stream_triage", TRIAGED + """
SELECT delivery_id, event AS event_type, p_action AS action, status, reason,
       CASE WHEN status = 'processed' THEN p_number END AS issue_number,
       CASE WHEN status = 'processed' THEN p_repo END AS repo,
       predicted AS complexity,
       CASE WHEN status = 'processed' THEN confidence END AS confidence,
       CASE WHEN status = 'processed' THEN p_simple END AS p_simple,
       CASE WHEN status = 'processed' THEN p_moderate END AS p_moderate,
       CASE WHEN status = 'processed' THEN p_complex END AS p_complex,
       CASE WHEN status = 'processed' AND route = 'comment' THEN comment_id END AS comment_id
FROM tr""")
def q_stream_triage(spark, sf_dir):
    return S.stream_triage(spark, _landing(spark, sf_dir), scratch_path(spark, "triage-out"))


@query("stream_dedup", with_views("webhook_events") + "\nSELECT delivery_id, event, raw FROM webhook_events")
def q_stream_dedup(spark, sf_dir):
    return S.stream_dedup(spark, _landing(spark, sf_dir, redeliver=True), scratch_path(spark, "dedup-out"),
                          files_per_trigger=_files(spark, sf_dir))


@query("stream_relabel", RELABEL_HISTORY_SQL)
def q_stream_relabel(spark, sf_dir):
    return S.stream_relabel(spark, _landing(spark, sf_dir), scratch_path(spark, "relabel-out"),
                            files_per_trigger=_files(spark, sf_dir))


@query("stream_trend", TRIAGED + """,
d AS (SELECT date_trunc('day', ts) AS day, predicted AS complexity, confidence FROM tr WHERE status = 'processed')
SELECT day, complexity, count(*) AS n,
       sum(CAST(round(confidence * 10000) AS BIGINT)) / (count(confidence) * 10000.0) AS avg_confidence
FROM d
GROUP BY day, complexity""")
def q_stream_trend(spark, sf_dir):
    return S.stream_trend(spark, _landing(spark, sf_dir), scratch_path(spark, "trend-out"),
                          files_per_trigger=_files(spark, sf_dir))


@query("stream_rollup", ORACLE["stream_trend"])
def q_stream_rollup(spark, sf_dir):
    return S.stream_rollup(spark, _landing(spark, sf_dir), scratch_path(spark, "rollup-out"), files_per_trigger=_files(spark, sf_dir))


@query("stream_redelivery", ORACLE["stream_dedup"])
def q_stream_redelivery(spark, sf_dir):
    """Every 13th delivery comes again five minutes later, and in a second run of the stream every 11th comes a day later."""
    landing, out = _landing(spark, sf_dir, redeliver=True), scratch_path(spark, "redelivery-out")
    S.stream_dedup_horizon(spark, landing, out, "400 days", files_per_trigger=_files(spark, sf_dir) * 2)
    again = FX.webhook_events(spark, sf_dir).where(F.col("delivery_id") % 11 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    again.select("delivery_id", F.col("ts").cast("timestamp").alias("ts"), "event", "signature", "raw").write.mode("append").parquet(landing)
    return S.stream_dedup_horizon(spark, landing, out, "400 days", files_per_trigger=_files(spark, sf_dir) * 2)
