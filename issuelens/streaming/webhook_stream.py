"""Structured Streaming over landed webhook deliveries.

Deliveries land as files (a Kafka source is a drop-in: the same envelope
columns).  Every stateless step is the batch operator itself
(``issuelens.operators.events``); the stream adds

* ``foreachBatch`` sinks that write under ``batch=<id>`` folders, so a replayed
  micro-batch overwrites its own output (idempotent side effects);
* ``dropDuplicatesWithinWatermark`` for redelivered events;
* a label state that each micro-batch advances by its own events; it depends on
  event times alone, not on how deliveries fell into files or micro-batches;
* a watermarked daily window for the trend (update mode: the open day included).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import events as E
from issuelens.operators.analytics import mean_4dp
from issuelens.operators.rollups import Rollups
from issuelens.operators.routing import feedback_record, notification_fields, notification_payload, route_to_team
from issuelens.sources.readers import CSV_OPTIONS, prediction_record
from issuelens.streaming.label_state import LabelState
from issuelens.streaming.seen import SeenDeliveries

ENVELOPE_SCHEMA = "delivery_id bigint, ts timestamp, event string, signature string, raw string"
WATERMARK = "1 hour"
TREND_WINDOW = "1 day"


def land_deliveries(envelopes: DataFrame, root: str, slices: int = 4, files_per_slice: int | None = None) -> str:
    """Land deliveries as time-ordered files: one write per time slice, oldest first.

    Slice bounds come from approximate quantiles of the receive time (a few
    numbers on the driver), so arrival order across micro-batches follows time.
    With ``files_per_slice`` every slice lands as exactly that many files
    (round-robin), so ``maxFilesPerTrigger = files_per_slice`` makes each
    micro-batch one slice while it still runs on that many tasks.
    """
    staged = f"{root}-staged"
    envelopes.select("delivery_id", F.col("ts").cast("timestamp").alias("ts"), "event", "signature", "raw") \
        .write.mode("overwrite").parquet(staged)  # computed once, sliced several times
    env = envelopes.sparkSession.read.parquet(staged)
    secs = F.unix_micros("ts")
    qs = env.select(F.percentile_approx(secs, [i / slices for i in range(1, slices)], 10000).alias("q")).first()["q"]
    bounds = [None, *qs, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = env
        if lo is not None:
            part = part.where(secs > F.lit(lo))
        if hi is not None:
            part = part.where(secs <= F.lit(hi))
        if files_per_slice:
            part = part.repartition(files_per_slice)
        part.write.mode("append").parquet(root)
    return root


def read_deliveries(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(ENVELOPE_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(root)


def run_available_now(stream: DataFrame, name: str, sink, out: str, checkpoint: str | None = None,
                      output_mode: str = "append") -> None:
    """Drain everything that has landed since the last run, then stop.

    The checkpoint belongs to the job: by default it lies beside its output,
    so a later run over the same output goes on where this one stopped.
    """
    location = checkpoint or f"{out.rstrip('/')}-checkpoint/{name}"
    w = stream.writeStream.outputMode(output_mode).option("checkpointLocation", location)
    w = w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)
    q = w.trigger(availableNow=True).queryName(f"{name}_{uuid.uuid4().hex[:8]}").start()
    q.awaitTermination()


# ------------------------------------------------------------------ triage
SINK_COLUMNS = ["delivery_id", "event", "action", "status", "reason", "route", "number", "repo", "title", "labels",
                "comments", "predicted", "confidence", "p_simple", "p_moderate", "p_complex", "comment_id"]


def triage_sink(out_root: str, with_side_effects: bool = True):
    """foreachBatch writer: results + prediction log + feedback log + outbox, per batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Keep only what the four writers need (no raw body, payload or texts).
        batch = batch.select(*SINK_COLUMNS).persist()
        E.result_columns(batch).write.mode("overwrite").parquet(f"{out_root}/results/batch={batch_id}")
        if with_side_effects:
            done = batch.where(F.col("status") == "processed").select(
                F.current_timestamp().alias("timestamp"), "repo", F.col("number").alias("issue_number"), "title",
                "labels", "comments", F.col("predicted").alias("complexity"), "confidence",
                "p_simple", "p_moderate", "p_complex")
            prediction_record(done).write.mode("overwrite").text(f"{out_root}/predictions/batch={batch_id}")
            feedback_record(done).write.mode("overwrite").options(**CSV_OPTIONS).csv(
                f"{out_root}/feedback/batch={batch_id}")
            fields = notification_fields(route_to_team(done))
            fields.select("issue_number", "repo", notification_payload(fields).alias("payload")).write.mode(
                "overwrite").json(f"{out_root}/outbox/batch={batch_id}")
        batch.unpersist()

    return write


def stream_triage(spark: SparkSession, landing: str, out_root: str, secret: str | None = C.WEBHOOK_SECRET,
                  files_per_trigger: int | None = None) -> DataFrame:
    """Run the event triage as a stream; returns the result table written by the sink."""
    s = read_deliveries(spark, landing, files_per_trigger)
    run_available_now(E.triage(s, secret), "triage", triage_sink(out_root), out_root)
    return spark.read.parquet(f"{out_root}/results").drop("batch")


# ------------------------------------------------------------------ ingest / dedup
def stream_ingest(spark: SparkSession, landing: str, out: str) -> DataFrame:
    """Raw body kept for the signature, parsed payload beside it."""
    s = E.parse(read_deliveries(spark, landing))
    flat = s.select("delivery_id", "ts", "event", "signature", "raw",
                    F.col("payload.action").alias("action"),
                    F.col("payload.issue.number").alias("number"),
                    F.col("payload.repository.full_name").alias("repo"))
    run_available_now(flat, "ingest", out, out)
    return spark.read.parquet(out)


def stream_dedup(spark: SparkSession, landing: str, out: str, delay: str = WATERMARK,
                 files_per_trigger: int | None = 1) -> DataFrame:
    """Drop redelivered events (same delivery id) within the watermark."""
    s = read_deliveries(spark, landing, files_per_trigger).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["delivery_id"])
    run_available_now(s.select("delivery_id", "event", "raw"), "dedup", out, out)
    return spark.read.parquet(out)


def stream_dedup_horizon(spark: SparkSession, landing: str, out: str, horizon: str = "30 days",
                         files_per_trigger: int | None = 1) -> DataFrame:
    """Drop deliveries that came before within ``horizon``, across runs and however long ago the stream last ran."""
    memory = SeenDeliveries(spark, f"{out}/seen", horizon)

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is read again rather than held: held bodies are many times their files, and the ids need no body.
        first = memory.fresh(batch.select("delivery_id", "ts"), f"batch-{batch_id}")
        # Of deliveries repeated inside the batch the earliest stays.
        mine = batch.join(first, ["delivery_id", "ts"], "left_semi").dropDuplicates(["delivery_id"])
        unnamed = batch.where(F.col("delivery_id").isNull())  # cannot be told apart: they stay
        mine.unionByName(unnamed).write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")

    s = read_deliveries(spark, landing, files_per_trigger).select("delivery_id", "ts", "event", "raw")
    run_available_now(s, "dedup-horizon", write, out)
    return spark.read.parquet(f"{out}/kept").select("delivery_id", "event", "raw")


# ------------------------------------------------------------------ relabel state
def stream_relabel(spark: SparkSession, landing: str, out: str, secret: str | None = C.WEBHOOK_SECRET,
                   files_per_trigger: int | None = 1) -> DataFrame:
    """Label set of each issue after every event (comment events replace, issue events add).

    Each micro-batch advances the label state under ``out`` by its own events (``label_state.LabelState``); a later run reads
    new deliveries only.  The rows equal the batch ``label_history`` of everything landed, late and tied events included.
    """
    state = LabelState(spark, out)
    s = E.label_events(E.triage(read_deliveries(spark, landing, files_per_trigger), secret))
    run_available_now(s, "relabel", lambda batch, batch_id: state.advance(batch, f"batch-{batch_id}"), out)
    return state.read()


# ------------------------------------------------------------------ trend
def stream_trend(spark: SparkSession, landing: str, out: str, delay: str = WATERMARK,
                 secret: str | None = C.WEBHOOK_SECRET, files_per_trigger: int | None = 1) -> DataFrame:
    """Daily count and mean confidence per class, the newest day included.

    Each micro-batch writes the windows it changed; the reader takes a
    window's latest version.  The watermark drops the state of closed days.
    """
    s = read_deliveries(spark, landing, files_per_trigger).withWatermark("ts", delay)
    t = E.triage(s, secret).where(F.col("status") == "processed")
    agg = t.groupBy(F.window("ts", TREND_WINDOW).alias("w"), F.col("predicted").alias("complexity")).agg(
        F.count(F.lit(1)).alias("n"), mean_4dp(F.col("confidence")).alias("avg_confidence"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_available_now(agg.select(F.col("w.start").alias("day"), "complexity", "n", "avg_confidence"), "trend", write, out,
                      output_mode="update")
    latest = spark.read.parquet(out).groupBy("day", "complexity").agg(
        F.max_by(F.struct("n", "avg_confidence"), F.col("batch").cast("bigint")).alias("v"))
    return latest.select("day", "complexity", "v.n", "v.avg_confidence")


def stream_rollup(spark: SparkSession, landing: str, out: str, secret: str | None = C.WEBHOOK_SECRET,
                  files_per_trigger: int | None = 1) -> DataFrame:
    """The trend from mergeable partials: each micro-batch adds its counts, however late its events; no window state, and no
    version of a day is read twice."""
    rolled = Rollups(spark, out, grain="day")
    t = E.triage(read_deliveries(spark, landing, files_per_trigger), secret).where(F.col("status") == "processed")
    rows = t.select(F.col("ts").alias("timestamp"), "repo", F.col("predicted").alias("complexity"), "confidence")
    run_available_now(rows, "rollup", lambda batch, batch_id: rolled.add(batch, f"batch-{batch_id}"), out)
    return rolled.trend()
