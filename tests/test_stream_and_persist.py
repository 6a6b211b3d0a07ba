"""Streaming side effects (T2), batch/stream equivalence, model persistence (K6)."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import events as E
from issuelens.operators import boosting as B
from issuelens.operators import learn as L
from issuelens.operators import models as M
from issuelens.operators.features import fit_scaler
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.streaming import webhook_stream as S
from tests.conftest import SF_SMALL


def test_stream_triage_side_effects_and_equivalence(spark):
    wh = FX.webhook_events(spark, SF_SMALL)
    landing = S.land_deliveries(wh, scratch_path(spark, "t-landing"), files_per_slice=1)
    out_root = scratch_path(spark, "t-triage")
    streamed = S.stream_triage(spark, landing, out_root, files_per_trigger=1)
    batch = E.result_columns(E.triage(wh))
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0
    processed = batch.where(F.col("status") == "processed").count()
    # every processed event reached the prediction log, the feedback log and the outbox exactly once
    preds = spark.read.schema("value string").text(f"{out_root}/predictions")
    assert preds.count() == processed
    fb = spark.read.option("header", "true").csv(f"{out_root}/feedback")
    assert fb.count() == processed
    outbox = spark.read.json(f"{out_root}/outbox")
    assert outbox.count() == processed and "payload" in outbox.columns


def test_replayed_batch_overwrites_its_output(spark):
    wh = FX.webhook_events(spark, SF_SMALL).limit(50)
    out_root = scratch_path(spark, "t-replay")
    sink = S.triage_sink(out_root, with_side_effects=False)
    tri = E.triage(wh)
    sink(tri, 0)
    sink(tri, 0)  # a replay of the same micro-batch id
    assert spark.read.parquet(f"{out_root}/results").count() == 50


def test_text_model_save_and_load(spark):
    frame = L.training_frame(FX.issues(spark, SF_SMALL))
    model = L.text_pipeline(max_iter=5).fit(frame.select("text", "label"))
    path = scratch_path(spark, "t-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = L.text_probabilities(model, frame.select("number", "text", "label")).orderBy("number").collect()
    b = L.text_probabilities(loaded, frame.select("number", "text", "label")).orderBy("number").collect()
    assert [r.prob_simple for r in a] == [r.prob_simple for r in b]


def test_a_second_run_takes_what_landed_since(spark):
    wh = FX.webhook_events(spark, SF_SMALL)
    first, second = wh.where("delivery_id < 10"), wh.where("delivery_id >= 10 and delivery_id < 30")
    landing, out, results = (scratch_path(spark, f"t-resume-{k}") for k in ("land", "ingest", "triage"))
    S.land_deliveries(first, landing, slices=2)
    a, b = S.stream_ingest(spark, landing, out).count(), S.stream_triage(spark, landing, results).count()
    S.land_deliveries(second, landing, slices=2)
    c, d = S.stream_ingest(spark, landing, out).count(), S.stream_triage(spark, landing, results).count()
    assert (a, b) == (first.count(), first.count())
    assert (c, d) == (a + second.count(), a + second.count())


def test_saved_models_score_by_what_exists(spark):
    issues = FX.issues(spark, SF_SMALL)
    frame = L.training_frame(issues).persist()
    text = L.text_pipeline(max_iter=3).fit(frame.select("text", "label"))
    scaler = fit_scaler(frame, C.NUMERIC_FEATURES)
    stacked = L.stacking_features(frame, L.text_probabilities(text, frame))
    boosted = L.fit_stacked(stacked, None, L.STACK_COLS, settings=B.Settings(rounds=2))
    rows = issues.select("number", "repo", "title", "body", "labels")
    whole = M.Models(text, boosted, scaler)
    for saved, name in ((M.Models(), "heuristic"), (M.Models(text), "text"), (M.Models(text, boosted), "text"), (whole, "stacked")):
        path = scratch_path(spark, "t-models")
        M.save_models(spark, saved, path)
        out = M.score(rows, M.load_models(spark, path))
        got = out.collect()
        assert {r.model for r in got} == {name} and len(got) == rows.count()
        assert out.columns == [*rows.columns, "model", "p_simple", "p_moderate", "p_complex", "complexity", "confidence"]
        assert sorted(got, key=str) == sorted(M.score(rows, saved).collect(), key=str)

    # A scorer from outside that fails on odd numbers: those rows fall through.
    def outside(df):
        ok = F.col("number") % 2 == 0
        return df.select("*", *[F.when(ok, F.lit(v)).alias(c) for c, v in zip(L.PROB_COLS, (0.2, 0.5, 0.3))])

    by_model = {(r.number % 2, r.model) for r in M.score(rows, M.Models(), outside).collect()}
    assert by_model == {(0, "text"), (1, "heuristic")}
    by_model = {(r.number % 2, r.model) for r in M.score(rows, whole, outside).collect()}
    assert by_model == {(0, "stacked"), (1, "heuristic")}


def test_out_of_fold_probabilities_cover_every_row(spark):
    frame = L.training_frame(FX.issues(spark, SF_SMALL)).select("repo", "number", "text", "label").persist()
    got = L.out_of_fold_probabilities(frame, folds=2, max_iter=3)
    assert got.select("repo", "number").exceptAll(frame.select("repo", "number")).count() == 0
    assert got.count() == frame.count()
    assert got.where(F.abs(sum(F.col(c) for c in L.PROB_COLS) - 1) > 1e-9).count() == 0


def test_stream_labels_equal_batch_for_tied_times_and_any_files(spark):
    wh = FX.webhook_events(spark, SF_SMALL).withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    batch = E.label_history(E.triage(wh))
    for slices, per_trigger in ((3, 1), (2, 5)):
        landing = S.land_deliveries(wh, scratch_path(spark, "t-tied"), slices=slices, files_per_slice=2)
        got = S.stream_relabel(spark, landing, scratch_path(spark, "t-labels"), files_per_trigger=per_trigger)
        assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_trend_holds_the_newest_day_and_later_runs(spark):
    wh = FX.webhook_events(spark, SF_SMALL)
    middle = wh.agg(F.percentile_approx("ts", 0.5)).first()[0]
    landing, out = scratch_path(spark, "t-trend-land"), scratch_path(spark, "t-trend")
    for part in (wh.where(F.col("ts") <= F.lit(middle)), wh.where(F.col("ts") > F.lit(middle))):
        S.land_deliveries(part, landing, slices=2, files_per_slice=1)
        got = S.stream_trend(spark, landing, out)
    done = E.triage(wh).where("status = 'processed'")
    want = done.groupBy(F.date_trunc("day", "ts").alias("day"), "predicted").count()
    assert {(r.day, r.complexity, r.n) for r in got.collect()} == {tuple(r) for r in want.collect()}
