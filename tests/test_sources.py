"""Sources: upload normalisation (required column, rejected side output), prediction-log scan."""

import pytest

from issuelens.sources import fixtures as FX
from issuelens.session import scratch_path
from issuelens.sources import readers as R


def test_upload_requires_title_and_splits_rejects(spark):
    rows = [("Fix it", None, "a, b,, ", "3"), ("   ", "body", None, "x"), (None, "b", "c", None), ("Ok", "", "", "")]
    df = spark.createDataFrame(rows, "title string, body string, labels string, comments string")
    accepted, rejected = R.upload_normalize(df)
    acc = {r.title: r for r in accepted.collect()}
    assert set(acc) == {"Fix it", "Ok"}
    assert acc["Fix it"].labels == ["a", "b"] and acc["Fix it"].comments == 3 and acc["Fix it"].body == ""
    assert acc["Ok"].labels == [] and acc["Ok"].comments == 0
    assert rejected.count() == 2
    with pytest.raises(ValueError, match="Missing required columns"):
        R.upload_normalize(df.drop("title"))


def test_prediction_log_drops_bad_lines_and_missing_log_is_empty(spark):
    path = scratch_path(spark, "t-log")
    good = '{"timestamp":"2024-01-01T00:00:00","repo":"o/r","issue_number":1,"title":"t","labels":["bug"],' \
           '"comments":2,"complexity":"simple","confidence":0.9,' \
           '"probabilities":{"simple":0.9,"moderate":0.1,"complex":0.0}}'
    lines = [good, "", '{"timestamp":"2024-01-0', good.replace('"issue_number":1', '"issue_number":2')]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    log = R.flatten_prediction_log(R.read_prediction_log(spark, path))
    assert sorted(r.issue_number for r in log.collect()) == [1, 2]
    assert R.read_prediction_log(spark, scratch_path(spark, "t-missing")).count() == 0


def test_a_task_makes_a_bounded_number_of_events(spark, tmp_path, monkeypatch):
    """Few narrow event rows on disk become wide bodies: the tasks follow the rows, not the cores."""
    rows = spark.range(900).selectExpr(
        "id AS event_id", "timestamp_micros(1704067200000000 + id * 1000000) AS ts", "id % 50 AS user_id",
        "element_at(array('error', 'view', 'signup', 'click', 'purchase'), cast(id % 5 + 1 AS int)) AS event_type", "id % 7 + 0.5D AS value",
        "concat('{\"k\": ', id % 90, '}') AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    whole = FX.webhook_events(spark, str(tmp_path))
    monkeypatch.setattr(FX, "EVENTS_A_TASK", 100)
    cut = FX.webhook_events(spark, str(tmp_path))
    assert cut.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, cut.collect()), key=lambda r: r[0]) == sorted(map(tuple, whole.collect()), key=lambda r: r[0])
