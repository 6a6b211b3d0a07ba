"""Collection operators on hand-made inputs."""

from datetime import datetime

from issuelens.operators.collect import incremental_append, monitored_repos
from issuelens.plans import collect_q


def test_monitored_set_change_log(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    changes = [
        (" new/one ", "add", t(1), 1),        # trimmed
        ("   ", "add", t(2), 2),              # blank: rejected
        ("new/two", "add", t(3), 3),
        ("new/two", "remove", t(4), 4),       # latest request wins
        ("old/cfg", "remove", t(5), 5),       # configured repo removed
        ("new/three", "remove", t(6), 6),
        ("new/three", "add", t(6), 7),        # same time: higher request id wins
    ]
    df = spark.createDataFrame(changes, "repo string, op string, ts timestamp, request_id long")
    got = sorted(r.repo for r in monitored_repos(df, initial=["old/cfg", "keep/cfg"]).collect())
    assert got == ["keep/cfg", "new/one", "new/three"]


def test_incremental_append_keeps_new_duplicates(spark):
    existing = spark.createDataFrame([("o/r", 1, "a"), ("o/r", 2, "b")], "repo string, number long, title string")
    new = spark.createDataFrame([("o/r", 2, "b2"), ("o/r", 3, "c"), ("o/r", 3, "c")],
                                "repo string, number long, title string")
    got = sorted((r.number, r.title) for r in incremental_append(existing, new).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c"), (3, "c")]  # existing wins; duplicates inside new are kept


def test_snapshot_holds_every_issue_of_a_hot_repository(spark, monkeypatch):
    pages = spark.range(1, 1101).selectExpr(
        "id AS number", "'o/hot' AS repo", "'closed' AS state", "5L AS comments", "string(id) AS created_at", "false AS _is_pr")
    monkeypatch.setattr(collect_q, "landed_pages", lambda *_: pages)
    got = collect_q.q_snapshot_write(spark, None)
    assert got.count() == got.select("number").distinct().count() == 1100
