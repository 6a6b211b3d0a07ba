"""Rollups against the whole log, and user history by appends against the whole table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from issuelens.operators import analytics as A
from issuelens.operators.features import user_history
from issuelens.operators.rollups import Rollups
from issuelens.streaming.history_state import HistoryState


def predictions(spark, n):
    rng = random.Random(n)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=rng.randrange(60 * 24)), rng.choice(["a", "b", None]), i, rng.choice(["simple", "moderate", "complex"]),
             rng.choice([None, round(rng.random(), 4)])) for i in range(n)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, repo string, issue_number long, complexity string, confidence double")


def text(df):
    return sorted(map(str, df.collect()))


def test_answers_from_partials_equal_the_log(spark, tmp_path):
    pred = predictions(spark, 400)
    rolled = Rollups(spark, str(tmp_path / "r"), parts=3)
    assert rolled.kpis().first().total == 0 and rolled.trend().count() == 0 and rolled.period_kpis().count() == 3
    for k in range(8):
        some = pred.where(F.col("issue_number") % 8 == k)
        assert rolled.add(some, f"b{k}") and rolled.add(some, f"b{k}") is None
        assert len(rolled.log.manifest()["parts"]) <= 3  # added up as they grow
    assert text(rolled.kpis()) == text(A.dashboard_kpis(pred))
    assert text(rolled.distribution()) == text(A.complexity_distribution(pred))
    assert text(rolled.resource_advice()) == text(A.resource_advice(pred))
    assert text(rolled.period_kpis()) == text(A.period_kpis(pred))
    # One partial row per hour, repository and class at most, whatever the number of records.
    assert rolled.log.read().count() <= rolled.merged().count() * 3
    want = {(str(r.day), r.complexity): (r.n, r.avg_confidence) for r in A.complexity_trend(pred).collect()}
    assert {(str(r.day), r.complexity): (r.n, r.avg_confidence) for r in rolled.trend().collect()} == want


def issues(spark, rows):
    return spark.createDataFrame(rows, HistoryState.schemas["events"])


@pytest.mark.parametrize("order", ["time", "any"])
def test_appends_equal_the_whole_table(spark, tmp_path, order):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "x", "y", None]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)), rng.choice(["r", "s"]), i) for i in range(100)]
    rows.sort(key=(lambda r: (r[1], r[2], r[3])) if order == "time" else (lambda r: rng.random()))
    state = HistoryState(spark, str(tmp_path / "h"))
    for k in range(4):
        state.advance(issues(spark, rows[k * 25 : k * 25 + 25]), f"a{k}")
    want = user_history(issues(spark, rows)).select("author", "repo", "number", "user_issue_count", "is_new_user")
    assert text(state.read()) == text(want)
    state.compact()
    assert text(state.read()) == text(want)
    assert {r.author: r.n for r in state.now().collect()} == {a: sum(r[0] == a for r in rows) for a in {r[0] for r in rows}}


def test_an_append_touches_its_users_only(spark, tmp_path):
    t = lambda h: datetime(2024, 1, 1, h)
    state = HistoryState(spark, str(tmp_path / "h"))
    state.advance(issues(spark, [(f"u{i % 50}", t(1), "r", i) for i in range(500)]), "a")
    state.advance(issues(spark, [("u7", t(2), "r", 900), ("new", t(2), "r", 901)]), "b")
    part = state.log.manifest()["parts"][-1]
    assert state.table("states", [part]).count() == 2 and state.table("carry", [part]).count() == 2
    state.advance(issues(spark, [("u8", t(0), "r", 902)]), "late")  # before all of the user's issues
    part = state.log.manifest()["parts"][-1]
    assert state.table("states", [part]).count() == 11
    got = {r.number: r.user_issue_count for r in state.read().collect()}
    assert got[900] == 10 and got[901] == 0 and got[902] == 0 and got[8] == 1 and len(got) == 503
