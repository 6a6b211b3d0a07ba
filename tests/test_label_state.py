"""Incremental label state against the batch history: order of arrival, late events, replays, kills, compaction."""

import random
from datetime import datetime, timedelta

import pytest

from issuelens.operators import events as E
from issuelens.streaming.label_state import LabelState

SCHEMA = LabelState.schemas["events"]


def make(rng, n):
    start = datetime(2024, 1, 1)
    return [(i, rng.choice(["o/hot", "o/hot", "o/b", None]), rng.choice([1, 1, 1, 2, 3, None]), start + timedelta(minutes=rng.randrange(60)),
             rng.choice(["simple", "moderate", "complex"]), rng.random() < 0.2) for i in range(n)]


def text(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("order", ["time", "any"])
def test_batches_equal_the_whole(spark, tmp_path, order):
    rng = random.Random(4)
    rows = make(rng, 120)
    rows.sort(key=(lambda r: (r[3], r[0])) if order == "time" else (lambda r: rng.random()))
    state, done = LabelState(spark, str(tmp_path / "s")), []
    assert state.read().count() == 0
    for k in range(4):
        part = rows[k * 30 : k * 30 + 30]
        done += part
        assert state.advance(spark.createDataFrame(part, SCHEMA), f"b{k}") == k + 1 + (k > 2)
        assert state.advance(spark.createDataFrame(part, SCHEMA), f"b{k}") is None  # a replay changes nothing
        want = E.label_states(spark.createDataFrame(done, SCHEMA))
        assert text(state.read()) == text(want)
        if k == 2:
            assert state.compact() == 4 and text(state.read()) == text(want)
    last = {}
    for d, repo, number, ts, _, _ in done:
        last[repo, number] = max(last.get((repo, number), (ts, d)), (ts, d))
    after = {r.delivery_id: r.complexity_labels for r in want.collect()}
    now = {(r.repo, r.number): r.classes for r in state.labels().collect()}
    assert now == {k: ",".join(x.split(":")[1] for x in after[d].split(",")) for k, (_, d) in last.items()}


def test_a_batch_computes_its_own_issues_only(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    state = LabelState(spark, str(tmp_path / "s"))
    state.advance(spark.createDataFrame([(i, "r", i, t(5), "simple", False) for i in range(50)], SCHEMA), "a")
    state.advance(spark.createDataFrame([(50, "r", 3, t(6), "complex", False)], SCHEMA), "b")
    state.advance(spark.createDataFrame([(51, "r", 4, t(1), "complex", True)], SCHEMA), "late")
    sizes = [[state.table(kind, [p]).count() for kind in ("events", "states", "carry")] for p in state.log.manifest()["parts"]]
    assert sizes == [[50, 50, 50], [1, 1, 1], [1, 2, 1]]  # the late event brings its issue's two states, no more
    got = {(r.delivery_id): r.complexity_labels for r in state.read().where("number in (3, 4)").collect()}
    assert got == {3: "complexity:simple", 50: "complexity:complex,complexity:simple", 51: "complexity:complex",
                   4: "complexity:complex,complexity:simple"}


def test_a_killed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = make(random.Random(1), 40)
    state = LabelState(spark, str(tmp_path / "s"))
    state.advance(spark.createDataFrame(rows[:20], SCHEMA), "a")
    before = text(state.read())
    real, calls = LabelState._write, []

    def write(self, part, kind, df):
        calls.append(kind)
        if kind == "carry":
            raise RuntimeError("killed")
        return real(self, part, kind, df)

    monkeypatch.setattr(LabelState, "_write", write)
    with pytest.raises(RuntimeError, match="killed"):
        state.advance(spark.createDataFrame(rows[20:], SCHEMA), "b")
    monkeypatch.undo()
    assert calls == ["events", "states", "carry"] and text(state.read()) == before
    state.advance(spark.createDataFrame(rows[20:], SCHEMA), "b")
    assert text(state.read()) == text(E.label_states(spark.createDataFrame(rows, SCHEMA)))
