"""Joint boosting: one split by hand, equal trees on any route, early stop, resume, save, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.operators import boosting as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(size=600), rng.integers(0, 4, 600), rng.normal(size=600)
    label = np.where(a + (b == 2) + rng.normal(size=600) * 0.3 > 0.8, 2, np.where(a < -0.3, 0, 1))
    data = [(i, int(y), None if i % 50 == 0 else float(x), float(z), float("nan") if i % 70 == 0 else float(w), i % 5 == 0)
            for i, (y, x, z, w) in enumerate(zip(label, a, b, c))]
    return spark.createDataFrame(data, "number long, label int, a double, b double, c double, held boolean").repartition(7).cache()


def test_first_split_by_hand(spark):
    # Two rows a side: the gradients of class k are 1/3 - [label = k], the hessians 4/9.
    data = [(i, 0 if i < 40 else 1, float(i >= 40)) for i in range(80)]
    df = spark.createDataFrame(data, "number long, label int, a double")
    s = B.Settings(rounds=1, depth=1, row_sample=1.0, column_sample=1.0, step=1.0)
    m = B.fit(df, ["a"], key=["number"], settings=s)
    g_left, g_right, h = 40 * (1 / 3 - 1), 40 / 3, 40 * 4 / 9
    tree = m.rounds[0][0]
    assert tree.feature[0] == 0 and m.edges[0][tree.cut[0] - 1] == 0.0
    assert tree.value[1] == pytest.approx(-g_left / (h + 1), rel=1e-6) and tree.value[2] == pytest.approx(-g_right / (h + 1), rel=1e-6)
    gain = g_left**2 / (h + 1) + g_right**2 / (h + 1) - (g_left + g_right) ** 2 / (2 * h + 1)
    assert tree.gain[0] == pytest.approx(gain, rel=1e-6)
    # The third class has equal gradients on both sides: nothing to gain, one leaf.
    assert m.rounds[0][2].feature[0] == -1 and m.rounds[0][2].value[0] == pytest.approx(-(80 / 3) / (2 * h + 1), rel=1e-6)
    p = B.predict(m, df).where("number = 0").first()
    e = [math.exp(m.rounds[0][k].value[1 if m.rounds[0][k].feature[0] >= 0 else 0]) for k in range(3)]
    assert [p.p_simple, p.p_moderate, p.p_complex] == pytest.approx([x / sum(e) for x in e])


def test_splits_are_the_best_of_all(rows):
    """Gains of a first tree against every threshold tried on the plain rows."""
    s = B.Settings(rounds=1, depth=1, row_sample=1.0, column_sample=1.0)
    m = B.fit(rows, FEATURES, key=["number"], settings=s)
    d = rows.toPandas()
    y = d.label.to_numpy()
    for k in range(3):
        g, best = 1 / 3 - (y == k), 0.0
        for f, column in enumerate(FEATURES):
            x = d[column].fillna(-np.inf).to_numpy()
            for edge in [-np.inf, *m.edges[f]]:
                left = x <= edge
                if 2 / 9 * 2 * left.sum() < 1 or 2 / 9 * 2 * (~left).sum() < 1:
                    continue
                score = lambda at: g[at].sum() ** 2 / (4 / 9 * at.sum() + 1)  # noqa: E731, B023
                best = max(best, score(left) + score(~left) - score(left | True))
        assert m.rounds[0][k].gain[0] == pytest.approx(best, rel=1e-5)


def test_one_task_and_cluster_grow_equal_trees(rows, monkeypatch):
    monkeypatch.setattr(B, "FOLD_EVERY", 3)
    s = B.Settings(rounds=7, patience=3)
    local = B.fit(rows, FEATURES, held="held", key=["number"], settings=s)
    spread = B.fit(rows.repartition(3), FEATURES, held="held", key=["number"], settings=s, local_rows=0)
    assert B.to_json(local) == B.to_json(spread)
    assert len(local.losses) == 8 and all(x > y for x, y in zip(local.losses, local.losses[1:]))


def test_rows_on_the_cluster_are_written_only_every_few_rounds(rows, monkeypatch):
    taken, plain = [], B._moved
    monkeypatch.setattr(B, "_moved", lambda r, recent: taken.append(len(recent)) or plain(r, recent))
    monkeypatch.setattr(B, "MOVE_EVERY", 3)
    on = {"held": "held", "key": ["number"]}
    local = B.fit(rows, FEATURES, **on, settings=B.Settings(rounds=11))
    short = B.fit(rows, FEATURES, **on, settings=B.Settings(rounds=4), local_rows=0)
    assert taken == [3]
    spread = B.fit(rows, FEATURES, **on, settings=B.Settings(rounds=11), resume=short, local_rows=0)
    assert taken == [3, 4, 3, 3] and B.to_json(spread) == B.to_json(local)


def test_early_stop_and_resume(rows):
    noise = rows.withColumn("label", (F.xxhash64("number", F.lit(5)) % 3 + 3).cast("int") % 3)
    s = B.Settings(patience=10)
    m = B.fit(noise, FEATURES, held="held", key=["number"], settings=s)
    assert len(m.rounds) < 100 and m.best == len(m.rounds) - 10 == int(np.argmin(m.losses))
    short = B.fit(rows, FEATURES, held="held", key=["number"], settings=B.Settings(rounds=5))
    more = B.fit(rows, FEATURES, held="held", key=["number"], settings=B.Settings(rounds=9), resume=short)
    whole = B.fit(rows, FEATURES, held="held", key=["number"], settings=B.Settings(rounds=9))
    assert B.to_json(more) == B.to_json(whole)


def test_probabilities_importance_and_saving(spark, rows, tmp_path):
    m = B.fit(rows, FEATURES, held="held", key=["number"], settings=B.Settings(rounds=150, patience=20))
    out = B.predict(m, rows)
    assert out.columns == [*rows.columns, "p_simple", "p_moderate", "p_complex"] and out.count() == 600
    got = out.toPandas()
    p = got[["p_simple", "p_moderate", "p_complex"]].to_numpy()
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-12
    held = got.held.to_numpy()
    assert (p.argmax(axis=1) == got.label)[held].mean() > max(np.bincount(got.label[held])) / held.sum() + 0.2
    shares = dict(B.importance(m))
    assert sum(shares.values()) == pytest.approx(1) and shares["a"] > shares["c"]
    B.save(spark, m, str(tmp_path / "m"))
    B.save(spark, m, str(tmp_path / "m"))
    again = B.load(spark, str(tmp_path / "m"))
    assert B.to_json(again) == B.to_json(m)
    # The loss reported is that of the rows held out.
    assert m.losses[m.best] == pytest.approx(-np.log(p[np.arange(600), got.label])[held].mean(), abs=1e-6)


def test_edge_tables(spark, rows):
    empty = B.fit(rows.limit(0), FEATURES, key=["number"])
    assert empty.rounds == [] and B.predict(empty, rows).where("abs(p_simple - 1/3) < 1e-12").count() == 600
    none = rows.withColumn("a", F.lit(None).cast("double")).withColumn("label", F.when(F.col("number") > 9, F.col("label")))
    m = B.fit(none, FEATURES, key=["number"], settings=B.Settings(rounds=2))
    assert m.best == 2 and m.edges[0] == [] and B.predict(m, rows.limit(0)).count() == 0


def test_a_round_reads_gradients_once_and_sums_the_smaller_children():
    """One pass over margins a round; of two children at most half the parent's weight is summed, the other is exact by difference."""
    rng = np.random.default_rng(5)
    n = 4000
    bins = rng.integers(1, 20, (3, n)).astype(np.uint8)
    label = np.where(bins[0] > 10, 2, np.where(bins[1] > 8, 1, 0)).astype(np.uint8)
    block = B.Block(bins, label, np.zeros(n, bool), np.arange(n), np.zeros((3, n)))
    begun, summed = [], {}

    def sums(m, trees, level, round_, columns, slots):
        if level == 0:
            begun.append(round_)
            block_, state["now"] = state["block"].begin(m.settings, m.rounds[-1:], round_)
            state["block"] = block_
        found, loss = state["now"].sums(trees, level, columns, slots)
        summed[round_, level] = sum(found[slots[k, j], columns[k][0], :, 1].sum() for k, j in np.argwhere(slots >= 0))
        return found, loss

    state = {"block": block}
    s = B.Settings(rounds=4, depth=3, row_sample=1.0, column_sample=1.0)
    m = B.boost(B.Model(FEATURES, [[float(i) for i in range(1, 20)]] * 3, settings=s), sums)
    assert begun == [0, 1, 2, 3, 4] and len(m.rounds) == 4
    assert all(2 * w <= summed[r, 0] for (r, level), w in summed.items() if level)
    # The weight of every leaf, summed anew, gives the value found by difference.
    at = B.Block(bins, label, block.held, block.salt, block.margin)
    _, now = at.begin(s, [], 0)
    for k, tree in enumerate(m.rounds[0]):
        for node, rows in tree.parts(bins):
            g, h = now.g[k, rows].sum() / B.UNIT, now.h[k, rows].sum() / B.UNIT
            assert tree.value[node] == pytest.approx(-s.step * g / (h + B.L2), rel=1e-9)
