"""Nearest neighbours against brute force: exact small classes, recall on large ones, copies, ties, edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.operators import learn as L
from issuelens.operators import neighbours as N

COLS = [f"f{i}" for i in range(8)]


def frame(spark, x, label):
    rows = [("r%d" % (i % 3), i // 3, int(y), *map(float, v)) for i, (v, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "repo string, number long, label int, " + ", ".join(f"{c} double" for c in COLS))


def brute(vecs, k):
    out = {}
    for i, v in enumerate(vecs):
        d = ((vecs - v) ** 2).sum(axis=1)
        d[i] = np.inf
        out[tuple(v)] = sorted(d)[:k]
    return out


def distances(found):
    return {tuple(r.vec): [x.distance for x in (r.near or [])] for r in found.collect()}


def test_small_classes_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 8)), np.repeat(rng.normal(size=(1, 8)), 40, axis=0), rng.normal(size=(2, 8))])
    label = [0] * 100 + [1] * 90 + [2] * 2
    df = frame(spark, x, label)
    found = N.nearest(df, COLS)
    got = distances(found)
    for y in range(3):
        vecs = np.unique(x[np.array(label) == y], axis=0)
        for v, d in brute(vecs, 5).items():
            assert np.allclose(got[v], [z for z in d if z < np.inf]), y
    assert {r.copies for r in found.where("copies > 1").collect()} == {40}


@pytest.mark.parametrize("kind", ["normal", "clusters", "grid"])
def test_recall_on_large_classes(spark, kind):
    rng = np.random.default_rng(2)
    n = 6000
    if kind == "normal":
        x = rng.normal(size=(n, 8))
    elif kind == "clusters":
        x = rng.normal(size=(60, 8))[rng.integers(0, 60, n)] * 5 + rng.normal(size=(n, 8)) * 0.1
    else:  # whole numbers: many ties and copies, and one hot point
        x = np.where(rng.random((n, 1)) < 0.33, 0.0, rng.integers(0, 4, (n, 8)).astype(float))
    df = frame(spark, x, np.arange(n) % 50 == 0)  # one class of 98 %
    pts = N.staged(N.points(df, "label", COLS), "t-points")
    sizes = N.cells(pts, 8, leaf=128).groupBy("cls", "tree", "cell").count()
    assert sizes.agg(F.max("count")).first()[0] <= 128
    assert sizes.agg(F.sum("count")).first()[0] == N.TREES * pts.count()
    got = distances(N.nearest(df, COLS, leaf=128, pts=pts).where("cls = 0"))
    vecs = np.array(sorted(got))
    hits = total = 0
    for v in vecs[::50]:
        d = np.sort(((vecs - v) ** 2).sum(axis=1))[1:6]
        hits += sum(1 for z in got[tuple(v)] if z <= d[-1] + 1e-9)
        total += 5
    print(kind, hits / total)
    assert hits / total >= 0.9


def test_balancing_between_nearest_rows(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(40, 8)) + 3, np.repeat(rng.normal(size=(1, 8)), 7, axis=0), np.ones((1, 8))])
    label = [0] * 300 + [1] * 40 + [2] * 7 + [3]
    df = frame(spark, x, label)
    out = L.smote_balance(df, COLS)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 300}
    place = {(r.repo, r.number): np.array([r[c] for c in COLS]) for r in df.collect()}
    for r in out.where("synthetic").collect():
        a, b = place[r.source_repo, r.source_id], place[r.neighbour_repo, r.neighbour_id]
        assert np.allclose([r[c] for c in COLS], a + r.gap * (b - a)) and 0 <= r.gap < 1
        if r.label == 1:
            d = np.sort(((x[300:340] - a) ** 2).sum(axis=1))
            assert 0 < ((a - b) ** 2).sum() <= d[5] + 1e-9
        elif r.label == 2:
            assert (r.source_repo, r.source_id) != (r.neighbour_repo, r.neighbour_id)
    again = L.smote_balance(df.repartition(5), COLS)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_empty(spark):
    assert N.nearest(frame(spark, np.zeros((0, 8)), []), COLS).count() == 0
    one = N.nearest(frame(spark, np.zeros((1, 8)), [0]), COLS).collect()
    assert len(one) == 1 and one[0].near is None


def test_second_round_sends_only_pairs_that_can_count(spark):
    """Neighbours' neighbours leave the task only if new and no farther than the point's k-th; none that counts is left out."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    pts = N.staged(N.points(frame(spark, x, [0] * 300), "label", COLS), "t-points")
    k = 3
    # A poor first round: three of the 60 points of one cell.
    rows = pts.orderBy("node").collect()
    vecs, ids = np.array([r.vec for r in rows]), [r.node for r in rows]
    first = {}
    for i in range(300):
        d = ((vecs - vecs[i]) ** 2).sum(axis=1)
        own = [j for j in range(i // 60 * 60, i // 60 * 60 + 60) if j != i][: 30 + i % 20]
        first[ids[i]] = sorted((float(d[j]), ids[j]) for j in own)[:k]
    first[ids[7]] = first[ids[7]][:1]  # fewer than k: every one counts
    near = N.staged(spark.createDataFrame(list(first.items()), "node long, near array<struct<distance: double, other: long>>"), "t-near")
    got = {(r.node, x.other) for r in N._second(near, pts, k).collect() for x in r.near}
    at, want, every = {n: i for i, n in enumerate(ids)}, set(), set()
    for n, own in first.items():
        known, worst = {o for _, o in own}, own[-1][0] if len(own) == k else np.inf
        for _, via in own:
            for _, third in first[via]:
                if third != n and third not in known:
                    every.add((n, third))
                    if ((vecs[at[n]] - vecs[at[third]]) ** 2).sum() <= worst:
                        want.add((n, third))
    assert got == want and any(n == ids[7] for n, _ in got) and 2 * len(got) < len(every)


def test_points_that_stay_in_their_cell_are_not_placed_again(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 8)), rng.normal(size=(40, 8))])
    pts = N.staged(N.points(frame(spark, x, [0] * 300 + [1] * 40), "label", COLS), "t-points")
    placed = N.cells(pts, 8, leaf=64)
    plan = placed._jdf.queryExecution().toString()  # noqa: SLF001
    assert "LeftAnti" in plan and "lambda" not in plan
    found = placed.groupBy("cls", "tree").agg(F.countDistinct("node").alias("n"), F.count("*").alias("all"), F.countDistinct("cell").alias("cells")).collect()
    assert len(found) == 2 * N.TREES and all(r.n == r["all"] == (300 if r.cls == 0 else 40) for r in found)
    assert all((r.cells > 4) == (r.cls == 0) for r in found)


@pytest.mark.parametrize("n", [2, 5, 127, 128, 300])
def test_the_search_in_a_cell_is_exact_over_every_group_of_rows(n):
    v = np.random.default_rng(n).integers(0, 50, (n, 3)).astype(float) + np.arange(n)[:, None] / 1000
    row, other, far = N._near(v, 4)
    assert row.tolist() == np.repeat(np.arange(n), min(4, n - 1)).tolist() and (row != other).all()
    assert np.array_equal(far, sum((v[row, c] - v[other, c]) ** 2 for c in range(3)))
    assert [sorted(far[row == i]) for i in range(n)] == [sorted(((v[i] - np.delete(v, i, 0)) ** 2).sum(axis=1))[: min(4, n - 1)] for i in range(n)]
