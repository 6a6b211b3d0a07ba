"""Whitening against exact integer sums and a plain eigendecomposition, and edge tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import queries, whiten  # noqa: F401
from issuelens.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string, whitened string, id long"  # extra columns with clashing names


def frame(spark, vectors, kind="float"):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "n", "w", 7) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA.replace("float", kind))


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top, n in ((5, 200), (1 << 20, 131), (1 << 45, 70)):
        x = rng.integers(-top, top, (n, 7)) + 1_000_000
        s, c = whiten.scatter(x)
        whole = x.astype(object)
        assert list(s) == list(whole.sum(axis=0))
        assert (c == whole.T @ whole).all()
    assert [sum(p << (40 * k) for k, p in enumerate(whiten.limbs(v))) for v in (0, -1, 3**70, -(3**90), 2**40)] == [0, -1, 3**70, -(3**90), 2**40]


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 40, 1 << 58])
def test_squares_are_exact(top):
    a = np.random.default_rng(1).integers(-top, top, (9, 130))
    assert whiten.squares(a) == [sum(x * x for x in row) for row in a.tolist()]


def plain(vectors):
    x = [[math.floor(64 * Fraction(float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(row[d] for row in x) for d in range(dims)]
    v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in x) - s[i] * s[j], n * n)) for j in range(dims)] for i in range(dims)])
    return x, s, v


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_equals_plain_whitening(spark, tmp_path, partitions):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(40, 40)) * np.geomspace(3, 0.05, 40)
    good = [(i, rng.normal(size=40) @ mix) for i in range(180)]
    good += [(i, good[0][1]) for i in range(180, 240)]  # many copies of one vector
    bad = [(900, None), (901, [math.nan] * 40), (902, [math.inf] + [0.0] * 39), (903, [None] + [1.0] * 39), (904, []), (905, [1.0] * 39), (906, [3e38] * 40)]
    frame(spark, good + bad).repartition(partitions).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).toPandas()
    x, s, v = plain([c for _, c in good])
    n = len(x)
    assert set(got.vec_id) == {i for i, _ in good} and len(got) == n * 32 and (got.n == n).all()
    e = np.linalg.eigvalsh(v)[::-1]
    white = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert list(got.component.drop_duplicates().sort_values()) == list(range(1, 33))
    seen = white.T @ white / n - np.outer(white.mean(axis=0), white.mean(axis=0))
    assert np.abs(seen - np.eye(32)).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    shares = got.groupby("component").explained.agg(["min", "max"])
    assert (shares["min"] == shares["max"]).all() and np.allclose(shares["min"], e[:32] / np.trace(v), rtol=1e-9)
    want = [sum((n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    assert got.groupby("vec_id").deviation.first().tolist() == want
    # Undone, the components give back the part of each row that they span.
    basis = whiten.basis(n, s, [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(40)] for i in range(40)], 40)
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(row, s)] for row in x])
    assert np.allclose(white, centred @ basis.projection[:, :32], atol=1e-8)


def test_components_without_variance(spark):
    rows = [(i, [1.0, 2.0 * (i % 2), 2.0 * (i % 2)]) for i in range(6)]
    got = whiten.whiten(frame(spark, rows, "double"), keep=["whitened", "id"])
    assert got.columns == ["id", "n", "deviation", "whitened", "explained", "identity_error", "whitened", "id"]
    got = got.toDF("key", "n", "deviation", "w", "explained", "error", "x", "y").orderBy("key").collect()
    assert [r.x for r in got] == ["w"] * 6
    for r in got:
        assert abs(abs(r.w[0]) - 1) < 1e-12 and r.w[1:] == [0.0, 0.0] and r.error < 1e-12
        assert abs(r.explained[0] - 1) < 1e-12 and r.explained[1:] == [0.0, 0.0]
        assert r.deviation == 2 * (6 * 64) ** 2
    one = whiten.whiten(frame(spark, [(None, [0.5, -0.5])])).collect()
    assert [(r.id, r.n, int(r.deviation), r.whitened, r.identity_error) for r in one] == [(None, 1, 0, [0.0, 0.0], 0.0)]


def test_wide_entries_and_deviations_beyond_a_long(spark):
    rows = [(i, [float(i * 2**44), 1.0, -float(i % 3)]) for i in range(50)]
    got = whiten.whiten(frame(spark, rows, "double")).orderBy("id").collect()
    x, s, v = [[math.floor(64 * c) + 1_000_000 for c in r] for _, r in rows], None, None
    s = [sum(r[d] for r in x) for d in range(3)]
    for r, row in zip(got, x):
        want = sum((50 * c - t) ** 2 for c, t in zip(row, s))
        assert want > 1 << 63 and int(r.deviation) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, [])], [(1, [math.nan])]])
def test_no_usable_rows(spark, rows):
    assert whiten.whiten(frame(spark, rows)).count() == 0


def test_deviations_beyond_38_digits_are_null(spark):
    got = whiten.whiten(frame(spark, [(1, [2.0**54]), (2, [-(2.0**54)]), (3, [2.0**56])], "double")).orderBy("id").collect()
    assert [(r.id, r.n, r.deviation) for r in got] == [(1, 2, 4 * 2**120), (2, 2, 4 * 2**120)]
    many = [(i, [(-1.0) ** i * 2.0**54]) for i in range(40)]
    assert whiten.whiten(frame(spark, many, "double")).where("deviation is null").count() == 40


def test_repeated_ids_stay(spark):
    rows = [(5, [0.0, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [2.0, 3.0])]
    got = whiten.whiten(frame(spark, rows))
    assert got.count() == 4 and got.where(F.col("id").isNull()).count() == 1
