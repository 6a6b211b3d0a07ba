"""Minimum covariance determinant: several starts, steps to the end, the smallest determinant, against plain numpy."""

import numpy as np
import pytest

from issuelens.llm import outliers

COLUMNS = "lang string, source string, " + ", ".join(f"x{i} double" for i in range(outliers.DIM))


def frame(spark, groups):
    return spark.createDataFrame([(g, "s", *map(float, x)) for g, rows in groups.items() for x in rows], COLUMNS)


def scatter(x, share):
    s = np.cov(x.T, bias=True) * outliers.consistency(share) + np.diag(np.square(outliers.FLOOR))
    return x.mean(axis=0), s


def plain(x, tries, rng):
    """The smallest determinant that concentration steps from random starts reach."""
    h, best = int(np.ceil(outliers.SHARE * len(x))), np.inf
    for _ in range(tries):
        m, s = scatter(x[rng.choice(len(x), 8, replace=False)], outliers.SHARE)
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            chosen = np.sort(np.argsort(d, kind="stable")[:h])
            m, s = scatter(x[chosen], outliers.SHARE)
        best = min(best, np.linalg.slogdet(s)[1])
    return best


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(7)
    near = rng.normal(size=(300, 4)) * [0.5, 0.1, 0.2, 0.05] + [5, 1, 0.5, 0.2]
    shifted = np.concatenate([near[:240], rng.normal(size=(60, 4)) * 0.01 + [9, 3, 1, 0.9]])  # a fifth in one far spot
    wide = np.concatenate([near[:230], rng.normal(size=(70, 4)) * [6, 2, 2, 2] + [5, 1, 0.5, 0.2]])
    turned = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + [5, 1, 0.5, 0.2]
    return {"near": near, "shifted": shifted, "wide": wide, "turned": turned}


def test_ends_have_the_smallest_determinant(spark, groups):
    ends = outliers.concentrated(frame(spark, groups)).collect()
    rng = np.random.default_rng(1)
    for name, x in groups.items():
        mine = [r.log_det for r in ends if r.lang == name]
        assert len(mine) == 3
        # Grid cells of two per cent take a row more or less than the plain version.
        assert min(mine) <= plain(x, 40, rng) + 0.1, name


def test_estimates_ignore_the_outliers(spark, groups):
    fit = {r.lang: r for r in outliers.estimates(frame(spark, groups)).collect()}
    clean_m, clean_s = groups["near"].mean(axis=0), np.cov(groups["near"].T)
    for name in ("near", "shifted", "wide"):
        r = fit[name]
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose([r[f"m{i}"] for i in range(4)], clean_m, atol=0.1), name
        # Reweighted and corrected, the scatter of normal rows is neither too small nor blown up.
        got, want = np.diag(low @ low.T), np.diag(clean_s) + np.square(outliers.FLOOR)
        assert np.all(got > 0.8 * want) and np.all(got < 1.6 * want), (name, got / want)


def test_steps_stop_by_themselves(spark, groups, monkeypatch):
    seen = []
    real = outliers._nearest
    monkeypatch.setattr(outliers, "_nearest", lambda *a: seen.append(1) or real(*a))
    outliers.concentrated(frame(spark, groups))
    assert len(seen) < outliers.MOST_STEPS // 3
    constant = {"c": np.tile([5.0, 0.0, 0.0, 0.0], (40, 1))}
    assert len(outliers.estimates(frame(spark, constant)).collect()) == 1
    assert outliers.estimates(frame(spark, {})).count() == 0


def test_statistics_of_a_text_of_many_megabytes(spark):
    body = " ".join(f"w{i}" for i in range(500_000))
    lines = "the same eight words stand here once more\n" * 50_000
    rows = [(1, body), (2, lines), (3, body + "\n" + body)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in outliers.judge(docs).collect()}
    assert [(got[i].n_words, got[i].n_repeat_words) for i in (1, 2, 3)] == [(500_000, 0), (400_000, 400_000), (1_000_000, 1_000_000)]
    assert [got[i].n_dup_lines for i in (1, 2, 3)] == [0, 49_999, 1] and got[1].word_chars == sum(map(len, body.split()))
    assert [got[i].base_failed for i in (1, 2, 3)] == [False, True, True]
