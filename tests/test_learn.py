"""Learning operators: split sizes, balancing invariants, evaluation math."""

import math
import random

import pytest
from pyspark.sql import functions as F

from issuelens.operators import learn as L
from issuelens.plans import learn_q as Q


def _skewed_labels(spark, n=900):
    # Class 0 holds two thirds of the rows.
    rows = [(i, 0 if i % 3 else (1 if i % 2 else 2), float(i % 17), float((i * 7) % 13)) for i in range(n)]
    return spark.createDataFrame(rows, "number long, label int, a double, b double")


def test_stratified_split_sizes(spark):
    df = _skewed_labels(spark)
    out = L.stratified_split(df).toPandas()
    for lab, g in out.groupby("label"):
        assert g.is_test.sum() == math.ceil(len(g) * 0.2)
    # deterministic: same seed -> same split
    again = L.stratified_split(df).toPandas().set_index("number").is_test
    assert (out.set_index("number").is_test == again.loc[out.number].values).all()


def test_smote_balances_and_interpolates(spark):
    df = _skewed_labels(spark)
    bal = L.smote_balance(df, ["a", "b"]).toPandas()
    counts = bal.groupby("label").size()
    assert counts.nunique() == 1 and counts.iloc[0] == df.groupBy("label").count().toPandas()["count"].max()
    orig = df.toPandas().set_index("number")
    syn = bal[bal.synthetic]
    assert len(syn) > 0
    for r in syn.itertuples():
        s, nb = orig.loc[r.source_id], orig.loc[r.neighbour_id]
        assert s.label == r.label == nb.label  # same class on both ends
        assert r.source_id != r.neighbour_id
        for c in ("a", "b"):
            lo, hi = min(s[c], nb[c]), max(s[c], nb[c])
            assert lo - 1e-9 <= getattr(r, c) <= hi + 1e-9  # on the segment


def test_weighted_metrics_match_definition(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)] * 1 + [(2, 2)] * 4 + [(1, 2)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    w = L.weighted_metrics(L.confusion(df)).first()
    # brute force
    classes = sorted({p for pr in pairs for p in pr})
    n = len(pairs)
    prec, rec, f1, sup = {}, {}, {}, {}
    for c in classes:
        tp = sum(1 for y, p in pairs if y == c and p == c)
        pp = sum(1 for _, p in pairs if p == c)
        s = sum(1 for y, _ in pairs if y == c)
        prec[c] = tp / pp if pp else 0.0
        rec[c] = tp / s if s else 0.0
        f1[c] = 2 * prec[c] * rec[c] / (prec[c] + rec[c]) if prec[c] + rec[c] else 0.0
        sup[c] = s
    acc = sum(1 for y, p in pairs if y == p) / n
    assert abs(w.accuracy - acc) < 1e-12
    assert abs(w.precision - sum(prec[c] * sup[c] for c in classes) / n) < 1e-12
    assert abs(w.recall - sum(rec[c] * sup[c] for c in classes) / n) < 1e-12
    assert abs(w.f1 - sum(f1[c] * sup[c] for c in classes) / n) < 1e-12


def test_stacked_probabilities_normalised(spark):
    rows = [(i, i % 3, float(i % 3) + (i % 7) / 10.0, float(i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "number long, label int, a double, b double")
    model = L.fit_stacked(df.where("number % 4 > 0"), df.where("number % 4 = 0"), ["a", "b"])
    pred = L.predict_stacked(model, df)
    s = pred.select((F.col("p_simple") + F.col("p_moderate") + F.col("p_complex")).alias("s"), "prediction",
                    "label").toPandas()
    assert ((s.s - 1).abs() < 1e-9).all()
    assert (s.prediction == s.label).mean() > 0.9  # learnable label


def test_split_keeps_rows_when_numbers_repeat(spark):
    rows = [("r%d" % (i % 5), i // 5, i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "repo string, number long, label int")
    out = L.stratified_split(df)
    assert out.count() == 150
    assert out.where("is_test").count() == 30


def test_texts_are_cut_into_terms_once_for_the_same_model(spark, monkeypatch):
    words = ["crash", "typo", "slow", "leak", "docs", "cache"]
    rows = [(i, i % 3, i % 5 == 0, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 7))) for i in range(60)] + [(60, 1, False, ""), (61, 2, True, "unseen")]
    df = spark.createDataFrame(rows, "number long, label int, is_test boolean, text string")
    made = []
    staged = L.staged
    monkeypatch.setattr(L, "staged", lambda d, name: (made.append(name), staged(d, name))[1])
    got = L.fitted_text_probabilities(df, ~F.col("is_test"), buckets=256, max_iter=20)
    assert made == ["text-terms"] and got.columns == ["number", "label", "is_test", *L.PROB_COLS]
    want = L.text_probabilities(L.text_pipeline(256, 20).fit(df.where(~F.col("is_test")).select("text", "label")), df)
    a, b = ({r.number: [r[c] for c in L.PROB_COLS] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], abs=1e-6) for i in a)


def test_every_nearer_point_is_counted_over_groups_of_any_size(spark, monkeypatch):
    rng = random.Random(4)
    pts = [(rng.randrange(3), [float(rng.randrange(6)), rng.uniform(0, 900), float(rng.randrange(2))]) for _ in range(400)]
    pts += [(0, v) for _, v in pts[:20]] + [(2, [3.0, 1e9, 0.0])]
    few = [(c, "r", i, "s", i + 1, v, rng.choice([0.0, 4.0, 900.0, 1e7])) for i, (c, v) in enumerate(pts[::9])] + [(7, "r", 999, "s", 1, [0.0, 0.0, 0.0], 5.0)]
    distinct = {(c, tuple(v)) for c, v in pts}
    want = {}
    for c, _, i, _, _, v, gone in few:
        far = lambda w, v=v: sum((a - b) ** 2 for a, b in zip(v, w))
        want[i] = sum(1 for k, w in distinct if k == c and w != tuple(v) and far(w) < gone)
    monkeypatch.setattr(Q, "POINTS_A_GROUP", 60)
    monkeypatch.setattr(Q, "BASES_A_GROUP", 10)
    bases = spark.createDataFrame(few, "label int, source_repo string, source_id long, neighbour_repo string, neighbour_id long, source_v array<double>, gone double")
    got = Q.closer_points(bases, spark.createDataFrame(pts, "label int, v array<double>").distinct())
    assert {i: k for i, k in want.items() if k} == {r.source_id: r.k for r in got.collect() if r.k}


def test_the_narrow_step_sees_no_text_and_texts_meet_their_rows(spark):
    rows = [("org/r%d" % (i % 3), i, "u%d" % (i % 4), None if i % 7 == 0 else f"t{i % 20}", None if i % 5 == 0 else f"b{i % 10}", i % 9, ["x"]) for i in range(120)]
    issues = spark.createDataFrame(rows, "repo string, number long, author string, title string, body string, comments long, labels array<string>")
    issues = issues.withColumn("created_at", F.timestamp_seconds("number"))
    seen = []
    got = L.training_frame(issues, lambda narrow: (seen.append(narrow.columns), L.stratified_split(narrow))[1])
    assert "text" not in seen[0] and "title" not in seen[0] and "_k_body" in seen[0]
    want = L.stratified_split(L.training_frame(issues))
    key = lambda d: sorted((r.repo, r.number, r.text, r.label, r.is_test) for r in d.collect())
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
    last = {}
    for repo, number, _, title, body, *_ in rows:
        last[title, body] = (repo, number, f"{title or ''} {body or ''}")
    assert sorted((r[0], r[1], r[2]) for r in key(got)) == sorted(last.values())
