"""Term model: the same terms and the same fit as the pipeline of Spark ML, over two bytes a term; edge rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from issuelens.operators import learn as L
from issuelens.operators import term_model as T

ODD = ["", " ", "x", "x y", "  x  y z ", "a\0b c", "\0", "İstanbul IŞIK", "ΟΔΟΣ", "naïve—dash don't stop_it 42% ½ ² ①", "日本語 テスト", "é x‍y", "𝔘 😀 b",
       "é" * 50 + " w" * 700, "a\nb\tc", "abcd abcdefgh abcdefghijkl"]


def test_terms_are_those_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(T, "CUT_CHARS", 40)
    monkeypatch.setattr(T, "HASHED", 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *(f"a{chr(c)}b C{chr(c)}D" for c in range(1, 0x250))])], "i long, text string")
    for buckets, kind in ((1 << 16, np.uint16), (1000, np.uint16), ((1 << 17) + 1, np.uint32)):
        want = {r.i: r._tf for r in PipelineModel(L._term_stages(buckets)).transform(df).select("i", "_tf").collect()}
        got = {r.i: np.unique(np.frombuffer(r._terms, kind), return_counts=True) for r in T.coded(df, buckets).collect()}
        assert got.keys() == want.keys()
        for i, v in want.items():
            assert got[i][0].tolist() == v.indices.tolist() and got[i][1].tolist() == v.values.tolist()


def test_the_fit_takes_the_steps_of_the_pipeline(spark, monkeypatch):
    monkeypatch.setattr(T, "SUMMED", 50)
    monkeypatch.setattr(T, "BLOCK_TERMS", 300)
    monkeypatch.setattr(T, "BLOCK_ROWS", 9)
    monkeypatch.setattr(T, "DIRECT_TASKS", 2)  # sums of the three tasks are merged in a tree
    rng = np.random.default_rng(4)
    rows = [(i, i % 3 if i % 7 else 0, " ".join(["same", *(f"w{int(k)}" for k in rng.integers(0, 40 + 9 * (i % 3), i % 23))])) for i in range(150)]
    df = spark.createDataFrame([*rows, (150, 1, "")], "i long, label int, text string").repartition(3)
    spark_model = L.text_pipeline(512, 25).fit(df).stages[-1]
    model = T.fit(T.coded(df, 512).select("label", "_terms"), 512, 25)
    assert model.losses == pytest.approx(list(spark_model.summary.objectiveHistory), rel=1e-9)
    apart = spark_model.interceptVector.toArray()
    assert model.offset - model.offset[0] == pytest.approx(apart - apart[0], abs=1e-7)


def test_edge_rows_of_the_term_model(spark):
    df = spark.createDataFrame([(0, 1, "a b"), (1, 1, None), (2, 1, "c")], "i long, label int, text string")
    one = {r.i: [r[c] for c in L.PROB_COLS] for r in L.fitted_text_probabilities(df, F.lit(True), buckets=64).collect()}
    assert one == {i: [0.0, 1.0, 0.0] for i in range(3)}  # one class alone is certain
    two = df.withColumn("label", (F.col("i") % 2).cast("int"))
    model = T.fit(T.coded(two, 64).select("label", "_terms"), 64, 20)
    blank = T.score(model, T.coded(spark.createDataFrame([(9, None), (10, "")], "i long, text string"), 64)).collect()
    assert [list(r[1:]) for r in blank] == [pytest.approx((np.exp(model.offset) / np.exp(model.offset).sum()).tolist())] * 2
    for bad in (F.lit(None).cast("int"), F.lit(3)):
        with pytest.raises(Exception, match="labels must be whole numbers"):
            T.fit(T.coded(df.withColumn("label", bad), 64).select("label", "_terms"), 64, 5)
    with pytest.raises(ValueError, match="no row"):
        T.fit(T.coded(df.limit(0), 64).select("label", "_terms"), 64, 5)
