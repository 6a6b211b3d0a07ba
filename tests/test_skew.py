"""Skew-safe operators against pandas on a key holding a third of all rows."""

import pandas as pd
from pyspark.sql import functions as F

from issuelens.operators.skew import best_per_key, prefix_aggregate, running_count


def _skewed(spark, n=3000):
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{i % 41}"
        rows.append((i, key, (i * 7919) % 1000, i % 5))
    return spark.createDataFrame(rows, "id long, key string, t long, v long")


def test_running_count_matches_cumcount(spark):
    df = _skewed(spark)
    got = running_count(df, ["key"], [F.col("t"), F.col("id")], "rc", slices=6).select("id", "rc").toPandas()
    pdf = df.toPandas().sort_values(["t", "id"])
    pdf["rc"] = pdf.groupby("key").cumcount()
    m = got.merge(pdf[["id", "rc"]], on="id", suffixes=("", "_exp"))
    assert len(m) == 3000 and (m.rc == m.rc_exp).all()


def test_prefix_sum_and_max(spark):
    df = _skewed(spark)
    got = prefix_aggregate(df, ["key"], [F.col("t"), F.col("id")],
                           [("s", "sum", F.col("v")), ("mx", "max", F.when(F.col("v") == 3, F.col("id")))],
                           slices=5).toPandas()
    pdf = df.toPandas().sort_values(["t", "id"])
    pdf["s_exp"] = pdf.groupby("key")["v"].cumsum()
    pdf["m3"] = pdf["id"].where(pdf["v"] == 3)
    pdf["mx_exp"] = pdf.groupby("key")["m3"].cummax()
    pdf["mx_exp"] = pdf.groupby("key")["mx_exp"].ffill()  # pandas leaves NaN where the value itself is NaN
    m = got.merge(pdf[["id", "s_exp", "mx_exp"]], on="id")
    assert (m.s == m.s_exp).all()
    assert ((m.mx == m.mx_exp) | (m.mx.isna() & m.mx_exp.isna())).all()


def test_hot_key_spans_several_slices(spark):
    df = _skewed(spark)
    sliced = df.repartitionByRange(6, "key", "t", "id").withColumn("p", F.spark_partition_id())
    n_parts = sliced.where(F.col("key") == "hot").select("p").distinct().count()
    assert n_parts >= 2  # the hot key is cut into several tasks


def test_best_per_key(spark):
    df = _skewed(spark)
    got = best_per_key(df, ["key"], [-F.col("v"), F.col("id")], ["key", "id", "v"]).toPandas()
    pdf = df.toPandas().sort_values(["v", "id"], ascending=[False, True]).drop_duplicates("key")
    m = got.merge(pdf, on="key", suffixes=("", "_exp"))
    assert len(m) == pdf.key.nunique() and (m.id == m.id_exp).all()


def test_dedup_keep_last_against_pandas(spark):
    from issuelens.operators.features import dedup_keep_last

    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, None), (4, None, None), (5, "a", None), (6, "", "")]
    df = spark.createDataFrame(rows, "number long, title string, body string")
    got = sorted(r.number for r in dedup_keep_last(df, "number").collect())
    pdf = pd.DataFrame(rows, columns=["number", "title", "body"]).drop_duplicates(["title", "body"], keep="last")
    assert got == sorted(pdf.number.tolist())


def test_null_keys_keep_their_carry_for_any_slice_count(spark):
    rows = [(None if i % 3 else "u", i) for i in range(300)]
    df = spark.createDataFrame(rows, "user string, n long")
    from issuelens.operators.skew import running_count
    from pyspark.sql import functions as F

    results = []
    for slices in (2, 6, 40):
        out = running_count(df, ["user"], [F.col("n")], "c", slices)
        results.append(sorted((r.user or "", r.n, r.c) for r in out.collect()))
    assert results[0] == results[1] == results[2]
    assert max(r[2] for r in results[0] if r[0] == "") == 199
