"""Property tests (hypothesis) for dedup, label state and the split."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.operators.features import dedup_keep_last
from issuelens.operators.learn import stratified_split
from issuelens.operators.skew import prefix_aggregate
from tests.bruteforce import label_history

texts = st.sampled_from([None, "", "a", "b", "a b"])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(texts, texts), min_size=1, max_size=60))
def test_dedup_idempotent_and_exact(spark, pairs):
    rows = [(i, t, b) for i, (t, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "number long, title string, body string")
    once = dedup_keep_last(df, "number")
    twice = dedup_keep_last(once, "number")
    got = sorted(r.number for r in once.collect())
    assert got == sorted(r.number for r in twice.collect())
    assert len(got) == len({(t, b) for t, b in pairs})
    last = {}
    for i, t, b in rows:
        last[(t, b)] = i
    assert got == sorted(last.values())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.booleans(), st.sampled_from(["simple", "moderate", "complex"])),
                min_size=1, max_size=80))
def test_label_state_matches_simulation(spark, events):
    rows = [(d, issue, d * 7 % 101, cls, is_comment) for d, (issue, is_comment, cls) in enumerate(events)]
    df = spark.createDataFrame(rows, "delivery_id long, number long, t long, complexity string, is_comment boolean")
    pos = F.struct(F.col("t"), F.col("delivery_id"))
    aggs = [("lc", "max", F.when(F.col("is_comment"), pos))] + [
        (f"l_{c}", "max", F.when(F.col("complexity") == c, pos)) for c in ["complex", "moderate", "simple"]]
    h = prefix_aggregate(df, ["number"], [F.col("t"), F.col("delivery_id")], aggs, slices=3)
    present = [F.when(F.col(f"l_{c}").isNotNull() & (F.col("lc").isNull() | (F.col(f"l_{c}") >= F.col("lc"))),
                      F.lit("complexity:" + c)) for c in ["complex", "moderate", "simple"]]
    got = {r.delivery_id: r.s for r in h.select("delivery_id", F.concat_ws(",", *present).alias("s")).collect()}
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    sim = label_history([(r[1], i, "comment" if r[4] else "issue", r[3]) for i, r in enumerate(ordered)])
    exp = {r[0]: sim[i] for i, r in enumerate(ordered)}
    assert got == exp
    for r in rows:
        if r[4]:
            assert got[r[0]].count("complexity:") == 1  # a comment event leaves exactly one


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=120))
def test_split_sizes_and_disjoint(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "number long, label int")
    out = stratified_split(df).collect()
    assert sorted(r.number for r in out) == list(range(len(labels)))  # every row exactly once
    for c in set(labels):
        n = labels.count(c)
        assert sum(1 for r in out if r.label == c and r.is_test) == math.ceil(n * 0.2)
