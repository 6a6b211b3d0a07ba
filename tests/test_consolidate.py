"""Consolidation on edge fixtures against a plain-Python evaluation."""

from issuelens.operators.consolidate import consolidate, consolidation_summary

LONG = "x" * 128


def test_consolidate_edges(spark):
    original = [
        # repo, number, title, body, labels, comments
        ("o/r", 1, "Crash on start", "b1", ["bug"], 3),
        ("o/r", 2, "Slow", "b2", [], None),
        (" o/r ", None, LONG + "A", "b3", ["x"], 1),
        ("o/r", None, LONG + "B", "b4", [], 2),     # same 128-char key as the row above
        ("o/r", 7, "Only original", None, None, 0),
    ]
    feedback = [
        # timestamp, repo, issue_number, title, labels, comments, predicted_complexity, human_label
        ("2024-03-01 00:00:00", "o/r", 1, "Crash on start", "bug", 3, "simple", "complex"),
        ("2023-10-01 00:00:00", "o/r", 2, "Slow", "", 0, "moderate", "simple"),     # older, labelled
        ("2024-03-01 00:00:00", "o/r", 2, "Slow", "", 0, "moderate", None),         # newer, unlabelled
        ("not a time", "o/r", 9, "Bad ts", "", 1, "simple", "  "),                  # blank label -> null
        ("2024-01-01 00:00:00", "o/r", 9, "Bad ts", "", 1, "simple", None),
    ]
    odf = spark.createDataFrame(original, "repo string, number long, title string, body string, "
                                          "labels array<string>, comments long")
    fdf = spark.createDataFrame(feedback, "timestamp string, repo string, issue_number long, title string, "
                                          "labels string, comments long, predicted_complexity string, "
                                          "human_label string")
    got = {(r.repo, r.issue_number, r.title): r for r in consolidate(odf, fdf).collect()}

    # Winners by hand: feedback beats original; between feedback rows a label is worth 10,000,000 seconds.
    expected = {
        ("o/r", 1, "Crash on start"): ("feedback", "COMPLEX", "2024-03-01 00:00:00"),
        ("o/r", 2, "Slow"): ("feedback", None, "2024-03-01 00:00:00"),
        ("o/r", None, LONG + "B"): ("original", None, None),  # two comments beat one under the same key
        ("o/r", 7, "Only original"): ("original", None, None),
        ("o/r", 9, "Bad ts"): ("feedback", None, "2024-01-01 00:00:00"),  # an unreadable time counts as 1970
    }
    assert {k: (r.source, r.target_label, r.timestamp) for k, r in got.items()} == expected

    # the labelled feedback row is > 116 days older: recency outweighs the label (the reference's sum)
    assert got[("o/r", 2, "Slow")].target_label is None
    summary = consolidation_summary(odf, fdf).first()
    assert summary.total_rows_before == 10
    assert summary.total_rows_after == 5
    assert summary.duplicates_removed == 5


def test_float_text_nan_and_offsets(spark):
    from issuelens.operators.consolidate import epoch_seconds, unify_schema
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("o/r", "3.0", "2.0"), ("o/r", "nan", "NaN"), ("o/r", "x", None)],
                               "repo string, number string, comments string")
    got = [(r.issue_number, r.comments) for r in unify_schema(df, "original").collect()]
    assert got == [(3, 2), (None, 0), (None, 0)]
    times = spark.createDataFrame([("1970-01-01 05:30:00+05:30",), ("1970-01-01T00:00:10Z",), ("1970-01-01 00:01:00",), ("x",)],
                                  "t string")
    assert [r[0] for r in times.select(epoch_seconds(F.col("t"))).collect()] == [0, 10, 60, None]
