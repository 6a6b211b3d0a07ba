"""Registered consolidation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens import config as C
from issuelens.operators.consolidate import consolidate, consolidation_summary, keyed, unify_schema
from issuelens.plans.oracle_views import py_strip, with_views
from issuelens.plans.registry import query
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.sources import readers as R


def original_rows(spark, sf_dir) -> DataFrame:
    """The collected issue table as the 'original' source; every 29th row lost its number."""
    iss = FX.issues(spark, sf_dir)
    return iss.withColumn("number", F.when(F.col("number") % 29 == 0, F.lit(None).cast("bigint"))
                          .otherwise(F.col("number")))


def _sources(spark, sf_dir):
    return original_rows(spark, sf_dir), FX.feedback(spark, sf_dir)


_T = py_strip("human_label")
UNIFIED_SQL = with_views("issues", "feedback") + f""",
orig AS (
  SELECT CAST(NULL AS VARCHAR) AS "timestamp", repo,
         CAST(TRY_CAST(CAST(CASE WHEN number % 29 = 0 THEN NULL ELSE number END AS VARCHAR) AS DOUBLE) AS BIGINT)
           AS issue_number,
         title, body, array_to_string(labels, ',') AS labels,
         CAST(coalesce(TRY_CAST(CAST(comments AS VARCHAR) AS DOUBLE), 0) AS BIGINT) AS comments,
         CAST(NULL AS VARCHAR) AS target_label, 'original' AS source
  FROM issues),
fb AS (
  SELECT CAST("timestamp" AS VARCHAR) AS "timestamp", repo,
         CAST(TRY_CAST(CAST(issue_number AS VARCHAR) AS DOUBLE) AS BIGINT) AS issue_number,
         title, CAST(NULL AS VARCHAR) AS body, labels,
         CAST(coalesce(TRY_CAST(CAST(comments AS VARCHAR) AS DOUBLE), 0) AS BIGINT) AS comments,
         CASE WHEN {_T} <> '' THEN upper({_T}) END AS target_label, 'feedback' AS source
  FROM feedback),
u AS (SELECT * FROM orig UNION ALL SELECT * FROM fb),
k AS (
  SELECT *,
         CASE WHEN issue_number IS NOT NULL
              THEN {py_strip("coalesce(repo, '')")} || ':' || CAST(issue_number AS VARCHAR)
              ELSE {py_strip("coalesce(repo, '')")} || ':' || substr(lower({py_strip("coalesce(title, '')")}), 1, 128)
         END AS _key,
         CAST((CASE WHEN source = 'feedback' THEN 2 ELSE 0 END) * 1000000000
              + (CASE WHEN target_label IS NOT NULL THEN 1 ELSE 0 END) * 10000000
              + coalesce(CAST(epoch(TRY_CAST("timestamp" AS TIMESTAMP)) AS BIGINT), 0)
              + coalesce(comments, 0) AS BIGINT) AS _score
  FROM u)"""

_COLS = ", ".join(f'"{c}"' if c == "timestamp" else c for c in C.CONSOLIDATED_COLUMNS)
BEST_SQL = UNIFIED_SQL + """,
r AS (
  SELECT *, row_number() OVER (
    PARTITION BY _key
    ORDER BY _score DESC, source,
             epoch(TRY_CAST("timestamp" AS TIMESTAMP)) DESC NULLS LAST,
             title NULLS LAST, sha256(body) NULLS LAST, issue_number NULLS LAST, labels NULLS LAST, comments,
             target_label NULLS LAST, "timestamp" NULLS LAST) AS rn
  FROM k),
best AS (SELECT * FROM r WHERE rn = 1)"""


@query("unify_schema", UNIFIED_SQL + f"\nSELECT {_COLS} FROM u")
def q_unify_schema(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    return unify_schema(o, "original").unionByName(unify_schema(f, "feedback"))


@query("dedup_key", UNIFIED_SQL + "\nSELECT source, repo, issue_number, title, _key AS dedup_key FROM k")
def q_dedup_key(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    k = keyed(unify_schema(o, "original").unionByName(unify_schema(f, "feedback")))
    return k.select("source", "repo", "issue_number", "title", F.col("_key").alias("dedup_key"))


@query("preference_score", UNIFIED_SQL + "\nSELECT source, repo, issue_number, \"timestamp\", _score AS preference_score FROM k")
def q_preference_score(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    k = keyed(unify_schema(o, "original").unionByName(unify_schema(f, "feedback")))
    return k.select("source", "repo", "issue_number", "timestamp", F.col("_score").alias("preference_score"))


@query("consolidate_dedup", BEST_SQL + f"\nSELECT {_COLS} FROM best")
def q_consolidate_dedup(spark, sf_dir):
    """Consolidate, write the table (K4) to the shared folder and return the re-read result."""
    o, f = _sources(spark, sf_dir)
    out = scratch_path(spark, "consolidated")
    consolidate(o, f).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


CONSOLIDATED_SCHEMA = "timestamp string, repo string, issue_number bigint, title string, body string, labels string, comments bigint, target_label string, source string"


@query("consolidate_csv", BEST_SQL + f"\nSELECT {_COLS} FROM best")
def q_consolidate_csv(spark, sf_dir):
    """Both sources scanned as header CSV (whole numbers written ``3.0`` where the column has gaps, and ``nan``), the result exported as
    CSV and read back."""
    o, f = _sources(spark, sf_dir)
    floats = F.when(F.col("number") % 3 == 0, F.concat(F.col("number").cast("string"), F.lit(".0"))).otherwise(F.col("number").cast("string"))
    issues = o.select(F.coalesce(floats, F.lit("nan")).alias("number"), "repo", "title", "body", F.array_join("labels", ",").alias("labels"), "comments")
    log = f.withColumn("timestamp", F.col("timestamp").cast("string"))
    paths = [R.write_csv(df, scratch_path(spark, name)) for df, name in ((issues, "original-csv"), (log, "feedback-csv"))]
    issue_schema = T.StructType([T.StructField(c, T.LongType() if c in ("number", "comments") else T.StringType()) for c in issues.columns])
    log_schema = T.StructType([T.StructField(c, T.LongType() if c in ("issue_number", "comments") else T.StringType()) for c in log.columns])
    done = consolidate(R.read_csv(spark, paths[0], issue_schema), R.read_csv(spark, paths[1], log_schema))
    out = R.write_csv(done, scratch_path(spark, "consolidated-csv"))
    return R.read_csv(spark, out, T.StructType.fromDDL(CONSOLIDATED_SCHEMA))


@query("consolidate_by_source", BEST_SQL + """
SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM best GROUP BY 1""")
def q_consolidate_by_source(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    c = consolidate(o, f, payload=["source"])
    return c.groupBy(F.coalesce(F.col("source"), F.lit("unknown")).alias("source")).agg(
        F.count(F.lit(1)).alias("n"))


@query("consolidate_by_label", BEST_SQL + """
SELECT coalesce(target_label, 'UNKNOWN') AS target_label, count(*) AS n FROM best GROUP BY 1""")
def q_consolidate_by_label(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    c = consolidate(o, f, payload=["target_label"])
    return c.groupBy(F.coalesce(F.col("target_label"), F.lit("UNKNOWN")).alias("target_label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("consolidate_summary", UNIFIED_SQL + """
SELECT count(*) AS total_rows_before, count(DISTINCT _key) AS total_rows_after,
       count(*) - count(DISTINCT _key) AS duplicates_removed FROM k""")
def q_consolidate_summary(spark, sf_dir):
    o, f = _sources(spark, sf_dir)
    return consolidation_summary(o, f)
