"""Collection operators: page filters, per-repo cap, incremental append,
resume anti-join, monitored-set maintenance, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions import text as TX
from issuelens.operators.commit_log import CommitLog
from issuelens.operators.skew import best_per_key

SALTS = 16

def collect_issues(rows: DataFrame, include_closed: bool = C.INCLUDE_CLOSED, min_comments: int = C.MIN_COMMENTS,
                   max_per_repo: int | None = C.MAX_ISSUES_PER_REPO) -> DataFrame:
    """Drop pull requests, apply the state and comment filters, keep the newest
    ``max_per_repo`` issues of each repository.

    The cap bounds one collection run; ``None`` takes every issue (counts over
    merged tables).  See ``newest_per_key`` for hot repositories.
    """
    f = rows.where(~F.col("_is_pr"))
    if not include_closed:
        f = f.where(F.col("state") == "open")
    f = f.where(F.coalesce(F.col("comments"), F.lit(0)) >= min_comments)
    if max_per_repo is None:
        return f.drop("_is_pr")
    return newest_per_key(f.drop("_is_pr"), ["repo"], ["created_at", "number"], max_per_repo)


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str], n: int, salts: int = SALTS) -> DataFrame:
    """The ``n`` rows per key that are last in ``order``, whole rows touched once.

    Two levels on narrow rows (key, order, hash of the row): the last n of each of ``salts`` parts of a key, then the last n
    of these.  The n-th place is the key's cut: one short row per key, against which the whole rows are held where
    they are.  Rows equal in everything share a place; of those at the cut as many stay as fit.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*rows.columns).alias("h"))
    narrow = rows.select(*keys, place.alias("_at")).withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(F.col("_at").desc())
    some = narrow.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    every = Window.partitionBy(*keys)
    last = some.withColumn("_rn", F.row_number().over(every.orderBy(F.col("_at").desc()))).where(F.col("_rn") <= n)
    cuts = last.withColumn("_cut", F.min("_at").over(every)).groupBy(*[F.col(c).alias(f"_k_{c}") for c in keys], "_cut").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_at") == F.col("_cut")).cast("int").alias("_fit"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    held = rows.withColumn("_at", place).join(cuts.where(F.col("_n") == n), same, "left")
    above = held.where(F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))).select(*rows.columns)
    at = held.where(F.col("_at") == F.col("_cut")).groupBy(*[f"_k_{c}" for c in keys], "_at").agg(
        F.first(F.struct(*rows.columns)).alias("_row"), F.first("_fit").alias("_fit"))
    return above.unionByName(at.select(F.explode(F.array_repeat("_row", F.col("_fit"))).alias("_row")).select("_row.*"))


def incremental_append(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing + rows of ``new`` whose (repo, number) is not in ``existing``.

    Both key parts compared as text (as the reference does), on two columns so
    no separator can make keys collide.  Duplicates inside ``new`` are kept.
    The anti-join is planned by AQE: broadcast when the existing keys turn out
    small at runtime, shuffled otherwise.
    """
    ek = existing.select(F.col("repo").cast("string").alias("_r"), F.col("number").cast("string").alias("_n"))
    nk = new.withColumn("_r", F.col("repo").cast("string")).withColumn("_n", F.col("number").cast("string"))
    fresh = nk.join(ek, ["_r", "_n"], "left_anti").drop("_r", "_n")
    return existing.unionByName(fresh, allowMissingColumns=True)


def remaining_repos(configured: DataFrame, completed: DataFrame) -> DataFrame:
    """Configured repositories not yet completed (resume after a crash)."""
    return configured.join(completed, "repo", "left_anti")


def monitored_repos(changes: DataFrame, initial: list[str] = C.MONITORED_REPOS) -> DataFrame:
    """Apply a log of add/remove requests to the configured set.

    Names are trimmed, blanks rejected; the last request per repository (by
    time, then request id) decides membership.  The last-request pick is an
    aggregate, so a repository with a huge request history is collapsed
    map-side.  ``changes``: repo, op ('add'|'remove'), ts, request_id.
    """
    spark = changes.sparkSession
    base = spark.createDataFrame([(r,) for r in initial], "repo string").withColumn("_member", F.lit(True))
    ch = changes.withColumn("repo", TX.py_strip(F.col("repo"))).where(F.col("repo") != "")
    last = best_per_key(ch, ["repo"], [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("request_id")],
                        ["repo", "op"])
    decided = last.select("repo", (F.col("op") == "add").alias("_member"))
    # Configured repos without any request keep their membership.
    untouched = base.join(decided.select("repo"), "repo", "left_anti")
    return untouched.unionByName(decided).where(F.col("_member")).select("repo")


def monitored_semi(rows: DataFrame, monitored: DataFrame) -> DataFrame:
    """Rows whose repository is currently monitored (left semi join)."""
    return rows.join(monitored, "repo", "left_semi")


def issues_per_repo(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("repo"))


# ---------------------------------------------------------------- snapshots
def write_snapshot(df: DataFrame, root: str, batch: str | None = None) -> int | None:
    """Commit a new snapshot; earlier ones stay as versions.  A writer that dies leaves nothing readers would take."""
    return CommitLog(df.sparkSession, root).write(df, batch, replace=True)


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed snapshot."""
    return CommitLog(spark, root).read()
