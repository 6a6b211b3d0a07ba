"""Registered collection queries."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators.collect import (
    collect_issues,
    incremental_append,
    issues_per_repo,
    latest_snapshot,
    monitored_repos,
    monitored_semi,
    remaining_repos,
    write_snapshot,
)
from issuelens.operators.commit_log import CommitLog, collect_run
from issuelens.plans.oracle_views import with_views
from issuelens.plans.registry import query
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.sources import readers as R

ISO_SQL = "%Y-%m-%dT%H:%M:%SZ"

PAGES_SQL = with_views("issues") + f""",
pages AS (
  SELECT number, repo, coalesce(title, '') AS title, coalesce(body, '') AS body,
         array_to_string(labels, ', ') AS labels, CAST(coalesce(comments, 0) AS BIGINT) AS comments,
         strftime(created_at, '{ISO_SQL}') AS created_at,
         strftime(created_at + INTERVAL 1 HOUR, '{ISO_SQL}') AS updated_at,
         CASE WHEN state = 'closed' THEN strftime(created_at + INTERVAL 2 HOUR, '{ISO_SQL}') ELSE '' END AS closed_at,
         state, author AS "user", is_pr
  FROM issues)"""


def landed_pages(spark, sf_dir):
    """Land the issue pages of every repository, then scan them back."""
    path = R.land_issue_pages(FX.issues(spark, sf_dir), scratch_path(spark, "pages"))
    return R.normalize_issue_pages(R.read_issue_pages(spark, path))


@query("issue_pages_normalize", PAGES_SQL + "\nSELECT * FROM pages")
def q_issue_pages_normalize(spark, sf_dir):
    return landed_pages(spark, sf_dir).withColumnRenamed("_is_pr", "is_pr")


CSV_SQL = with_views("issues") + f"""
SELECT number, repo, title, body, array_to_string(labels, ', ') AS labels, comments,
       strftime(created_at, '{ISO_SQL}') AS created_at,
       strftime(created_at + INTERVAL 1 HOUR, '{ISO_SQL}') AS updated_at,
       CASE WHEN state = 'closed' THEN strftime(created_at + INTERVAL 2 HOUR, '{ISO_SQL}') END AS closed_at,
       state, author AS "user"
FROM issues"""


@query("issues_csv_scan", CSV_SQL)
def q_issues_csv_scan(spark, sf_dir):
    """Write the issue table as header CSV (multi-line quoted bodies) and scan it back."""
    iss = FX.issues(spark, sf_dir)
    flat = iss.select(
        "number", "repo", "title", "body", F.array_join("labels", ", ").alias("labels"), "comments",
        F.date_format("created_at", R.ISO).alias("created_at"),
        F.date_format(F.col("created_at") + F.expr("INTERVAL 1 HOUR"), R.ISO).alias("updated_at"),
        F.when(F.col("state") == "closed", F.date_format(F.col("created_at") + F.expr("INTERVAL 2 HOURS"), R.ISO)
               ).alias("closed_at"),
        "state", F.col("author").alias("user"),
    )
    path = R.write_csv(flat, scratch_path(spark, "issues-csv"))
    return R.read_csv(spark, path)


def _collect_sql(include_closed: bool, min_comments: int, cap: int) -> str:
    state = "" if include_closed else "AND state = 'open'"
    return PAGES_SQL + f""",
f AS (SELECT * FROM pages WHERE NOT is_pr {state} AND comments >= {min_comments}),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, number DESC) AS rn FROM f)
SELECT number, repo, title, body, labels, comments, created_at, updated_at, closed_at, state, "user"
FROM r WHERE rn <= {cap}"""


@query("collect_issues", _collect_sql(C.INCLUDE_CLOSED, C.MIN_COMMENTS, C.MAX_ISSUES_PER_REPO))
def q_collect_issues(spark, sf_dir):
    """Collection with the configured settings (all states, >= 0 comments, 1000 per repo)."""
    return collect_issues(landed_pages(spark, sf_dir))


OPEN_CAP = 10


@query("collect_recent_open", _collect_sql(False, 1, OPEN_CAP))
def q_collect_recent_open(spark, sf_dir):
    """Collection of open, discussed issues: the 10 newest per repository."""
    return collect_issues(landed_pages(spark, sf_dir), include_closed=False, min_comments=1, max_per_repo=OPEN_CAP)


@query("issues_per_repo", _collect_sql(C.INCLUDE_CLOSED, C.MIN_COMMENTS, 1 << 62).replace(
    'SELECT number, repo, title, body, labels, comments, created_at, updated_at, closed_at, state, "user"\nFROM r',
    "SELECT repo, count(*) AS n\nFROM r") + " GROUP BY repo")
def q_issues_per_repo(spark, sf_dir):
    """Over everything landed: the cap bounds one collection run, not the table."""
    return issues_per_repo(collect_issues(landed_pages(spark, sf_dir), max_per_repo=None))


# ----------------------------------------------------- incremental append
def _window_bounds(spark, sf_dir):
    b = FX.issues(spark, sf_dir).agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi")).first()
    return b["lo"], b["hi"]


INCR_SQL = with_views("issues") + """,
b AS (SELECT min(created_at) AS lo, max(created_at) AS hi FROM issues),
t AS (SELECT lo + (hi - lo) * 0.6 AS t_old, lo + (hi - lo) * 0.4 AS t_new, lo + (hi - lo) * 0.9 AS t_refetch FROM b),
existing AS (SELECT i.* FROM issues i, t WHERE i.created_at < t.t_old),
new AS (SELECT i.* FROM issues i, t WHERE i.created_at >= t.t_new
        UNION ALL SELECT i.* FROM issues i, t WHERE i.created_at >= t.t_refetch),
fresh AS (SELECT * FROM new n WHERE NOT EXISTS (
            SELECT 1 FROM existing e WHERE CAST(e.repo AS VARCHAR) = CAST(n.repo AS VARCHAR)
                                       AND CAST(e.number AS VARCHAR) = CAST(n.number AS VARCHAR)))
SELECT repo, number, title, state FROM existing UNION ALL SELECT repo, number, title, state FROM fresh"""


@query("incremental_append", INCR_SQL)
def q_incremental_append(spark, sf_dir):
    """Previous snapshot = first 60 % of the time range; the new collection run
    covers the last 60 % plus a re-fetched final 10 % (duplicates inside the new
    batch are kept, as in the reference)."""
    lo, hi = _window_bounds(spark, sf_dir)
    span = hi - lo
    iss = FX.issues(spark, sf_dir).select("repo", "number", "title", "state", "created_at")
    existing = iss.where(F.col("created_at") < F.lit(lo + span * 0.6))
    new = iss.where(F.col("created_at") >= F.lit(lo + span * 0.4)).unionByName(
        iss.where(F.col("created_at") >= F.lit(lo + span * 0.9)))
    return incremental_append(existing, new).select("repo", "number", "title", "state")


# ------------------------------------------------------- monitored set
def _change_log(spark, sf_dir):
    """Monitored-set requests derived from deliveries: an opened issue registers
    its repository, a push event for it removes it (latest request wins)."""
    wh = FX.webhook_events(spark, sf_dir)
    return wh.where(((F.col("event") == "issues") & (F.col("action") == "opened")) | (F.col("event") == "push")) \
        .select("repo", F.when(F.col("event") == "push", F.lit("remove")).otherwise(F.lit("add")).alias("op"),
                "ts", F.col("delivery_id").alias("request_id"))


_CONFIG_VALUES = ", ".join(f"('{r}')" for r in C.MONITORED_REPOS)
MONITORED_SQL = with_views("webhook_events") + f""",
cfg AS (SELECT * FROM (VALUES {_CONFIG_VALUES}) v(repo)),
ch AS (SELECT repo, CASE WHEN event = 'push' THEN 'remove' ELSE 'add' END AS op, ts, delivery_id
       FROM webhook_events WHERE (event = 'issues' AND action = 'opened') OR event = 'push'),
last AS (SELECT repo, op FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, delivery_id DESC) rn
                              FROM ch WHERE repo <> '') WHERE rn = 1),
monitored AS (SELECT repo FROM cfg WHERE repo NOT IN (SELECT repo FROM last)
              UNION ALL SELECT repo FROM last WHERE op = 'add')"""


@query("monitored_repos", MONITORED_SQL + "\nSELECT repo FROM monitored")
def q_monitored_repos(spark, sf_dir):
    return monitored_repos(_change_log(spark, sf_dir)).orderBy("repo")


@query("monitored_semi", MONITORED_SQL.replace("WITH ", "WITH " + with_views("issues")[5:] + ",", 1)
       + "\nSELECT number, repo FROM issues WHERE repo IN (SELECT repo FROM monitored)")
def q_monitored_semi(spark, sf_dir):
    mon = monitored_repos(_change_log(spark, sf_dir))
    return monitored_semi(FX.issues(spark, sf_dir).select("number", "repo"), mon)


REMAINING_SQL = MONITORED_SQL.replace("WITH ", "WITH " + with_views("issues")[5:] + ",", 1) + """
SELECT repo FROM monitored WHERE repo NOT IN (SELECT DISTINCT repo FROM issues)"""


@query("remaining_repos", REMAINING_SQL)
def q_remaining_repos(spark, sf_dir):
    """Monitored repositories whose pages have not landed yet."""
    mon = monitored_repos(_change_log(spark, sf_dir))
    completed = FX.issues(spark, sf_dir).select("repo").distinct()
    return remaining_repos(mon, completed)


# ----------------------------------------------------------- snapshots
_UNCAPPED = _collect_sql(C.INCLUDE_CLOSED, C.MIN_COMMENTS, 1 << 62)


@query("snapshot_write", _UNCAPPED)
def q_snapshot_write(spark, sf_dir):
    """An older snapshot stays as a version, a writer that died leaves parts nobody names, the new snapshot (the older one and
    what was collected since) is committed beside them; readers take the newest version.  The cap bounds one collection run,
    not the table."""
    rows = collect_issues(landed_pages(spark, sf_dir), max_per_repo=None)
    root = scratch_path(spark, "snapshots")
    write_snapshot(rows.where(F.col("number") % 2 == 0), root)
    existing = latest_snapshot(spark, root)
    CommitLog(spark, root).stage(existing)  # written, never committed
    write_snapshot(incremental_append(existing, rows), root)
    return latest_snapshot(spark, root)


class _Crash(RuntimeError):
    pass


@query("collect_resume", _UNCAPPED)
def q_collect_resume(spark, sf_dir):
    """A collection run that dies twice between writing a wave and committing it, and is then started once more."""
    pages = landed_pages(spark, sf_dir)
    log = CommitLog(spark, scratch_path(spark, "collected"))
    configured = pages.select("repo").distinct()

    def fetch(repos):
        return collect_issues(monitored_semi(pages, repos), max_per_repo=None)

    class Dying(CommitLog):
        left = 0

        def commit(self, *args, **kwargs):
            if not self.left:
                raise _Crash
            self.left -= 1
            return super().commit(*args, **kwargs)

    for good in (1, 1):
        dying = Dying(spark, log.root)
        dying.left = good
        with contextlib.suppress(_Crash):
            collect_run(dying, "run-1", configured, fetch, waves=4)
    return collect_run(log, "run-1", configured, fetch, waves=4)
