"""Registered webhook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.crypto import hmac_sql_duckdb
from issuelens.operators import events as E
from issuelens.plans.oracle_views import scored_cte, with_views
from issuelens.plans.registry import query
from issuelens.sources import fixtures as FX

_HMAC = hmac_sql_duckdb("raw", C.WEBHOOK_SECRET)
_ISSUE_ACTIONS = ", ".join(f"'{a}'" for a in C.ISSUE_ACTIONS)

# verify -> parse -> route -> project (DuckDB twin of the operator chain)
ROUTED = with_views("webhook_events") + f""",
v AS (
  SELECT *,
         CASE WHEN signature IS NULL OR length(signature) = 0 THEN '{C.MISSING_SIGNATURE}'
              WHEN len(string_split(signature, '=')) < 2 OR split_part(signature, '=', 2) <> {_HMAC}
                THEN '{C.INVALID_SIGNATURE}' END AS reject_reason
  FROM webhook_events),
pj AS (
  SELECT delivery_id, ts, event, reject_reason,
         json_extract_string(raw, '$.action') AS p_action,
         CAST(json_extract(raw, '$.issue.number') AS BIGINT) AS p_number,
         json_extract_string(raw, '$.repository.full_name') AS p_repo,
         coalesce(json_extract_string(raw, '$.issue.title'), '') AS title,
         coalesce(json_extract_string(raw, '$.issue.body'), '') AS body,
         coalesce(json_extract_string(raw, '$.issue.labels[*].name'), CAST([] AS VARCHAR[])) AS labels,
         coalesce(CAST(json_extract(raw, '$.issue.comments') AS BIGINT), 0) AS p_comments,
         CAST(json_extract(raw, '$.comment.id') AS BIGINT) AS comment_id
  FROM v),
rt AS (
  SELECT *,
         CASE WHEN event = '{C.ISSUE_EVENT}' THEN 'issue' WHEN event = '{C.COMMENT_EVENT}' THEN 'comment' ELSE 'other' END
           AS route,
         CASE WHEN reject_reason IS NOT NULL THEN 'rejected'
              WHEN event = '{C.ISSUE_EVENT}' AND p_action IN ({_ISSUE_ACTIONS}) THEN 'processed'
              WHEN event = '{C.COMMENT_EVENT}' AND p_action = '{C.COMMENT_ACTION}' AND p_comments > 0 THEN 'processed'
              ELSE 'ignored' END AS status,
         CASE WHEN reject_reason IS NOT NULL THEN reject_reason
              WHEN event = '{C.ISSUE_EVENT}' AND NOT coalesce(p_action IN ({_ISSUE_ACTIONS}), FALSE)
                THEN '{C.IGNORED_ISSUE_REASON}'
              WHEN event = '{C.COMMENT_EVENT}' AND NOT coalesce(p_action = '{C.COMMENT_ACTION}' AND p_comments > 0, FALSE)
                THEN '{C.IGNORED_COMMENT_REASON}' END AS reason
  FROM pj)"""

TRIAGED = ROUTED + "," + scored_cte("sc", "rt")[1:] + """,
tr AS (
  SELECT *, CASE WHEN status = 'processed' THEN complexity END AS predicted FROM sc)"""


def _triaged(spark, sf_dir):
    return E.triage(FX.webhook_events(spark, sf_dir))


@query("webhook_verify", ROUTED + """
SELECT delivery_id, reject_reason IS NULL AS verified, reject_reason FROM v""")
def q_webhook_verify(spark, sf_dir):
    v = E.verify(E.envelope(FX.webhook_events(spark, sf_dir)), C.WEBHOOK_SECRET)
    return v.select("delivery_id", "verified", "reject_reason")


@query("webhook_route", ROUTED + """
SELECT delivery_id, event, p_action AS action, route, status, reason FROM rt""")
def q_webhook_route(spark, sf_dir):
    r = E.route(E.parse(E.verify(E.envelope(FX.webhook_events(spark, sf_dir)), C.WEBHOOK_SECRET)))
    return r.select("delivery_id", "event", F.col("payload.action").alias("action"), "route", "status", "reason")


@query("webhook_project", ROUTED + """
SELECT delivery_id, p_number AS number, p_repo AS repo, title, body, array_to_string(labels, ',') AS labels,
       p_comments AS comments, comment_id
FROM rt WHERE status = 'processed'""")
def q_webhook_project(spark, sf_dir):
    t = E.project(E.route(E.parse(E.verify(E.envelope(FX.webhook_events(spark, sf_dir)), C.WEBHOOK_SECRET))))
    return t.where(F.col("status") == "processed").select(
        "delivery_id", "number", "repo", "title", "body", F.array_join("labels", ",").alias("labels"),
        "comments", "comment_id")


@query("webhook_triage", TRIAGED + """
SELECT delivery_id, event AS event_type, p_action AS action, status, reason,
       CASE WHEN status = 'processed' THEN p_number END AS issue_number,
       CASE WHEN status = 'processed' THEN p_repo END AS repo,
       predicted AS complexity,
       CASE WHEN status = 'processed' THEN confidence END AS confidence,
       CASE WHEN status = 'processed' THEN p_simple END AS p_simple,
       CASE WHEN status = 'processed' THEN p_moderate END AS p_moderate,
       CASE WHEN status = 'processed' THEN p_complex END AS p_complex,
       CASE WHEN status = 'processed' AND route = 'comment' THEN comment_id END AS comment_id
FROM tr""")
def q_webhook_triage(spark, sf_dir):
    return E.result_columns(_triaged(spark, sf_dir))


@query("relabel", TRIAGED + f"""
SELECT delivery_id, p_number AS number, p_repo AS repo, route,
       array_to_string(CASE WHEN route = 'comment'
            THEN list_concat(list_filter(labels, lambda x: NOT starts_with(x, '{C.COMPLEXITY_LABEL_PREFIX}')),
                             ['{C.COMPLEXITY_LABEL_PREFIX}' || predicted])
            WHEN list_contains(labels, '{C.COMPLEXITY_LABEL_PREFIX}' || predicted) THEN labels
            ELSE list_concat(labels, ['{C.COMPLEXITY_LABEL_PREFIX}' || predicted]) END, ',') AS labels_after
FROM tr WHERE status = 'processed'""")
def q_relabel(spark, sf_dir):
    t = _triaged(spark, sf_dir).where(F.col("status") == "processed")
    return t.select("delivery_id", "number", "repo", "route", F.array_join("labels_after", ",").alias("labels_after"))


_PRESENT = ",\n".join(
    f"""CASE WHEN last_{c} IS NOT NULL AND (last_comment IS NULL OR last_{c} >= last_comment)
              THEN '{C.COMPLEXITY_LABEL_PREFIX}{c}' END""" for c in sorted(C.CLASSES))

RELABEL_HISTORY_SQL = TRIAGED + f""",
p AS (
  SELECT delivery_id, p_repo AS repo, p_number AS number, ts, predicted AS complexity, route = 'comment' AS is_comment,
         row_number() OVER (PARTITION BY p_repo, p_number ORDER BY ts, delivery_id) AS pos
  FROM tr WHERE status = 'processed'),
h AS (
  SELECT *,
         max(CASE WHEN is_comment THEN pos END) OVER w AS last_comment,
         {", ".join(f"max(CASE WHEN complexity = '{c}' THEN pos END) OVER w AS last_{c}" for c in C.CLASSES)}
  FROM p
  WINDOW w AS (PARTITION BY repo, number ORDER BY ts, delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT delivery_id, repo, number, complexity, is_comment,
       concat_ws(',', {_PRESENT}) AS complexity_labels
FROM h"""


@query("relabel_history", RELABEL_HISTORY_SQL)
def q_relabel_history(spark, sf_dir):
    return E.label_history(_triaged(spark, sf_dir))
