"""Registered routing / text-output queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import events as E
from issuelens.operators import routing as RT
from issuelens.operators.scoring import batch_score
from issuelens.plans.events_q import TRIAGED
from issuelens.operators.commit_log import CommitLog
from issuelens.plans.oracle_views import py_strip, scored_cte, with_views
from issuelens.plans.registry import query
from issuelens.plans.scoring_q import BATCH_SQL
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX
from issuelens.sources import readers as R


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _map_sql(pairs, key: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in pairs) + f" ELSE {q(default)} END"


def _pct_sql(x: str) -> str:
    return f"(CAST(CAST(round_even(({x}) * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


_TEAM = _map_sql(C.TEAM_ASSIGNMENTS, "complexity", C.DEFAULT_TEAM)


@query("team_routing", BATCH_SQL.replace("\nSELECT number AS issue_number", "\n, b AS (SELECT number AS issue_number", 1)
       + f")\nSELECT issue_number, repo, complexity, {_TEAM} AS team FROM b")
def q_team_routing(spark, sf_dir):
    iss = FX.issues(spark, sf_dir).withColumn(
        "title", F.when(F.col("number") % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("title")))
    scored = batch_score(iss)
    return RT.route_to_team(scored).select("issue_number", "repo", "complexity", "team")


_NUMBER = "coalesce(CAST(issue_number AS VARCHAR), '0')"
_URL = f"'{C.ISSUE_URL_HOST}/' || coalesce(repo, 'unknown') || '/issues/' || {_NUMBER}"
NOTIFY_SQL = with_views("predictions") + f""",
t AS (SELECT *, {_TEAM} AS team FROM predictions)
SELECT issue_number, repo, team,
       {_map_sql(C.COMPLEXITY_EMOJI, "complexity", C.DEFAULT_EMOJI)} AS emoji,
       {_map_sql(C.COMPLEXITY_COLORS, "complexity", C.DEFAULT_COLOR)} AS color,
       {_URL} AS issue_url,
       '*<' || {_URL} || '|#' || {_NUMBER} || ': ' || substr(coalesce(title, 'Untitled'), 1, {C.NOTIFY_TITLE_CHARS}) || '>*'
         AS headline,
       {_pct_sql("coalesce(confidence, 0.0)")} AS confidence_pct,
       CASE WHEN complexity = 'complex' THEN {q(C.COMPLEX_MENTION)} END AS mention,
       '[Notification] Issue #' || coalesce(CAST(issue_number AS VARCHAR), 'None') || ' in ' || coalesce(repo, 'None')
         || ' - Complexity: ' || complexity || ' (' || {_pct_sql("coalesce(confidence, 0.0)")} || ') - Assign to: ' || team
         AS log_line
FROM t"""


@query("notification_payload", NOTIFY_SQL)
def q_notification_payload(spark, sf_dir):
    pred = FX.predictions(spark, sf_dir)
    f = RT.notification_fields(RT.route_to_team(pred))
    return f.select("issue_number", "repo", "team", "emoji", "color", "issue_url", "headline", "confidence_pct",
                    "mention", "log_line")


_MD = "{{'type': 'mrkdwn', 'text': {}}}".format
OUTBOX_SQL = NOTIFY_SQL.replace(f"{_TEAM} AS team FROM predictions)", f"{_TEAM} AS team FROM predictions),\nm AS (", 1).replace(
    "SELECT issue_number, repo, team,", "SELECT issue_number, repo, team, complexity, \"timestamp\",", 1) + f""")
SELECT issue_number, repo,
       '{{"text":' || coalesce(CAST(to_json(mention) AS VARCHAR), 'null') || ',"attachments":[{{"color":"' || color || '","blocks":['
       || concat_ws(',',
            to_json({{'type': 'header', 'text': {{'type': 'plain_text', 'text': emoji || {q(C.NOTIFY_HEADER)}, 'emoji': true}}}}),
            to_json({{'type': 'section', 'text': {_MD('headline')}}}),
            to_json({{'type': 'section', 'fields': [
              {_MD("'*Repository:*' || chr(10) || '`' || coalesce(repo, 'unknown') || '`'")},
              {_MD("'*Complexity:*' || chr(10) || emoji || ' ' || upper(complexity)")},
              {_MD("'*Confidence:*' || chr(10) || confidence_pct")},
              {_MD("'*Assign To:*' || chr(10) || team")}]}}),
            '{{"type":"divider"}}',
            to_json({{'type': 'actions', 'elements': [{{'type': 'button', 'text': {{'type': 'plain_text', 'text': {q(C.NOTIFY_BUTTON)}, 'emoji': true}},
                     'url': issue_url, 'style': 'primary'}}]}}),
            to_json({{'type': 'context', 'elements': [{_MD(f"{q(C.NOTIFY_TIME)} || strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S')")}]}}))
       || ']}}]}}' AS payload
FROM m"""


@query("notification_outbox", OUTBOX_SQL)
def q_notification_outbox(spark, sf_dir):
    """The whole message of every scored issue, stamped with the prediction's time."""
    f = RT.notification_fields(RT.route_to_team(FX.predictions(spark, sf_dir)))
    return f.select("issue_number", "repo", RT.notification_payload(f, F.col("timestamp")).alias("payload"))


def _fill_sql(template: str, **parts: str) -> str:
    out, rest = [], template
    while "{" in rest:
        pre, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [q(pre), parts[name]]
    out.append(q(rest))
    return "(" + " || ".join(out) + ")"


_DESIGN = "(len(list_filter(labels, lambda x: lower(x) IN ('feature', 'enhancement', 'design'))) > 0)"
_PCT = _pct_sql("coalesce(confidence, 0.0)")
_REMEDY = f"""CASE WHEN complexity = 'simple' THEN {_fill_sql(C.REMEDY_SIMPLE, pct=_PCT)}
     WHEN complexity = 'moderate' THEN {_fill_sql(C.REMEDY_MODERATE, pct=_PCT,
                                                  design=f"(CASE WHEN {_DESIGN} THEN {q(C.REMEDY_DESIGN)} ELSE '' END)")}
     WHEN complexity = 'complex' THEN {_fill_sql(C.REMEDY_COMPLEX, pct=_PCT,
                                                 escalation=f"(CASE WHEN coalesce(comments, 0) >= {C.ESCALATION_COMMENTS} THEN {q(C.REMEDY_ESCALATION)} ELSE '' END)")}
     ELSE {_fill_sql(C.REMEDY_OTHER, pct=_PCT)} END"""

REMEDY_SQL = TRIAGED.replace("WITH ", "WITH " + with_views("predictions")[5:] + ",", 1) + f""",
src AS (
  SELECT 'issue' AS source, issue_number AS id, labels, comments, complexity, confidence FROM predictions
  UNION ALL
  SELECT 'event', delivery_id, labels, p_comments, predicted, confidence FROM tr WHERE status = 'processed')
SELECT source, id, complexity, {_REMEDY} AS remedy FROM src"""


@query("suggest_remedy", REMEDY_SQL)
def q_suggest_remedy(spark, sf_dir):
    """Remedy text for scored issues and for scored webhook events (which carry comment counts)."""
    pred = FX.predictions(spark, sf_dir).select(
        F.lit("issue").alias("source"), F.col("issue_number").alias("id"), "labels", "comments", "complexity",
        "confidence")
    ev = E.triage(FX.webhook_events(spark, sf_dir)).where(F.col("status") == "processed").select(
        F.lit("event").alias("source"), F.col("delivery_id").alias("id"), "labels", "comments",
        F.col("predicted").alias("complexity"), "confidence")
    src = pred.unionByName(ev)
    return src.select("source", "id", "complexity", RT.suggest_remedy(src).alias("remedy"))


def _prompt_sql() -> str:
    pre, rest = C.ADVISOR_PROMPT.split("{title}")
    mid, rest = rest.split("{labels}")
    mid2, post = rest.split("{body}")
    return (f"{q(pre)} || coalesce(title, '') || {q(mid)} || array_to_string(coalesce(labels, CAST([] AS VARCHAR[])), ', ')"
            f" || {q(mid2)} || substr(coalesce(body, ''), 1, {C.PROMPT_BODY_CHARS}) || {q(post)}")


@query("advisor_prompt", with_views("issues") + f"\nSELECT number, {_prompt_sql()} AS prompt FROM issues")
def q_advisor_prompt(spark, sf_dir):
    iss = FX.issues(spark, sf_dir)
    return iss.select("number", RT.advisor_prompt(F.col("title"), F.col("body"), F.col("labels")).alias("prompt"))


OPEN_TRIAGE_SQL = with_views("issues") + ",\nopen_issues AS (SELECT * FROM issues WHERE state = 'open')," + \
    scored_cte("s", "open_issues")[1:] + """
SELECT number, repo, complexity, confidence, 'complexity:' || complexity AS new_label,
       array_to_string(CASE WHEN list_contains(labels, 'complexity:' || complexity) THEN labels
                            ELSE list_concat(labels, ['complexity:' || complexity]) END, ',') AS labels_after
FROM s"""


@query("open_issue_triage", OPEN_TRIAGE_SQL)
def q_open_issue_triage(spark, sf_dir):
    t = RT.open_issue_triage(FX.issues(spark, sf_dir))
    return t.withColumn("labels_after", F.array_join("labels_after", ","))


FEEDBACK_APPEND_SQL = TRIAGED + """
SELECT p_repo AS repo, p_number AS issue_number, title, array_to_string(labels, ',') AS labels,
       p_comments AS comments, predicted AS predicted_complexity, '' AS human_label
FROM tr WHERE status = 'processed'"""

FEEDBACK_CSV_SCHEMA = ("timestamp string, repo string, issue_number bigint, title string, labels string, "
                       "comments bigint, predicted_complexity string, human_label string")


@query("feedback_append", FEEDBACK_APPEND_SQL)
def q_feedback_append(spark, sf_dir):
    """Each processed event appends one feedback row (one, not two: a decided fix) in two batches, the first of which
    is delivered twice; read back."""
    t = E.triage(FX.webhook_events(spark, sf_dir)).where(F.col("status") == "processed").withColumnRenamed(
        "number", "issue_number")
    rec = RT.feedback_record(t, predicted="predicted")
    log = CommitLog(spark, scratch_path(spark, "feedback-log"), "csv", FEEDBACK_CSV_SCHEMA, R.CSV_OPTIONS)
    for part in (0, 1, 0):
        log.write(rec.where(F.col("issue_number") % 2 == part), batch=f"delivery-{part}")
    back = log.read()
    return back.drop("timestamp").withColumn("human_label", F.coalesce(F.col("human_label"), F.lit("")))


@query("feedback_stats", with_views("feedback") + f"""
SELECT count(*) AS feedback_records,
       CAST(count_if(length({py_strip("coalesce(human_label, '')")}) > 0) AS BIGINT) AS labelled_records,
       CASE WHEN count(*) > 0 THEN CAST(count_if(length({py_strip("coalesce(human_label, '')")}) > 0) AS BIGINT) / count(*) END
         AS labelled_share
FROM feedback""")
def q_feedback_stats(spark, sf_dir):
    return RT.feedback_stats(FX.feedback(spark, sf_dir))


@query("retrain_due", with_views("feedback") + f""",
a AS (SELECT repo, count(*) AS new_feedback FROM feedback
      WHERE length({py_strip("coalesce(human_label, '')")}) > 0 GROUP BY ROLLUP (repo))
SELECT repo, new_feedback, CAST({C.MIN_ISSUES_FOR_RETRAIN} AS BIGINT) AS threshold,
       new_feedback >= {C.MIN_ISSUES_FOR_RETRAIN} AS due
FROM a""")
def q_retrain_due(spark, sf_dir):
    return RT.retrain_due(FX.feedback(spark, sf_dir))


# ------------------------------------------------------------------ uploads
UPLOAD_SCHEMA = "title string, body string, repo string, author string, labels string, comments string"

UPLOAD_SQL = with_views("issues") + f""",
up AS (
  SELECT number, CASE WHEN number % 23 = 0 THEN '   ' ELSE title END AS title,
         CASE WHEN number % 7 = 0 THEN NULL ELSE body END AS body, repo, author,
         CASE WHEN number % 2 = 0 THEN ' ' || array_to_string(labels, ' , ') || ', ,' ELSE NULL END AS labels,
         CASE WHEN number % 5 = 0 THEN 'n/a' ELSE CAST(comments AS VARCHAR) END AS comments
  FROM issues)
SELECT repo, author, title, coalesce(body, '') AS body,
       array_to_string(list_filter(list_transform(string_split(coalesce(labels, ''), ','), lambda x: {py_strip("x")}),
                                   lambda x: x <> ''), ',') AS labels,
       coalesce(TRY_CAST(comments AS BIGINT), 0) AS comments
FROM up WHERE length({py_strip("coalesce(title, '')")}) > 0"""


@query("upload_normalize", UPLOAD_SQL)
def q_upload_normalize(spark, sf_dir):
    """An uploaded CSV (blank titles, missing bodies, untidy label text, bad counts) -> scoring requests."""
    accepted, _rejected = _accepted_upload(spark, sf_dir)
    return accepted.select("repo", "author", "title", "body", F.array_join("labels", ",").alias("labels"), "comments")


PREVIEW_ORDER = ["title", "coalesce(repo, '')", "coalesce(author, '')", "comments", "md5(body)"]


@query("upload_preview", f"""
SELECT * FROM ({UPLOAD_SQL}) AS uploaded
ORDER BY {", ".join(PREVIEW_ORDER)} LIMIT {C.PREVIEW_ROWS}""")
def q_upload_preview(spark, sf_dir):
    """The first rows of an upload in a fixed order (a top-k: no full sort)."""
    return q_upload_normalize(spark, sf_dir).orderBy(*[F.expr(c) for c in PREVIEW_ORDER]).limit(C.PREVIEW_ROWS)


def _accepted_upload(spark, sf_dir):
    iss = FX.issues(spark, sf_dir)
    up = iss.select(
        F.when(F.col("number") % 23 == 0, F.lit("   ")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("number") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("body")).alias("body"),
        "repo", "author",
        F.when(F.col("number") % 2 == 0, F.concat(F.lit(" "), F.array_join("labels", " , "), F.lit(", ,"))
               ).alias("labels"),
        F.when(F.col("number") % 5 == 0, F.lit("n/a")).otherwise(F.col("comments").cast("string")).alias("comments"),
    )
    path = scratch_path(spark, "upload")
    up.write.options(**R.CSV_OPTIONS).csv(path)
    raw = spark.read.schema(UPLOAD_SCHEMA).options(**R.CSV_OPTIONS).csv(path)
    raw = raw.withColumn("comments", F.col("comments").try_cast("bigint"))
    return R.upload_normalize(raw)
