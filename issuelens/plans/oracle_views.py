"""DuckDB SQL for the fixture views, mirroring ``issuelens.sources.fixtures``.

Oracle queries may only use the pre-registered base tables, so every oracle
string starts with the CTEs it needs from here.
"""

from __future__ import annotations

from issuelens import config as C
from issuelens.functions.crypto import hmac_sql_duckdb
from issuelens.functions.text import PY_NON_WS, PY_WS_STRING

FENCE = "```"


_WS_CHARS_SQL = " || ".join(f"chr({ord(ch)})" for ch in PY_WS_STRING)


def py_strip(x: str) -> str:
    return f"trim({x}, {_WS_CHARS_SQL})"


def py_words(x: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({x}, '{PY_NON_WS}+')), 0) AS BIGINT)"


def any_label_in(labels_sql: str, names: list[str]) -> str:
    inset = ", ".join(f"'{n}'" for n in names)
    return f"(len(list_filter({labels_sql}, lambda x: lower(x) IN ({inset}))) > 0)"


ISSUES = f"""
issues AS (
  SELECT doc_id AS number,
         'org/' || source AS repo,
         'u' || CAST(doc_id % 37 AS VARCHAR) AS author,
         (CASE WHEN doc_id % 19 = 0 THEN 'Perf: ' ELSE '' END) || substr(split_part(text, chr(10), 1), 1, 120) AS title,
         concat_ws(chr(10), text,
                   CASE WHEN doc_id % 4 = 0 THEN '{FENCE}py' || chr(10) || 'x = 1' || chr(10) || '{FENCE}' END,
                   CASE WHEN doc_id % 6 = 0 THEN '![shot](img.png)' END,
                   CASE WHEN doc_id % 5 = 0 THEN 'See https://example.com/1' END) AS body,
         list_filter([CASE WHEN doc_id % 5 = 0 THEN 'bug' END,
                      CASE WHEN doc_id % 7 = 0 THEN 'performance' END,
                      CASE WHEN doc_id % 11 = 0 THEN 'security' END,
                      CASE WHEN doc_id % 13 = 0 THEN 'docs' END,
                      CASE WHEN doc_id % 3 = 0 THEN 'enhancement' END,
                      lang], lambda x: x IS NOT NULL) AS labels,
         CAST(CASE WHEN doc_id % 31 = 0 THEN NULL ELSE doc_id % 9 END AS BIGINT) AS comments,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS BIGINT)) AS created_at,
         CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'closed' END AS state,
         (doc_id % 17 = 0) AS is_pr
  FROM documents
)"""

FEEDBACK = """
feedback AS (
  SELECT TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CAST(l.doc_id - 1440 * g.gen AS BIGINT)) AS "timestamp",
         i.repo,
         l.doc_id AS issue_number,
         i.title,
         array_to_string(i.labels, ',') AS labels,
         i.comments,
         (['simple', 'moderate', 'complex'])[CAST(l.doc_id % 3 + 1 AS INTEGER)] AS predicted_complexity,
         CASE WHEN l.doc_id % 10 = 0 THEN NULL
              WHEN l.quality = 1 AND l.toxic = 0 THEN 'simple'
              WHEN l.toxic = 1 THEN 'complex'
              ELSE 'moderate' END AS human_label
  FROM labels l
  CROSS JOIN LATERAL (SELECT unnest(CASE WHEN l.doc_id % 4 = 0 THEN [0, 1] ELSE [0] END) AS gen) g
  JOIN issues i ON i.number = l.doc_id
)"""

THREADS = """
threads AS (
  SELECT conv_id AS number, arg_min(text, turn) AS title, CAST(count(*) - 1 AS BIGINT) AS comments
  FROM conversations GROUP BY conv_id
)"""


def _webhook_sql(secret: str) -> str:
    sig = hmac_sql_duckdb("raw", secret)
    return f"""
wh_base AS (
  SELECT event_id AS delivery_id, ts, event_type, user_id AS number,
         'org/src' || CAST(user_id % 20 AS VARCHAR) AS repo,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS comments,
         trim(repeat('word ', CAST(floor(value * 10) AS INTEGER))) AS body
  FROM events
),
wh_typed AS (
  SELECT *,
         CASE WHEN event_type IN ('error', 'view', 'signup') THEN 'issues'
              WHEN event_type = 'click' THEN 'issue_comment'
              WHEN event_type = 'purchase' THEN 'push' END AS event,
         CASE WHEN event_type = 'error' THEN 'opened'
              WHEN event_type = 'view' THEN (CASE WHEN comments % 2 = 1 THEN 'reopened' ELSE 'edited' END)
              WHEN event_type = 'signup' THEN 'closed'
              WHEN event_type = 'click' THEN 'created' END AS action
  FROM wh_base
),
wh_raw AS (
  SELECT delivery_id, ts, event, action, number, repo, comments,
         '{{"action":' || coalesce('"' || action || '"', 'null')
         || ',"issue":{{"number":' || CAST(number AS VARCHAR)
         || ',"title":"Issue ' || CAST(number AS VARCHAR)
         || '","body":"' || body
         || '","comments":' || CAST(comments AS VARCHAR)
         || ',"labels":[' || (CASE WHEN number % 5 = 0 THEN '{{"name":"complexity:simple"}},' ELSE '' END) || '{{"name":"bug"}}'
         || (CASE WHEN number % 3 = 0 THEN ',{{"name":"complexity:moderate"}}' ELSE '' END)
         || (CASE WHEN number % 7 = 0 THEN ',{{"name":"docs"}},{{"name":"complexity:simple"}}' ELSE '' END)
         || ']}},"repository":{{"full_name":"' || repo || '"}}'
         || (CASE WHEN event_type = 'click' THEN ',"comment":{{"id":' || CAST(delivery_id AS VARCHAR) || '}}' ELSE '' END)
         || '}}' AS raw
  FROM wh_typed
),
webhook_events AS (
  SELECT *,
         CASE WHEN delivery_id % 97 = 0 THEN NULL
              WHEN delivery_id % 10 = 0 THEN '{C.BAD_SIGNATURE}'
              ELSE 'sha256=' || {sig} END AS signature
  FROM wh_raw
)"""


WEBHOOK_EVENTS = _webhook_sql(C.WEBHOOK_SECRET)


def heuristic_select(title: str = "title", body: str = "body", labels: str = "labels") -> str:
    """SQL expression list computing the integer heuristic points as ``_pts``."""
    ts = py_strip(f"coalesce({title}, '')")
    bs = py_strip(f"coalesce({body}, '')")
    lab = f"coalesce({labels}, CAST([] AS VARCHAR[]))"
    chars = (f"(CASE WHEN length({ts}) = 0 THEN length({bs}) WHEN length({bs}) = 0 THEN length({ts}) "
             f"ELSE length({ts}) + 2 + length({bs}) END)")
    words = f"({py_words(ts)} + {py_words(bs)})"
    perf = f"({any_label_in(lab, C.PERF_LABELS)} OR contains(lower({ts}), '{C.PERF_TITLE_TOKEN}'))"
    raw = (f"{C.CHAR_WEIGHT} * least({chars}, {C.CHAR_CAP}) + {C.WORD_WEIGHT} * least({words}, {C.WORD_CAP})"
           f" + (CASE WHEN {any_label_in(lab, C.SECURITY_LABELS)} THEN {C.SECURITY_POINTS} ELSE 0 END)"
           f" + (CASE WHEN {perf} THEN {C.PERF_POINTS} ELSE 0 END)"
           f" + (CASE WHEN {any_label_in(lab, C.BUG_LABELS)} THEN {C.BUG_POINTS} ELSE 0 END)"
           f" - (CASE WHEN {any_label_in(lab, C.DOCS_LABELS)} THEN {C.DOCS_POINTS} ELSE 0 END)")
    return f"CAST(least(greatest({raw}, 0), {C.SCORE_SCALE}) AS BIGINT)"


def scored_cte(name: str, source: str, title="title", body="body", labels="labels") -> str:
    """CTE adding p_simple/p_moderate/p_complex/complexity/confidence to ``source``."""
    return f"""
{name}_pts AS (SELECT *, {heuristic_select(title, body, labels)} AS _pts FROM {source}),
{name}_p AS (
  SELECT *, CAST(greatest(10000 - _pts, 0) / 10000.0 AS DOUBLE) AS p_simple,
            CAST((10000 - greatest(10000 - _pts, 0) - greatest(_pts - 10000, 0)) / 10000.0 AS DOUBLE) AS p_moderate,
            CAST(greatest(_pts - 10000, 0) / 10000.0 AS DOUBLE) AS p_complex
  FROM {name}_pts),
{name} AS (
  SELECT * EXCLUDE (_pts),
         CASE WHEN p_simple >= p_moderate AND p_simple >= p_complex THEN 'simple'
              WHEN p_moderate >= p_complex THEN 'moderate' ELSE 'complex' END AS complexity,
         CASE WHEN p_simple >= p_moderate AND p_simple >= p_complex THEN p_simple
              WHEN p_moderate >= p_complex THEN p_moderate ELSE p_complex END AS confidence
  FROM {name}_p)"""


PREDICTIONS = scored_cte("issues_scored", "issues") + """,
predictions AS (
  SELECT created_at AS "timestamp", repo, number AS issue_number, title, labels, comments,
         complexity, confidence, p_simple, p_moderate, p_complex
  FROM issues_scored)"""


def with_views(*names: str) -> str:
    """WITH clause holding the requested views (dependencies included, in order)."""
    order = ["issues", "feedback", "threads", "webhook_events", "predictions"]
    deps = {"feedback": ["issues"], "predictions": ["issues"]}
    wanted: list[str] = []
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in wanted:
                wanted.append(d)
    parts = {"issues": ISSUES, "feedback": FEEDBACK, "threads": THREADS, "webhook_events": WEBHOOK_EVENTS,
             "predictions": PREDICTIONS}
    return "WITH " + ",".join(parts[n] for n in order if n in wanted)
