"""Webhook events: verify, parse, route, project, score, relabel.

All stateless steps are column expressions shared by the batch twin and the
streaming query; the only shuffle is the per-issue label state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens import config as C
from issuelens.functions.crypto import hmac_sha256_hex
from issuelens.functions.score import with_heuristic
from issuelens.operators.skew import prefix_aggregate
from issuelens.session import observe_rows

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("issue", T.StructType([
        T.StructField("number", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("labels", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("comments", T.LongType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
        T.StructField("closed_at", T.StringType()),
        T.StructField("user", T.StructType([T.StructField("login", T.StringType())])),
    ])),
    T.StructField("repository", T.StructType([T.StructField("full_name", T.StringType())])),
    T.StructField("comment", T.StructType([T.StructField("id", T.LongType())])),
])


ENVELOPE = ["delivery_id", "ts", "event", "signature", "raw"]


def envelope(df: DataFrame) -> DataFrame:
    """Only what a delivery carries: id, receive time, event header, signature header, raw body."""
    return df.select(*ENVELOPE)


def verify(df: DataFrame, secret: str | None, body: str = "raw", signature: str = "signature") -> DataFrame:
    """Add ``verified`` and ``reject_reason``.

    No secret -> everything accepted.  With a secret: missing header ->
    "Missing signature"; the hex after the first '=' must equal the HMAC of
    the raw body, else "Invalid signature".
    """
    if not secret:
        return df.withColumn("verified", F.lit(True)).withColumn("reject_reason", F.lit(None).cast("string"))
    sig = F.col(signature)
    given = F.try_element_at(F.split(sig, "="), F.lit(2))  # text between the first and second '='
    expected = hmac_sha256_hex(F.col(body), secret)
    ok = sig.isNotNull() & (F.size(F.split(sig, "=")) >= 2) & (given == expected)
    reason = F.when(sig.isNull() | (F.length(sig) == 0), F.lit(C.MISSING_SIGNATURE)).when(~ok, F.lit(C.INVALID_SIGNATURE))
    return df.withColumn("reject_reason", reason).withColumn("verified", F.col("reject_reason").isNull())


def parse(df: DataFrame, body: str = "raw") -> DataFrame:
    return df.withColumn("payload", F.from_json(F.col(body), PAYLOAD_SCHEMA))


def route(df: DataFrame, event: str = "event") -> DataFrame:
    """status processed / ignored / rejected with the reference's reasons."""
    ev, act = F.col(event), F.col("payload.action")
    comments = F.coalesce(F.col("payload.issue.comments"), F.lit(0))
    is_issue, is_comment = ev == C.ISSUE_EVENT, ev == C.COMMENT_EVENT
    issue_ok = act.isin(*C.ISSUE_ACTIONS)
    comment_ok = (act == C.COMMENT_ACTION) & (comments > 0)
    status = (
        F.when(~F.col("verified"), F.lit("rejected"))
        .when(is_issue & issue_ok, F.lit("processed"))
        .when(is_comment & comment_ok, F.lit("processed"))
        .otherwise(F.lit("ignored"))
    )
    reason = (
        F.when(~F.col("verified"), F.col("reject_reason"))
        .when(is_issue & ~F.coalesce(issue_ok, F.lit(False)), F.lit(C.IGNORED_ISSUE_REASON))
        .when(is_comment & ~F.coalesce(comment_ok, F.lit(False)), F.lit(C.IGNORED_COMMENT_REASON))
    )
    kind = F.when(is_issue, F.lit("issue")).when(is_comment, F.lit("comment")).otherwise(F.lit("other"))
    return df.withColumn("route", kind).withColumn("status", status).withColumn("reason", reason)


def project(df: DataFrame) -> DataFrame:
    """Payload -> issue row: number, repo, title, body, labels, comments, timestamps, author."""
    iss = F.col("payload.issue")
    return df.select(
        "*",
        F.col("payload.action").alias("action"),
        iss["number"].alias("number"),
        F.col("payload.repository.full_name").alias("repo"),
        F.coalesce(iss["title"], F.lit("")).alias("title"),
        F.coalesce(iss["body"], F.lit("")).alias("body"),
        F.transform(F.coalesce(iss["labels"], F.array().cast(PAYLOAD_SCHEMA["issue"].dataType["labels"].dataType)),
                    lambda x: F.coalesce(x["name"], F.lit(""))).alias("labels"),
        F.coalesce(iss["comments"], F.lit(0)).alias("comments"),
        iss["created_at"].alias("created_at"),
        iss["updated_at"].alias("updated_at"),
        iss["closed_at"].alias("closed_at"),
        iss["user"]["login"].alias("author"),
        F.col("payload.comment.id").alias("comment_id"),
    )


def complexity_label(cls: Column) -> Column:
    return F.concat(F.lit(C.COMPLEXITY_LABEL_PREFIX), cls)


def relabel(labels: Column, new_label: Column, replace: Column) -> Column:
    """Outbound label list: comment events replace every ``complexity:*`` label,
    issue events add the new one (no duplicate); other labels keep their order
    and multiplicity."""
    kept = F.filter(labels, lambda x: ~x.startswith(C.COMPLEXITY_LABEL_PREFIX))
    replaced = F.concat(kept, F.array(new_label))
    added = F.when(F.array_contains(labels, new_label), labels).otherwise(F.concat(labels, F.array(new_label)))
    return F.when(replace, replaced).otherwise(added)


def triage(envelopes: DataFrame, secret: str | None = C.WEBHOOK_SECRET) -> DataFrame:
    """Verify -> parse -> route -> project -> score, one narrow stage per row."""
    t = project(route(parse(verify(envelope(envelopes), secret))))
    processed = F.col("status") == "processed"
    # Rejected and ignored events carry no prediction: their texts are not scanned for patterns.
    t = t.select("*", *[F.when(processed, F.col(c)).alias(f"_score_{c}") for c in ("title", "body", "labels")])
    scored = with_heuristic(t, "_score_title", "_score_body", "_score_labels").drop(
        "_score_title", "_score_body", "_score_labels")
    scored = observe_rows(scored, "triage")  # filters on status/prediction read computed columns
    out = scored.select(
        "*",
        F.when(processed, F.col("complexity")).alias("predicted"),
        F.when(processed, relabel(F.col("labels"), complexity_label(F.col("complexity")), F.col("route") == "comment")
               ).alias("labels_after"),
    )
    return out


def result_columns(t: DataFrame) -> DataFrame:
    """The per-event result record (status, action, issue, prediction, reason)."""
    processed = F.col("status") == "processed"
    return t.select(
        "delivery_id",
        F.col("event").alias("event_type"),
        "action",
        "status",
        "reason",
        F.when(processed, F.col("number")).alias("issue_number"),
        F.when(processed, F.col("repo")).alias("repo"),
        F.col("predicted").alias("complexity"),
        F.when(processed, F.col("confidence")).alias("confidence"),
        F.when(processed, F.col("p_simple")).alias("p_simple"),
        F.when(processed, F.col("p_moderate")).alias("p_moderate"),
        F.when(processed, F.col("p_complex")).alias("p_complex"),
        F.when(processed & (F.col("route") == "comment"), F.col("comment_id")).alias("comment_id"),
    )


def label_history(t: DataFrame) -> DataFrame:
    """``complexity:*`` label set of each issue after every processed event.

    Issue events add their class; a comment event replaces the set.  So a
    class is present after event e iff it occurred at or after the latest
    comment event up to e.  Computed as running maxima of event positions
    per issue (range-sliced prefix maxima: a hot issue is spread over tasks).
    """
    return label_states(label_events(t))


def label_events(t: DataFrame) -> DataFrame:
    """The processed events as narrow rows: issue, time, class, and whether a comment caused them."""
    return t.where(F.col("status") == "processed").select(
        "delivery_id", "repo", "number", "ts", F.col("predicted").alias("complexity"),
        (F.col("route") == "comment").alias("is_comment"),
    )


MARKS = ["comment", *C.CLASSES]


def _marks() -> list[tuple[str, Column]]:
    """What decides the labels: the places (time, delivery) of comments and of each class."""
    pos = F.struct(F.col("ts"), F.col("delivery_id"))
    return [("comment", F.when(F.col("is_comment"), pos)), *[(c, F.when(F.col("complexity") == c, pos)) for c in C.CLASSES]]


def label_marks(p: DataFrame) -> DataFrame:
    """Per issue of ``label_events`` rows: the last place of all events and of each mark (the state after them)."""
    return p.groupBy("repo", "number").agg(
        F.max(F.struct("ts", "delivery_id")).alias("last"), F.min(F.struct("ts", "delivery_id")).alias("first"),
        *[F.max(mark).alias(f"last_{name}") for name, mark in _marks()])


def label_states(p: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Label set after each event of ``label_events`` rows (see ``label_history``).

    ``carry``: marks (repo, number, last_<mark>) of earlier events, one row per issue; the rows go on from there.
    """
    aggs = [(f"_last_{name}", "max", mark) for name, mark in _marks()]
    h = prefix_aggregate(p, ["repo", "number"], [F.col("ts"), F.col("delivery_id")], aggs, stage_input=True)
    if carry is not None:
        old = carry.select(F.col("repo").alias("_repo"), F.col("number").alias("_number"), *[f"last_{m}" for m in MARKS])
        h = h.join(old, F.col("repo").eqNullSafe(F.col("_repo")) & F.col("number").eqNullSafe(F.col("_number")), "left")
        h = h.withColumns({f"_last_{m}": F.greatest(f"_last_{m}", f"last_{m}") for m in MARKS})
    present = [
        F.when(F.col(f"_last_{c}").isNotNull()
               & (F.col("_last_comment").isNull() | (F.col(f"_last_{c}") >= F.col("_last_comment"))),
               F.lit(C.COMPLEXITY_LABEL_PREFIX + c))
        for c in sorted(C.CLASSES)
    ]
    return h.select("delivery_id", "repo", "number", "complexity", "is_comment",
                    F.concat_ws(",", *present).alias("complexity_labels"))
