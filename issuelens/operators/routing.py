"""Routing and text outputs: team lookup, notification outbox, remedy text,
advisor prompt, feedback log, upload normalisation, retrain trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions import text as TX
from issuelens.operators.events import complexity_label, relabel


def teams(spark: SparkSession) -> DataFrame:
    """The fixed 3-row complexity -> team dimension."""
    return spark.createDataFrame(C.TEAM_ASSIGNMENTS, "complexity string, team string")


def route_to_team(df: DataFrame, cls: str = "complexity") -> DataFrame:
    """Left join on the broadcast team dimension (3 rows: a proven size bound)."""
    dim = F.broadcast(teams(df.sparkSession).withColumnRenamed("complexity", "_cls"))
    out = df.join(dim, F.col(cls) == F.col("_cls"), "left").drop("_cls")
    return out.withColumn("team", F.coalesce(F.col("team"), F.lit(C.DEFAULT_TEAM)))


def _lookup(pairs: list[tuple[str, str]], key: Column, default: str) -> Column:
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


def notification_fields(df: DataFrame, mention_on_complex: bool = True, host: str = C.ISSUE_URL_HOST) -> DataFrame:
    """Message fields per scored issue (the team lookup must have run)."""
    cls = F.coalesce(F.col("complexity"), F.lit("unknown"))
    number = F.coalesce(F.col("issue_number").cast("string"), F.lit("0"))
    repo = F.coalesce(F.col("repo"), F.lit("unknown"))
    url = F.concat(F.lit(host + "/"), repo, F.lit("/issues/"), number)
    title = F.substring(F.coalesce(F.col("title"), F.lit("Untitled")), 1, C.NOTIFY_TITLE_CHARS)
    pct = TX.percent0(F.coalesce(F.col("confidence"), F.lit(0.0)))
    mention = F.when(F.lit(mention_on_complex) & (cls == "complex"), F.lit(C.COMPLEX_MENTION))
    log_line = F.concat(F.lit("[Notification] Issue #"), F.coalesce(F.col("issue_number").cast("string"), F.lit("None")),
                        F.lit(" in "), F.coalesce(F.col("repo"), F.lit("None")), F.lit(" - Complexity: "), cls,
                        F.lit(" ("), pct, F.lit(") - Assign to: "), F.col("team"))
    return df.select(
        "*",
        _lookup(C.COMPLEXITY_EMOJI, cls, C.DEFAULT_EMOJI).alias("emoji"),
        _lookup(C.COMPLEXITY_COLORS, cls, C.DEFAULT_COLOR).alias("color"),
        url.alias("issue_url"),
        F.concat(F.lit("*<"), url, F.lit("|#"), number, F.lit(": "), title, F.lit(">*")).alias("headline"),
        F.upper(cls).alias("complexity_upper"),
        pct.alias("confidence_pct"),
        mention.alias("mention"),
        log_line.alias("log_line"),
    )


def _marked(text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), text.alias("text"))


def _plain(text: Column) -> Column:
    return F.struct(F.lit("plain_text").alias("type"), text.alias("text"), F.lit(True).alias("emoji"))


def notification_payload(fields: DataFrame, triaged_at: Column | None = None) -> Column:
    """JSON message for the outbox (delivery itself is out of scope): header, headline, four fields, divider, button, time.

    Every block is an object of its own type; ``text`` is null unless a mention is due.
    """
    at = F.current_timestamp() if triaged_at is None else triaged_at
    parts = [
        F.struct(F.lit("header").alias("type"), _plain(F.concat(F.col("emoji"), F.lit(C.NOTIFY_HEADER))).alias("text")),
        F.struct(F.lit("section").alias("type"), _marked(F.col("headline")).alias("text")),
        F.struct(F.lit("section").alias("type"), F.array(
            _marked(F.concat(F.lit("*Repository:*\n`"), F.coalesce(F.col("repo"), F.lit("unknown")), F.lit("`"))),
            _marked(F.concat(F.lit("*Complexity:*\n"), F.col("emoji"), F.lit(" "), F.col("complexity_upper"))),
            _marked(F.concat(F.lit("*Confidence:*\n"), F.col("confidence_pct"))),
            _marked(F.concat(F.lit("*Assign To:*\n"), F.col("team")))).alias("fields")),
        F.struct(F.lit("divider").alias("type")),
        F.struct(F.lit("actions").alias("type"), F.array(F.struct(
            F.lit("button").alias("type"), _plain(F.lit(C.NOTIFY_BUTTON)).alias("text"), F.col("issue_url").alias("url"),
            F.lit("primary").alias("style"))).alias("elements")),
        F.struct(F.lit("context").alias("type"), F.array(_marked(F.concat(
            F.lit(C.NOTIFY_TIME), F.date_format(at, "yyyy-MM-dd HH:mm:ss")))).alias("elements")),
    ]
    # Blocks differ in shape, so each is written by itself and the list is put together as text.
    blocks = F.concat_ws(",", *[F.to_json(b) for b in parts])
    listed = F.to_json(F.array("mention"))  # a list of one string: without its brackets, the string in quotes
    text = F.when(F.col("mention").isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))
    return F.concat(F.lit('{"text":'), text, F.lit(',"attachments":[{"color":"'), F.col("color"), F.lit('","blocks":['), blocks, F.lit("]}]}"))


def suggest_remedy(df: DataFrame) -> Column:
    """Remedy text by class, with design-review and escalation clauses."""
    pct = F.concat(F.bround(F.coalesce(F.col("confidence"), F.lit(0.0)) * 100, 0).cast("bigint").cast("string"),
                   F.lit("%"))
    labels = TX.lowered_label_array(TX.label_array("labels", df.schema["labels"].dataType))
    design = TX.any_label_in(labels, C.DESIGN_LABELS)
    escalate = F.coalesce(F.col("comments"), F.lit(0)) >= C.ESCALATION_COMMENTS

    def fill(template: str, **parts: Column) -> Column:
        pieces, rest = [], template
        while "{" in rest:
            pre, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            pieces += [F.lit(pre), parts[name]]
        pieces.append(F.lit(rest))
        return F.concat(*pieces)

    return (
        F.when(F.col("complexity") == "simple", fill(C.REMEDY_SIMPLE, pct=pct))
        .when(F.col("complexity") == "moderate", fill(
            C.REMEDY_MODERATE, pct=pct, design=F.when(design, F.lit(C.REMEDY_DESIGN)).otherwise(F.lit(""))))
        .when(F.col("complexity") == "complex", fill(
            C.REMEDY_COMPLEX, pct=pct, escalation=F.when(escalate, F.lit(C.REMEDY_ESCALATION)).otherwise(F.lit(""))))
        .otherwise(fill(C.REMEDY_OTHER, pct=pct))
    )


def advisor_prompt(title: Column, body: Column, labels: Column) -> Column:
    """The advisor prompt per issue; the body is cut to its first 3000 characters."""
    pre, rest = C.ADVISOR_PROMPT.split("{title}")
    mid, rest = rest.split("{labels}")
    mid2, post = rest.split("{body}")
    return F.concat(F.lit(pre), F.coalesce(title, F.lit("")), F.lit(mid),
                    F.array_join(F.coalesce(labels, F.array().cast("array<string>")), ", "), F.lit(mid2),
                    F.substring(F.coalesce(body, F.lit("")), 1, C.PROMPT_BODY_CHARS), F.lit(post))


def open_issue_triage(issues: DataFrame) -> DataFrame:
    """Open issues -> batch score -> the outbound ``complexity:*`` label per issue (one plan)."""
    from issuelens.functions.score import with_heuristic

    open_ = issues.where(F.col("state") == "open")
    scored = with_heuristic(open_)
    return scored.select(
        "number", "repo", "complexity", "confidence",
        complexity_label(F.col("complexity")).alias("new_label"),
        relabel(F.col("labels"), complexity_label(F.col("complexity")), F.lit(False)).alias("labels_after"),
    )


def feedback_record(df: DataFrame, predicted: str = "complexity") -> DataFrame:
    """The 8-field feedback-log row (labels comma-joined, human label blank)."""
    return df.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("repo"),
        F.col("issue_number"),
        F.col("title"),
        F.array_join(F.coalesce(F.col("labels"), F.array().cast("array<string>")), ",").alias("labels"),
        F.col("comments"),
        F.coalesce(F.col(predicted), F.lit("")).alias("predicted_complexity"),
        F.lit("").alias("human_label"),
    )


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Feedback volume (records, not physical lines) and the labelled share."""
    labelled = F.length(TX.py_strip(F.coalesce(F.col("human_label"), F.lit("")))) > 0
    return feedback.agg(
        F.count(F.lit(1)).alias("feedback_records"),
        F.count_if(labelled).alias("labelled_records"),
    ).withColumn("labelled_share", F.when(F.col("feedback_records") > 0,
                                          F.col("labelled_records") / F.col("feedback_records")))


def retrain_due(feedback: DataFrame, since=None, threshold: int = C.MIN_ISSUES_FOR_RETRAIN) -> DataFrame:
    """New labelled feedback since the last training run, per repository and overall."""
    f = feedback
    if since is not None:
        f = f.where(F.col("timestamp") > F.lit(since))
    labelled = F.length(TX.py_strip(F.coalesce(F.col("human_label"), F.lit("")))) > 0
    agg = f.where(labelled).rollup("repo").agg(F.count(F.lit(1)).alias("new_feedback"))
    return agg.withColumn("threshold", F.lit(threshold).cast("bigint")).withColumn(
        "due", F.col("new_feedback") >= F.col("threshold"))
