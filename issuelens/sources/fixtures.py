"""Issue-tracker views derived from the given tables.

The test tables hold no issue data, so each view maps a given table onto
the reference's data model with deterministic expressions (documented in
FIXTURES.md).  Every view is a lazy projection of its table, so all work
grows with the data; the DuckDB oracle builds the same views in SQL
(``issuelens.plans.oracle_views``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.crypto import hmac_sha256_hex
from issuelens.functions.score import with_heuristic
from issuelens.session import spread, table

BASE_TS = "2024-01-01 00:00:00"
FEEDBACK_BASE_TS = "2024-03-01 00:00:00"
FENCE = "```"
EVENTS_A_TASK = 50_000


def _when_mod(col: Column, m: int, value) -> Column:
    return F.when(col % m == 0, F.lit(value))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    did = F.col("doc_id")
    first_line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    code_block = F.concat(F.lit(FENCE + "py"), F.lit("\n"), F.lit("x = 1"), F.lit("\n"), F.lit(FENCE))
    return d.select(
        did.alias("number"),
        F.concat(F.lit("org/"), F.col("source")).alias("repo"),
        F.concat(F.lit("u"), (did % 37).cast("string")).alias("author"),
        F.concat(
            F.when(did % 19 == 0, F.lit("Perf: ")).otherwise(F.lit("")), F.substring(first_line, 1, 120)
        ).alias("title"),
        F.concat_ws(
            "\n",
            F.col("text"),
            F.when(did % 4 == 0, code_block),
            _when_mod(did, 6, "![shot](img.png)"),
            _when_mod(did, 5, "See https://example.com/1"),
        ).alias("body"),
        F.filter(
            F.array(
                _when_mod(did, 5, "bug"),
                _when_mod(did, 7, "performance"),
                _when_mod(did, 11, "security"),
                _when_mod(did, 13, "docs"),
                _when_mod(did, 3, "enhancement"),
                F.col("lang"),
            ),
            lambda x: x.isNotNull(),
        ).alias("labels"),
        F.when(did % 31 == 0, F.lit(None).cast("bigint")).otherwise(did % 9).alias("comments"),
        F.timestamp_add("HOUR", did.cast("int"), F.lit(BASE_TS).cast("timestamp_ntz")).alias("created_at"),
        F.when(did % 3 == 0, F.lit("open")).otherwise(F.lit("closed")).alias("state"),
        (did % 17 == 0).alias("is_pr"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback log rows: one per labelled document, plus an older copy for doc_id % 4 = 0."""
    lab = table(spark, sf_dir, "labels")
    iss = issues(spark, sf_dir).select("number", "repo", "title", "labels", "comments")
    gens = lab.select("*", F.explode(F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))).alias("gen"))
    j = gens.join(iss, gens.doc_id == iss.number, "inner")
    minutes = (F.col("doc_id") - F.lit(1440) * F.col("gen")).cast("int")
    human = (
        F.when(F.col("doc_id") % 10 == 0, F.lit(None).cast("string"))
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit("simple"))
        .when(F.col("toxic") == 1, F.lit("complex"))
        .otherwise(F.lit("moderate"))
    )
    predicted = F.element_at(F.array(*[F.lit(c) for c in C.CLASSES]), (F.col("doc_id") % 3 + 1).cast("int"))
    return j.select(
        F.timestamp_add("MINUTE", minutes, F.lit(FEEDBACK_BASE_TS).cast("timestamp_ntz")).alias("timestamp"),
        F.col("repo"),
        F.col("doc_id").alias("issue_number"),
        F.col("title"),
        F.array_join(F.col("labels"), ",").alias("labels"),
        F.col("comments"),
        predicted.alias("predicted_complexity"),
        human.alias("human_label"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: first turn's text as title, later turns as comments."""
    conv = table(spark, sf_dir, "conversations")
    return conv.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("title"),
        (F.count(F.lit(1)) - 1).alias("comments"),
    ).withColumnRenamed("conv_id", "number")


def _json_str(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def webhook_events(spark: SparkSession, sf_dir: str, secret: str = C.WEBHOOK_SECRET) -> DataFrame:
    """Landed webhook deliveries: envelope columns plus the raw JSON body and its signature."""
    ev = spread(table(spark, sf_dir, "events"), EVENTS_A_TASK)  # a row of 50 bytes becomes a body of kilobytes
    et = F.col("event_type")
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    event = (
        F.when(et.isin("error", "view", "signup"), F.lit("issues"))
        .when(et == "click", F.lit("issue_comment"))
        .when(et == "purchase", F.lit("push"))
    )
    action = (
        F.when(et == "error", F.lit("opened"))
        .when(et == "view", F.when(k % 2 == 1, F.lit("reopened")).otherwise(F.lit("edited")))
        .when(et == "signup", F.lit("closed"))
        .when(et == "click", F.lit("created"))
    )
    number = F.col("user_id")
    repo = F.concat(F.lit("org/src"), (number % 20).cast("string"))
    body = F.trim(F.repeat(F.lit("word "), F.floor(F.col("value") * 10).cast("int")))
    comment = F.when(et == "click", F.concat(F.lit(',"comment":{"id":'), F.col("event_id").cast("string"), F.lit("}"))
                     ).otherwise(F.lit(""))
    raw = F.concat(
        F.lit('{"action":'), F.coalesce(_json_str(action), F.lit("null")),
        F.lit(',"issue":{"number":'), number.cast("string"),
        F.lit(',"title":"Issue '), number.cast("string"),
        F.lit('","body":"'), body,
        F.lit('","comments":'), k.cast("string"),
        # Some issues bear complexity labels already: one, the same twice, or two different ones around another label.
        F.lit(',"labels":['), F.when(number % 5 == 0, F.lit('{"name":"complexity:simple"},')).otherwise(F.lit("")), F.lit('{"name":"bug"}'),
        F.when(number % 3 == 0, F.lit(',{"name":"complexity:moderate"}')).otherwise(F.lit("")),
        F.when(number % 7 == 0, F.lit(',{"name":"docs"},{"name":"complexity:simple"}')).otherwise(F.lit("")),
        F.lit(']},"repository":{"full_name":"'), repo, F.lit('"}'),
        comment, F.lit("}"),
    )
    did = F.col("event_id")
    base = ev.select(
        did.alias("delivery_id"),
        F.col("ts"),
        event.alias("event"),
        action.alias("action"),
        number.alias("number"),
        repo.alias("repo"),
        k.alias("comments"),
        raw.alias("raw"),
    )
    did = F.col("delivery_id")
    sig = (
        F.when(did % 97 == 0, F.lit(None).cast("string"))
        .when(did % 10 == 0, F.lit(C.BAD_SIGNATURE))
        .otherwise(F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("raw"), secret)))
    )
    return base.withColumn("signature", sig)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: every issue scored by the heuristic, stamped at its creation time."""
    iss = issues(spark, sf_dir)
    scored = with_heuristic(iss)
    return scored.select(
        F.col("created_at").alias("timestamp"),
        "repo",
        F.col("number").alias("issue_number"),
        "title",
        "labels",
        "comments",
        "complexity",
        "confidence",
        "p_simple",
        "p_moderate",
        "p_complex",
    )
