"""Registered learning queries.

The issues of the model keys have a comment count that follows from the text's length (every eleventh keeps an unrelated
one), so a model can learn something.  What a model returns cannot be had from SQL; the model keys return what can: ids,
labels, scaled columns, counts, and sums and comparisons with known values.  ``<key>_rows`` return the outputs themselves.
Every key computes what it needs from the tables; intermediate tables lie in the shared folder and nothing is
kept between queries.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.score import with_heuristic
from issuelens.operators import boosting, text_model
from issuelens.operators import learn as L
from issuelens.operators import models as M
from issuelens.operators.features import dedup_keep_last, fit_scaler, numeric_text_features, with_label
from issuelens.operators.neighbours import staged
from issuelens.plans.features_q import _feature_sql_cols
from issuelens.plans.oracle_views import scored_cte, with_views
from issuelens.plans.registry import query
from issuelens.session import scratch_path
from issuelens.sources import fixtures as FX

NOISE = 11
CHARS_A_COMMENT = 500


def learning_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    follows = F.least(F.lit(8).cast("bigint"), F.expr(f"length(body) div {CHARS_A_COMMENT}"))
    return FX.issues(spark, sf_dir).withColumn("comments", F.when(F.col("number") % NOISE != 0, follows).otherwise(F.col("comments")))


@dataclass
class Training:
    """The steps of one training run, each computed when first asked for and written to the shared folder."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def split(self) -> DataFrame:
        return staged(L.training_frame(learning_issues(self.spark, self.sf_dir), L.stratified_split), "learn-split")

    @cached_property
    def probabilities(self) -> DataFrame:
        return staged(L.fitted_text_probabilities(self.split, ~F.col("is_test")), "learn-probabilities")

    @cached_property
    def stacked(self) -> DataFrame:
        train = self.split.where(~F.col("is_test"))
        return staged(L.stacking_features(train, self.probabilities).select("repo", "number", "label", "is_test", *L.STACK_COLS), "learn-stacked")

    @cached_property
    def balanced(self) -> DataFrame:
        return staged(L.smote_balance(self.stacked.where(~F.col("is_test")), L.STACK_COLS), "learn-balanced")

    @cached_property
    def model(self) -> boosting.Model:
        return L.fit_stacked(self.balanced, self.stacked.where("is_test"), L.STACK_COLS)

    @cached_property
    def predicted(self) -> DataFrame:
        return staged(L.predict_stacked(self.model, self.stacked.where("is_test")), "learn-predicted")


# ------------------------------------------------------------- split
_DEDUP_LABELLED = with_views("issues") + """,
dd AS (SELECT *, row_number() OVER (PARTITION BY title, body ORDER BY number DESC) AS _rn FROM issues),
lab AS (SELECT *, CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label
        FROM dd WHERE _rn = 1),
sp AS (
  SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(number AS VARCHAR)), number) - 1)
              < ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_test
  FROM lab)"""


# The same with the comment counts of the model keys.
_LEARNING = _DEDUP_LABELLED.replace(
    "dd AS (SELECT *, row_number()",
    f"""li AS (SELECT * REPLACE (CASE WHEN number % {NOISE} <> 0 THEN least(8, length(body) // {CHARS_A_COMMENT}) ELSE comments END AS comments) FROM issues),
dd AS (SELECT *, row_number()""").replace("AS _rn FROM issues)", "AS _rn FROM li)")


@query("stratified_split", _DEDUP_LABELLED + "\nSELECT number, label, is_test FROM sp")
def q_stratified_split(spark, sf_dir):
    frame = with_label(dedup_keep_last(FX.issues(spark, sf_dir).select("number", "title", "body", "comments"),
                                         ordinal="number", payload=["number", "comments"]))
    return L.stratified_split(frame.select("number", "label")).select("number", "label", "is_test")


@query("smote_class_counts", _LEARNING + """,
t AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, max(n) OVER () AS n FROM t""")
def q_smote_class_counts(spark, sf_dir):
    """Class sizes after balancing, of the numeric features alone (no text model is needed for the counts)."""
    split = Training(spark, sf_dir).split
    return L.smote_balance(split.where(~F.col("is_test")), C.NUMERIC_FEATURES).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- softmax
SOFTMAX_SQL = with_views("issues") + f""",
f AS (SELECT number, {_feature_sql_cols()} FROM issues),
lg AS (SELECT number, len_title / 100.0 AS l0, word_count / 1000.0 AS l1, (has_code + has_image + has_url) * 1.0 AS l2
       FROM f),
m AS (SELECT *, greatest(l0, l1, l2) AS mx FROM lg),
e AS (SELECT number, exp(l0 - mx) AS e0, exp(l1 - mx) AS e1, exp(l2 - mx) AS e2 FROM m)
SELECT number, round(e0 / (e0 + e1 + e2), 9) AS p_simple, round(e1 / (e0 + e1 + e2), 9) AS p_moderate,
       round(e2 / (e0 + e1 + e2), 9) AS p_complex
FROM e"""


@query("softmax_probs", SOFTMAX_SQL)
def q_softmax_probs(spark, sf_dir):
    """Max-shifted softmax over three per-issue scores derived from the text features."""
    f = numeric_text_features(FX.issues(spark, sf_dir))
    logits = [F.col("len_title") / 100.0, F.col("word_count") / 1000.0,
              (F.col("has_code") + F.col("has_image") + F.col("has_url")) * 1.0]
    mx = F.greatest(*logits)
    ex = [F.exp(lg - mx) for lg in logits]
    total = ex[0] + ex[1] + ex[2]
    return f.select("number", *[F.round(e / total, 9).alias(f"p_{c}") for e, c in zip(ex, C.CLASSES)])


# ------------------------------------------------------------- evaluation
_EVAL_PAIRS = with_views("issues") + """,
""" + scored_cte("sc", "issues")[1:] + """,
pairs AS (
  SELECT CAST(CASE WHEN comments <= 1 THEN 0 WHEN comments <= 5 THEN 1 ELSE 2 END AS INTEGER) AS label,
         CAST(CASE complexity WHEN 'simple' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END AS INTEGER) AS prediction
  FROM sc),
conf AS (SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2),
cls AS (SELECT label AS cls FROM conf UNION SELECT prediction FROM conf),
pc AS (
  SELECT c.cls,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE label = c.cls AND prediction = c.cls), 0) AS BIGINT) AS tp,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE label = c.cls), 0) AS BIGINT) AS support,
         CAST(coalesce((SELECT sum(n) FROM conf WHERE prediction = c.cls), 0) AS BIGINT) AS predicted
  FROM cls c),
m AS (SELECT cls, tp, support,
             CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m)"""


def _heuristic_pairs(spark, sf_dir):
    scored = with_label(with_heuristic(FX.issues(spark, sf_dir)))
    return scored.select("label", L.class_id(F.col("complexity")).alias("prediction"))


@query("eval_per_class", _EVAL_PAIRS + """
SELECT cls, tp, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM f""")
def q_eval_per_class(spark, sf_dir):
    """Per-class report of the heuristic scorer against comment-derived labels."""
    pc = L.per_class_metrics(L.confusion(_heuristic_pairs(spark, sf_dir)))
    return pc.select("cls", "tp", *[F.round(m, 9).alias(m) for m in ["precision", "recall", "f1"]], "support")


@query("eval_weighted", _EVAL_PAIRS + """
SELECT round(sum(tp) / sum(support), 9) AS accuracy,
       round(sum(precision * support) / sum(support), 9) AS precision,
       round(sum(recall * support) / sum(support), 9) AS recall,
       round(sum(f1 * support) / sum(support), 9) AS f1,
       CAST(sum(support) AS BIGINT) AS n
FROM f""")
def q_eval_weighted(spark, sf_dir):
    """Accuracy and weighted precision / recall / F1 of the heuristic against comment-derived labels."""
    w = L.weighted_metrics(L.confusion(_heuristic_pairs(spark, sf_dir)))
    return w.select(*[F.round(m, 9).alias(m) for m in ["accuracy", "precision", "recall", "f1"]], "n")


# ------------------------------------------------------------- model keys
@query("text_probabilities", _LEARNING + """
SELECT repo, number, is_test, 1.0 AS prob_sum, TRUE AS in_range FROM sp""")
def q_text_probabilities(spark, sf_dir):
    p = [F.col(c) for c in L.PROB_COLS]
    whole = p[0] + p[1] + p[2]
    return Training(spark, sf_dir).probabilities.select(
        "repo", "number", "is_test", F.round(whole, 9).alias("prob_sum"), (F.least(*p) >= 0).alias("in_range"))


@query("text_probabilities_rows")
def q_text_probabilities_rows(spark, sf_dir):
    return Training(spark, sf_dir).probabilities.select("repo", "number", "is_test", *L.PROB_COLS)


_FEATURE_ROWS = _LEARNING + """,
nf AS (SELECT repo, number, author, created_at, label, is_test, {features} FROM sp),
uh AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_at, repo, number) - 1 AS user_issue_count FROM nf),
fr AS (SELECT *, CASE WHEN user_issue_count = 0 THEN 1 ELSE 0 END AS is_new_user, 0 AS reactions FROM uh)"""


def _scaled_sql() -> str:
    cols = C.NUMERIC_FEATURES
    stats = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in cols)
    out = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}_scaled" for c in cols)
    return (_FEATURE_ROWS.replace("{features}", _feature_sql_cols()) + f""",
st AS (SELECT {stats} FROM fr WHERE NOT is_test)
SELECT repo, number, label, is_test, {out} FROM fr, st""")


@query("stacking_features", _scaled_sql())
def q_stacking_features(spark, sf_dir):
    """The ten numeric features scaled with the training part's mean and deviation (probabilities: ``stacking_features_rows``)."""
    split = Training(spark, sf_dir).split
    scaled = L.stacking_features(split.where(~F.col("is_test")), split)
    return scaled.select("repo", "number", "label", "is_test", *[(F.round(f"{c}_scaled", 6) + 0.0).alias(f"{c}_scaled") for c in C.NUMERIC_FEATURES])


@query("stacking_features_rows")
def q_stacking_features_rows(spark, sf_dir):
    return Training(spark, sf_dir).stacked


@query("smote_balance", _LEARNING + """,
t AS (SELECT label, count(*) AS n FROM sp WHERE NOT is_test GROUP BY label)
SELECT label, n AS n_rows, max(n) OVER () - n AS n_synthetic, 0 AS n_off_segment, 0 AS n_other_class, 0 AS n_same_row, TRUE AS recall_90 FROM t""")
def q_smote_balance(spark, sf_dir):
    """Balanced classes, checked row by row: every synthetic row lies between two rows of its class, and the second is among
    the five nearest of the first in nine cases of ten or more, by brute force of the base rows whose number 50 divides."""
    run = Training(spark, sf_dir)
    cols = C.NUMERIC_FEATURES
    train = staged(run.split.where(~F.col("is_test")).select("repo", "number", "label", *[F.col(c).cast("double").alias(c) for c in cols]), "smote-train")
    return smote_report(train, L.smote_balance(train, cols), cols)


def smote_report(train: DataFrame, balanced: DataFrame, cols: list[str]) -> DataFrame:
    """Per class: rows, synthetic rows, and how many of these break a rule of the balancing."""
    made = staged(balanced.where("synthetic"), "smote-made")
    place = {s: train.select(F.col("repo").alias(f"{s}_repo"), F.col("number").alias(f"{s}_id"), F.col("label").alias(f"{s}_label"),
                             F.array(*cols).alias(f"{s}_v")) for s in ("source", "neighbour")}
    both = made.select("label", "gap", "source_repo", "source_id", "neighbour_repo", "neighbour_id", F.array(*cols).alias("v"))
    for s, side in place.items():
        both = both.join(side, [f"{s}_repo", f"{s}_id"])
    off = F.exists(F.zip_with("v", F.zip_with("source_v", "neighbour_v", lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                              lambda x, e: (x < F.least(e["a"], e["b"]) - 1e-9) | (x > F.greatest(e["a"], e["b"]) + 1e-9)), lambda bad: bad)
    gone = F.aggregate(F.zip_with("source_v", "neighbour_v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    checked = staged(both.withColumn("gone", gone), "smote-checked")
    # Searched again by brute force: the rows of each class against base rows whose number 50 divides.
    few = checked.where("source_id % 50 = 0").select("label", "source_repo", "source_id", "neighbour_repo", "neighbour_id", "source_v", "gone").distinct()
    far = closer_points(few, train.select("label", F.array(*cols).alias("v")).distinct())
    missed = far.where(F.col("k") >= C.SMOTE_K).groupBy("label").agg(F.count(F.lit(1)).alias("missed"))
    tried = few.groupBy("label").agg(F.count(F.lit(1)).alias("tried"))
    rules = checked.groupBy("label").agg(
        F.count_if(off).alias("n_off_segment"),
        F.count_if((F.col("source_label") != F.col("label")) | (F.col("neighbour_label") != F.col("label"))).alias("n_other_class"),
        F.count_if((F.col("source_id") == F.col("neighbour_id")) & (F.col("source_repo") == F.col("neighbour_repo"))).alias("n_same_row"))
    sizes = balanced.groupBy("label").agg(F.count_if(~F.col("synthetic")).alias("n_rows"), F.count_if("synthetic").alias("n_synthetic"))
    out = sizes.join(rules, "label", "left").join(missed, "label", "left").join(tried, "label", "left")
    none = ("n_off_segment", "n_other_class", "n_same_row")
    enough = F.coalesce(F.col("missed"), F.lit(0)) <= 0.1 * F.coalesce(F.col("tried"), F.lit(0))
    return out.select("label", "n_rows", "n_synthetic", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in none], enough.alias("recall_90"))


POINTS_A_GROUP = 50_000
BASES_A_GROUP = 10_000


def closer_points(few: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of ``few`` (their keys) with the number ``k`` of the class's distinct points, all of them tried, nearer to ``source_v`` than ``gone``.

    Both sides are dealt by hash into groups of bounded size, and every group of one side meets every group of the other in a
    task of its own.  In a group the points lie in the order of one entry: only those whose entry alone is not too far are
    subtracted in full; the rest cannot be nearer.
    """
    keys = ["label", "source_repo", "source_id", "neighbour_repo", "neighbour_id"]
    few, points = staged(few, "smote-bases"), staged(points, "smote-points")
    n, m = max(1, -(-points.count() // POINTS_A_GROUP)), max(1, -(-few.count() // BASES_A_GROUP))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = points.select("label", "v", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int").alias("_p"), every(m).alias("_q"))
    left = few.select(*keys, "source_v", "gone", F.pmod(F.xxhash64(*keys), F.lit(m)).cast("int").alias("_q"), every(n).alias("_p"))

    def count(bases, near):
        if not len(bases) or not len(near):
            return bases[keys].assign(k=np.int64(0))
        v, w, gone = np.stack(near["v"].to_numpy()), np.stack(bases["source_v"].to_numpy()), bases["gone"].to_numpy()
        along = int(np.argmax(v.std(axis=0)))
        v = v[np.argsort(v[:, along], kind="stable")]
        reach = np.sqrt(gone) * (1 + 1e-9) + 1e-9 * (1 + np.abs(w[:, along]))  # more than rounding can lose
        lo, hi = np.searchsorted(v[:, along], w[:, along] - reach, "left"), np.searchsorted(v[:, along], w[:, along] + reach, "right")
        k = np.zeros(len(w), np.int64)
        for i in range(len(w)):
            part = v[lo[i] : hi[i]]
            d = np.zeros(len(part))
            for c in range(v.shape[1]):
                d += (w[i, c] - part[:, c]) ** 2
            k[i] = np.count_nonzero((d < gone[i]) & (part != w[i]).any(axis=1))
        return bases[keys].assign(k=k)

    by = ["label", "_p", "_q"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(count, few.select(*keys).schema.add("k", "long"))
    return found.groupBy(*keys).agg(F.sum("k").alias("k"))


@query("smote_balance_rows")
def q_smote_balance_rows(spark, sf_dir):
    return Training(spark, sf_dir).balanced


@query("stacking_predict", _LEARNING + """
SELECT repo, number, label, 1.0 AS prob_sum, TRUE AS likeliest FROM sp WHERE is_test""")
def q_stacking_predict(spark, sf_dir):
    p = [F.col(f"p_{c}") for c in C.CLASSES]
    whole, top = p[0] + p[1] + p[2], F.element_at(F.array(*p), F.col("prediction") + 1)
    return Training(spark, sf_dir).predicted.select(
        "repo", "number", "label", F.round(whole, 9).alias("prob_sum"),
        ((top == F.greatest(*p)) & (F.element_at(F.array(*[F.lit(c) for c in C.CLASSES]), F.col("prediction") + 1) == F.col("complexity"))).alias("likeliest"))


@query("stacking_predict_rows")
def q_stacking_predict_rows(spark, sf_dir):
    return Training(spark, sf_dir).predicted.select("repo", "number", "label", "p_simple", "p_moderate", "p_complex", "prediction", "complexity")


_IMPORTANCE_NAMES = dict(zip(L.STACK_COLS, ["BERT_Simple", "BERT_Moderate", "BERT_Complex"] + C.NUMERIC_FEATURES))


@query("feature_importance", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 1.0, TRUE)" for n in _IMPORTANCE_NAMES.values())
       + ") t(feature, total, in_range)")
def q_feature_importance(spark, sf_dir):
    """Every feature with the sum of all importances (1) and whether its own lies in [0, 1]."""
    ranked = boosting.importance(Training(spark, sf_dir).model)
    whole = round(sum(v for _, v in ranked), 9)
    return spark.createDataFrame([(_IMPORTANCE_NAMES[c], whole, 0.0 <= v <= 1.0) for c, v in ranked], "feature string, total double, in_range boolean")


@query("feature_importance_rows")
def q_feature_importance_rows(spark, sf_dir):
    ranked = boosting.importance(Training(spark, sf_dir).model)
    return spark.createDataFrame([(_IMPORTANCE_NAMES[c], float(v)) for c, v in ranked], "feature string, importance double")


def train_evaluate_metrics(run: Training) -> DataFrame:
    """Validation metrics of the stacked model, the majority class's accuracy and the rounds grown and used (one row).

    Each part is a small aggregate; the dozen resulting numbers are assembled on the driver into one row.
    """
    conf = staged(L.confusion(run.predicted), "learn-confusion")
    w = L.weighted_metrics(conf).first().asDict()
    f1 = {r["cls"]: r["f1"] for r in L.per_class_metrics(conf).collect()}  # at most 3 rows
    split = run.split
    counts = split.agg(F.count_if(~F.col("is_test")).alias("tr"), F.count_if(F.col("is_test")).alias("va")).first()
    majority = split.where(~F.col("is_test")).groupBy("label").count().orderBy(F.desc("count"), "label").first()[0]
    base = run.predicted.agg(F.avg((F.col("label") == majority).cast("double")).alias("b")).first()["b"]
    row = (w["accuracy"], w["precision"], w["recall"], w["f1"], *[f1.get(i, 0.0) for i in range(3)], base,
           int(counts["tr"]), int(counts["va"]), len(run.model.rounds), run.model.best)
    schema = ("accuracy double, precision double, recall double, f1 double, f1_simple double, f1_moderate double, "
              "f1_complex double, majority_accuracy double, training_samples bigint, validation_samples bigint, "
              "rounds_grown int, rounds_used int")
    return run.spark.createDataFrame([row], schema)


_EVALUATE_SQL = _LEARNING + """,
t AS (SELECT label, count_if(NOT is_test) AS tr, count_if(is_test) AS va FROM sp GROUP BY label),
mj AS (SELECT label FROM t ORDER BY tr DESC, label LIMIT 1)
SELECT (SELECT CAST(sum(tr) AS BIGINT) FROM t) AS training_samples, (SELECT CAST(sum(va) AS BIGINT) FROM t) AS validation_samples,
       round((SELECT va FROM t WHERE label = (SELECT label FROM mj)) / (SELECT sum(va) FROM t), 9) AS majority_accuracy,
       TRUE AS beats_majority, TRUE AS stopped_by_patience_or_rounds"""


@query("train_evaluate", _EVALUATE_SQL)
def q_train_evaluate(spark, sf_dir):
    m = train_evaluate_metrics(Training(spark, sf_dir))
    s = boosting.Settings()
    return m.select(
        "training_samples", "validation_samples", F.round("majority_accuracy", 9).alias("majority_accuracy"),
        (F.col("accuracy") > F.col("majority_accuracy")).alias("beats_majority"),
        ((F.col("rounds_grown") == s.rounds) | (F.col("rounds_grown") - F.col("rounds_used") == s.patience)).alias("stopped_by_patience_or_rounds"))


@query("train_evaluate_rows")
def q_train_evaluate_rows(spark, sf_dir):
    return train_evaluate_metrics(Training(spark, sf_dir))


METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "f1_simple", "f1_moderate", "f1_complex", "majority_accuracy",
                "training_samples", "validation_samples", "rounds_grown", "rounds_used"]


def write_metrics(run: Training, path: str) -> None:
    """Append the run's metrics (with run id, settings, time) to a metrics table."""
    m = train_evaluate_metrics(run)
    params = {**asdict(boosting.Settings()), "test_size": C.TEST_SIZE}
    m.select(
        F.lit(uuid.uuid4().hex).alias("run_id"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("timestamp"),
        F.lit(json.dumps(params)).alias("params"),
        F.create_map(*[x for c in METRIC_NAMES for x in (F.lit(c), F.col(c).cast("double"))]).alias("metrics"),
    ).write.mode("append").parquet(path)


@query("eval_metrics_write", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 1, TRUE)" for n in METRIC_NAMES) + ") t(metric, runs, in_range)")
def q_eval_metrics_write(spark, sf_dir):
    """The metrics table after one run, read back: every metric once, shares between 0 and 1."""
    path = scratch_path(spark, "metrics")
    write_metrics(Training(spark, sf_dir), path)
    back = spark.read.parquet(path).select("run_id", F.explode("metrics").alias("metric", "value"))
    share = ~F.col("metric").isin("training_samples", "validation_samples", "rounds_grown", "rounds_used")
    return back.groupBy("metric").agg(
        F.countDistinct("run_id").alias("runs"), F.every((F.col("value") >= 0) & (~share | (F.col("value") <= 1))).alias("in_range"))


@query("eval_metrics_rows")
def q_eval_metrics_rows(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    write_metrics(Training(spark, sf_dir), path)
    return spark.read.parquet(path)


# ------------------------------------------------------------- the chain of saved models (M2, M8)
CHAIN = {"all": "stacked", "text": "text", "none": "heuristic"}


@query("model_chain_score", with_views("issues") + """,
saved AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}')" for k, v in CHAIN.items()) + """) v(saved, best))
SELECT saved, repo, number, CASE WHEN number % 23 = 0 THEN 'heuristic' ELSE best END AS model, TRUE AS sums_to_one, TRUE AS likeliest
FROM issues, saved""")
def q_model_chain_score(spark, sf_dir):
    """Every issue scored by what a model folder holds: stacked over the sequence model, the sequence model alone, nothing.

    The sequence model's probabilities that the boosted model learns from are out of fold.  Every 23rd issue arrives without title
    and body: the text model fails on it, and it falls to the heuristic.
    """
    run = Training(spark, sf_dir)
    shape = text_model.Shape(epochs=3, per_class=300)
    seen = staged(text_model.out_of_fold(run.split, folds=2, shape=shape).drop("text"), "chain-folds").dropna(subset=L.PROB_COLS)
    train = seen.where(~F.col("is_test"))
    stacked = staged(L.stacking_features(train, seen), "chain-stacked")
    boosted = L.fit_stacked(stacked.where(~F.col("is_test")), stacked.where("is_test"), L.STACK_COLS)
    sequence = text_model.fit(run.split.where(~F.col("is_test")), key=["repo", "number"], shape=shape)
    whole = M.Models(boosted=boosted, scaler=fit_scaler(train, C.NUMERIC_FEATURES), sequence=sequence)
    blank = F.col("number") % 23 == 0
    issues = FX.issues(spark, sf_dir).select("repo", "number", "labels", *[F.when(~blank, F.col(c)).alias(c) for c in ("title", "body")])
    out = None
    for name, models in (("all", whole), ("text", M.Models(sequence=sequence)), ("none", M.Models())):
        path = scratch_path(spark, f"chain-{name}")
        M.save_models(spark, models, path)
        scored = M.score(issues, M.load_models(spark, path)).select("repo", "number", F.lit(name).alias("saved"), "model", "complexity", "confidence",
                                                                    "p_simple", "p_moderate", "p_complex")
        out = scored if out is None else out.unionByName(scored)
    p = [F.col(f"p_{c}") for c in C.CLASSES]
    named = F.element_at(F.create_map(*[x for c in C.CLASSES for x in (F.lit(c), F.col(f"p_{c}"))]), F.col("complexity"))
    return out.select("saved", "repo", "number", "model", (F.abs(p[0] + p[1] + p[2] - 1) < 0.001).alias("sums_to_one"),
                      ((named == F.greatest(*p)) & (F.col("confidence") == named)).alias("likeliest"))
