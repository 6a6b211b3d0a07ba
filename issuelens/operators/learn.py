"""Learning operators: split, text model, stacked features, balancing, boosting, evaluation.

Only fitted models, level histograms of a fixed size and the tiny confusion table reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import boosting, term_model
from issuelens.operators.features import (
    apply_scaler,
    content_key,
    dedup_keep_last,
    fit_scaler,
    numeric_text_features,
    training_text,
    user_history,
    with_label,
)
from issuelens.operators.neighbours import nearest, node_of, staged
from issuelens.operators.scoring import class_name_map
from issuelens.operators.skew import running_count
from issuelens.session import cut_lineage

PROB_COLS = C.PROB_FEATURES
TEXT_BUCKETS = 1 << 16
STACK_COLS = PROB_COLS + [f"{c}_scaled" for c in C.NUMERIC_FEATURES]


# ------------------------------------------------------------------ data
def training_frame(issues: DataFrame, narrow: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Dedup (keep last by title+body) -> label from comments -> text -> numeric features.

    Only digests, numbers and the user go through the dedup, the history and ``narrow``, a step on the rows that needs no text; the
    text of each survivor is joined by its digests at the end, where the texts of equal digests have come together.
    Absent columns (comments, created_at, title, body, ...) read as null.
    """
    absent = {c: t for c, t in (("title", "string"), ("body", "string"), ("comments", "bigint"), ("created_at", "timestamp")) if c not in issues.columns}
    rows = issues.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}) if absent else issues
    given = [c for c in ("repo", "author", "labels", "reactions", "labels_count") if c in rows.columns]
    wide = rows.select("number", "created_at", "title", "body", "comments", *given, *content_key("title", "body"))
    numeric = numeric_text_features(wide).drop("title", "body", "labels")
    best = dedup_keep_last(numeric, ordinal="number", key_cols=["_k_title", "_k_body"], keyed=True)
    done = narrow(user_history(with_label(best)))
    # No digest is empty: the empty key of a null lets plain equality join, so that the texts are shuffled once.
    digests = {c: F.coalesce(F.col(c), F.lit(b"")) for c in ("_k_title", "_k_body")}
    texts = wide.select(*[d.alias(f"_t{c}") for c, d in digests.items()], training_text().alias("text"))
    texts = texts.groupBy(*[f"_t{c}" for c in digests]).agg(F.first("text").alias("text"))
    same = F.lit(True)
    for c in digests:
        same = same & (F.col(c) == F.col(f"_t{c}"))
    return done.withColumns(digests).join(texts, same).drop(*digests, *[f"_t{c}" for c in digests])


def hash_order(id_col: Column, seed: int = C.RANDOM_STATE) -> Column:
    """Deterministic pseudo-random order (md5 of seed and id); identical in SQL engines."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "number", test_size: float = C.TEST_SIZE,
                     seed: int = C.RANDOM_STATE) -> DataFrame:
    """Add ``is_test``: per class, the ceil(test_size * n) rows first in hash order.

    The rank inside a class is a range-sliced running count (a class can
    hold most rows); class sizes come from a 3-row aggregate.  An issue is
    (repo, number): numbers repeat between repositories.  Only this narrow
    key is ranked; rows that share a whole key get one flag, so the join
    back never multiplies rows.
    """
    ids = [c for c in ("repo", id_col) if c in df.columns]
    keys = cut_lineage(df.select(*ids, label, hash_order(F.col(id_col), seed).alias("_h")))
    ranked = running_count(keys, [label], [F.col("_h"), *[F.col(c) for c in reversed(ids)]], "_rank")
    sizes = keys.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    flags = ranked.join(F.broadcast(sizes), label).groupBy(*[F.col(c).alias(f"_id_{c}") for c in ids]).agg(
        F.max(F.col("_rank") < F.ceil(F.col("_n") * F.lit(test_size))).alias("is_test"))
    same = F.lit(True)
    for c in ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_id_{c}"))
    return df.join(flags, same).drop(*[f"_id_{c}" for c in ids])


# ------------------------------------------------------------------ text model
def _term_stages(buckets: int) -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern="(?U)\\W+", minTokenLength=1),
        NGram(n=C.TEXT_NGRAM_MAX, inputCol="_words", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(_words, _bigrams) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=buckets),
    ]


def _model_stages(max_iter: int) -> list:
    return [
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol="label", family="multinomial", maxIter=max_iter,
                           regParam=0.01, probabilityCol="_text_prob", predictionCol="_text_pred",
                           rawPredictionCol="_text_raw"),
    ]


def text_pipeline(buckets: int = TEXT_BUCKETS, max_iter: int = 50) -> Pipeline:
    """Words + bigrams -> hashed counts -> IDF -> multinomial logistic regression.

    Terms are hashed, so every term counts and no vocabulary is collected; the
    model's size is ``buckets`` coefficients a class, whatever the corpus.
    """
    return Pipeline(stages=[*_term_stages(buckets), *_model_stages(max_iter)])


def fitted_text_probabilities(df: DataFrame, fit_on: Column, buckets: int = TEXT_BUCKETS, max_iter: int = 50) -> DataFrame:
    """Every row of ``df`` without its text, with the probabilities of ``text_pipeline`` fitted on the rows of ``fit_on``.

    The texts are cut into terms once, and dealt evenly over the cores: the fit's passes and the scoring read the staged codes.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    terms = staged(term_model.coded(df, buckets).repartition(tasks), "text-terms")
    model = term_model.fit(terms.where(fit_on).select("label", "_terms"), buckets, max_iter)
    return term_model.score(model, terms)


def text_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    arr = vector_to_array(F.col("_text_prob"))
    return out.select(*df.columns, *[arr[i].alias(c) for i, c in enumerate(PROB_COLS)])


def out_of_fold_probabilities(df: DataFrame, folds: int = 5, id_col: str = "number", **settings) -> DataFrame:
    """Text probabilities of every row by a model that has not seen it (``folds`` fits, folds by hash of the id)."""
    part = F.pmod(F.xxhash64(*[F.col(c) for c in ("repo", id_col) if c in df.columns]), F.lit(folds))
    dealt = df.withColumn("_fold", part)
    parts = []
    for i in range(folds):
        model = text_pipeline(**settings).fit(dealt.where(F.col("_fold") != i).select("text", "label"))
        parts.append(text_probabilities(model, dealt.where(F.col("_fold") == i)).drop("_fold"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ stacking
def stacking_features(train: DataFrame, scored: DataFrame) -> DataFrame:
    """3 class probabilities + 10 numeric features scaled with statistics of the training part."""
    stats = fit_scaler(train, C.NUMERIC_FEATURES)
    return apply_scaler(scored, stats, suffix="_scaled")


def _unit_hash(*parts: Column) -> Column:
    """Uniform double in [0, 1) from md5 of the parts (deterministic, no rand())."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def smote_balance(train: DataFrame, feature_cols: list[str], label: str = "label", id_col: str = "number", k: int = C.SMOTE_K,
                  seed: int = C.RANDOM_STATE, **search) -> DataFrame:
    """Raise every class to the majority count with synthetic rows between a row and one of its ``k`` nearest neighbours.

    Neighbours are those of ``neighbours.nearest`` (settings: ``search``) among the distinct points of the row's class; a row's
    own copies, at distance 0, come first.  Which neighbour and how far towards it (a gap in [0, 1)) go by md5 of the row's
    place in its class.  An issue is (repo, number) where the table has a repository.  A class of one row repeats it.
    """
    ids = [c for c in ("repo", id_col) if c in train.columns]
    base = staged(train.select(*ids, label, *feature_cols, node_of(label, feature_cols).alias("_node")), "smote-rows")
    near = nearest(base, feature_cols, label, k=k, **search)
    near = staged(near.select(F.col("node").alias("_node"), "copies", "near", "vec"), "smote-neighbours")
    # Rows are dealt in a fixed order, by point and id; the count per class is skew-safe.
    order = [F.col("_node"), *[F.col(c) for c in ids]]
    ranked = running_count(base, [label], order, "_pos")
    sizes = base.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    majority = F.max("_n").over(Window.partitionBy())  # over the (number of classes)-row table only
    sizes = sizes.withColumn("_need", majority - F.col("_n")).withColumnRenamed(label, "_class")
    # Base row at rank i makes the synthetic rows j = i, i + n, i + 2n, ... < need.
    reps = F.when(F.col("_need") > F.col("_pos"),
                  F.floor((F.col("_need") - F.col("_pos") - 1) / F.col("_n")) + 1).otherwise(F.lit(0))
    gen = ranked.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_class"))).where(reps > 0).select(
        "*", F.explode(F.sequence(F.lit(0), (reps - 1).cast("int"))).alias("_r"))
    j = F.col("_pos") + F.col("_r") * F.col("_n")
    name = F.coalesce(F.col(label).cast("string"), F.lit(""))
    gen = gen.withColumn("_pick", _unit_hash(F.lit(seed), name, j, F.lit("pick"))).withColumn(
        "_gap", _unit_hash(F.lit(seed), name, j, F.lit("gap")))
    own = F.array_repeat("_node", F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    others = F.coalesce(F.transform("near", lambda x: x["other"]), F.array().cast("array<bigint>"))
    choice = F.slice(F.concat(own, others), 1, k)
    choice = F.when(F.size(choice) == 0, F.array("_node")).otherwise(choice)
    gen = gen.join(near.select("_node", choice.alias("_choice")), "_node")
    gen = gen.withColumn("_nbr", F.get("_choice", F.floor(F.col("_pick") * F.size("_choice")).cast("int")))
    who = F.struct(*ids)
    ends = base.groupBy(F.col("_node").alias("_nbr")).agg(F.min(who).alias("_lo"), F.max(who).alias("_hi"))
    ends = ends.join(near.select(F.col("_node").alias("_nbr"), F.col("vec").alias("_vec")), "_nbr")
    syn = gen.join(ends, "_nbr")
    # Among a row's own copies the neighbour is another row where there is one.
    other = F.when(F.col("_lo") == who, F.col("_hi")).otherwise(F.col("_lo"))
    types = train.schema
    names = [("source_id", "neighbour_id") if c == id_col else (f"source_{c}", f"neighbour_{c}") for c in ids]
    synthetic = syn.select(
        *[F.lit(None).cast(types[c].dataType).alias(c) for c in ids], label,
        *[(F.col(c) + F.col("_gap") * (F.col("_vec")[i] - F.col(c))).alias(c) for i, c in enumerate(feature_cols)],
        F.lit(True).alias("synthetic"),
        *[x for c, (s, n) in zip(ids, names) for x in (F.col(c).alias(s), other[c].alias(n))],
        F.col("_gap").alias("gap"),
    )
    originals = base.select(
        *ids, label, *[F.col(c).cast("double").alias(c) for c in feature_cols], F.lit(False).alias("synthetic"),
        *[x for c, (s, n) in zip(ids, names) for x in (F.col(c).alias(s), F.lit(None).cast(types[c].dataType).alias(n))],
        F.lit(None).cast("double").alias("gap"))
    return originals.unionByName(synthetic)


# ------------------------------------------------------------------ boosted trees
def fit_stacked(balanced: DataFrame, validation: DataFrame | None, feature_cols: list[str], label: str = "label",
                settings: boosting.Settings | None = None, resume: boosting.Model | None = None) -> boosting.Model:
    """Joint boosting on the balanced rows; the rows of ``validation`` steer the early stop."""
    rows = balanced.select(*feature_cols, label, F.lit(False).alias("_held"))
    if validation is not None:
        rows = rows.unionByName(validation.select(*feature_cols, label, F.lit(True).alias("_held")))
    return boosting.fit(rows, feature_cols, label, held="_held", settings=settings, resume=resume)


def predict_stacked(model: boosting.Model, df: DataFrame, feature_cols: list[str] | None = None) -> DataFrame:
    """Every row with the three probabilities, the likeliest class and its name."""
    out = boosting.predict(model, df, feature_cols)
    pred = (F.when((F.col("p_simple") >= F.col("p_moderate")) & (F.col("p_simple") >= F.col("p_complex")), 0)
            .when(F.col("p_moderate") >= F.col("p_complex"), 1).otherwise(2))
    return out.withColumn("prediction", pred).withColumn("complexity", class_name_map(F.col("prediction")))


# ------------------------------------------------------------------ evaluation
def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_metrics(conf: DataFrame) -> DataFrame:
    """precision, recall, f1, support per class (zero division -> 0), from the confusion table.

    One aggregation pass: each confusion cell counts once towards its true
    class (support, true positives) and once towards its predicted class.
    """
    roles = F.explode(F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("support"),
                 F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted")),
    ))
    m = conf.select(roles.alias("r")).groupBy(F.col("r.cls").alias("cls")).agg(
        F.sum("r.tp").cast("bigint").alias("tp"), F.sum("r.support").cast("bigint").alias("support"),
        F.sum("r.predicted").cast("bigint").alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    m = m.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return m.withColumn("f1", f1).select("cls", "tp", "precision", "recall", "f1", "support")


def weighted_metrics(conf: DataFrame) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 in one aggregate over the per-class table."""
    pc = per_class_metrics(conf)
    n = F.sum("support")
    return pc.agg(
        (F.sum("tp") / n).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ["precision", "recall", "f1"]],
        n.cast("bigint").alias("n"),
    )


def class_id(name: Column) -> Column:
    return F.when(name == "simple", 0).when(name == "moderate", 1).when(name == "complex", 2)
