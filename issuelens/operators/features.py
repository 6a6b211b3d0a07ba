"""Feature operators: text features, user history, labels, dedup, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions import text as T
from issuelens.functions.score import complexity_label
from issuelens.operators.skew import best_per_key, running_count


def numeric_text_features(df: DataFrame, title="title", body="body", labels="labels") -> DataFrame:
    """len_title, len_body, word_count, has_code, has_image, has_url, labels_count, reactions.

    Training-path semantics: null title/body become "" (no stripping);
    patterns are searched in the body; labels_count is the real list size.
    Columns ``labels_count`` and ``reactions`` that the table already has are
    used as they are (null: 0), as in the reference's training data.
    """
    t = F.coalesce(F.col(title), F.lit(""))
    b = F.coalesce(F.col(body), F.lit(""))
    given = {c: F.coalesce(T.whole_number(F.col(c)), F.lit(0).cast("bigint"))
             for c in ("labels_count", "reactions") if c in df.columns}
    lab = T.label_array(F.col(labels), df.schema[labels].dataType) if labels in df.columns \
        else F.lit(None).cast("array<string>")
    return df.select(
        *[c for c in df.columns if c not in given],
        F.length(t).cast("bigint").alias("len_title"),
        F.length(b).cast("bigint").alias("len_body"),
        T.py_word_count(b).alias("word_count"),
        T.has_code(b).alias("has_code"),
        T.has_image(b).alias("has_image"),
        T.has_url(b).alias("has_url"),
        given.get("labels_count", F.coalesce(F.size(lab), F.lit(0)).cast("bigint")).alias("labels_count"),
        given.get("reactions", F.lit(0).cast("bigint")).alias("reactions"),
    )


def user_history(df: DataFrame, user="author", created="created_at", tie="number") -> DataFrame:
    """Prior-issue count per user in creation order and the new-user flag.

    Running count via range-sliced prefix sums, so one very active user is
    spread over many tasks.  Without a user column: count 0, flag 1.  Rows
    with a null user are one unknown user.  Issue numbers repeat between
    repositories, so ties in time go by repository, then number.
    """
    if user not in df.columns:
        return df.withColumn("user_issue_count", F.lit(0).cast("bigint")).withColumn("is_new_user", F.lit(1))
    order = [F.col(c) for c in (created, "repo", tie) if c in df.columns]
    out = running_count(df, [user], order, "user_issue_count")
    return out.withColumn("is_new_user", (F.col("user_issue_count") == 0).cast("int"))


def with_label(df: DataFrame, comments="comments") -> DataFrame:
    return df.withColumn("label", complexity_label(F.col(comments)))


def training_text(title="title", body="body") -> Column:
    """title + " " + body with nulls as ""."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit("")))


def content_key(*cols: str) -> list[Column]:
    """Fixed-width exact-equality keys for wide text columns (null stays null)."""
    return [F.unhex(F.sha2(F.col(c), 256)).alias(f"_k_{c}") for c in cols]


def dedup_keep_last(df: DataFrame, ordinal: str, key_cols: list[str] | None = None,
                    payload: list[str] | None = None, keyed: bool = False) -> DataFrame:
    """``drop_duplicates(subset, keep='last')``: by ``id`` if present else (title, body).

    The last row in ingest order (``ordinal``) survives; null keys group
    together.  Done as an aggregate over fixed-width content hashes so a hot
    key is collapsed map-side and wide bodies are never shuffle keys.
    ``payload`` names the columns the caller needs (default: all): only these,
    the hashes and the ordinal are sorted and shuffled.  ``keyed``: the key
    columns are digests already and stay.  Issue numbers repeat between
    repositories: ties go by repository, creation time, then the row's hash.
    """
    if key_cols is None:
        key_cols = ["id"] if "id" in df.columns else ["title", "body"]
    payload = payload or df.columns
    tie = [F.col(c) for c in ("repo", "created_at") if c in df.columns and c != ordinal] + [F.xxhash64(*payload)]
    hashes = [] if keyed else content_key(*key_cols)
    rows = df.select(*dict.fromkeys([*payload, *(key_cols if keyed else []), ordinal]), *hashes,
                     *[t.alias(f"_o{i}") for i, t in enumerate(tie)])
    keys = key_cols if keyed else [f"_k_{c}" for c in key_cols]
    best = best_per_key(rows, keys, [-F.col(ordinal), *[F.col(f"_o{i}") for i in range(len(tie))]], payload)
    return best if keyed else best.drop(*keys)


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Per-column mean and population std (zero std -> scale 1).

    One partial/final aggregate; only the 2 x len(cols) numbers reach the driver.
    """
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    stats = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        m = 0.0 if m is None else float(m)
        s = 1.0 if (s is None or s == 0.0) else float(s)
        stats[c] = (m, s)
    return stats


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    out = df
    for c, (m, s) in stats.items():
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return out


def feature_frame(iss: DataFrame) -> DataFrame:
    """The ten numeric features of the stacked model for an issues table."""
    f = numeric_text_features(iss)
    # Drop the wide text before the history step shuffles and checkpoints rows.
    f = f.drop(*[c for c in ("title", "body", "text") if c in f.columns])
    return user_history(f)

