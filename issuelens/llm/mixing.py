"""Mixing sources to target weights by weighted sampling without replacement.

Each source has a target number of words.  Whole epochs of a source come first; the rest of its target is
a fractional epoch, chosen by exponential keys -ln(u) / w (u: uniform by a keyed hash of the id; w: quality
weight of the document).  Taken in key order, the documents of a source are a weighted sample without
replacement of any prefix length, so the prefix that fills the rest of the target is the selection; the
last document is in when at least half of it fits.

Prefix sums never put a source in one task: its keys are cut at approximate quantiles, and between them into as
many even slices as the table needs; words are added up per slice first, and only rows of one slice are ever
sorted together.  Where the cuts fall does not change the result.

Edge cases: a null text has size 0 and weight floor; null sources form a source of their own, last in
order; a null id counts as the empty text in the hash; repeated ids and ties are ordered by id, then size,
and rows equal in all of them are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import stage, word_count

#: Weights of the sources in order, repeating, and the share of all words to take.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SLICE_ROWS = 20_000
CUTS = 64
#: Characters that do not speak for running text.
MARKS = "0123456789#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """Between 0.05 and 1: the share of characters that are neither digits nor marks, in whole percent."""
    t = F.coalesce(text, F.lit(""))
    clean = F.floor(100 * F.length(F.translate(t, MARKS, "")) / F.greatest(F.length(t), F.lit(1)))
    return F.greatest(clean, F.lit(5)) / F.lit(100.0)


def uniform(id_col: Column, seed: str = "mix") -> Column:
    """Keyed hash of the id in (0, 1): 52 bits of MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_EPOCHS) -> DataFrame:
    """Target of each source from rows (source, source_size), one per source.

    A source stops at ``cap`` times its size; what it cannot take goes to the others by weight until none
    is above.  The level L with sum(min(cap * size, L * weight)) = total is found by sorting the sources by
    cap * size / weight: those below the level are full, and the first source that is not full fixes it (later candidates are lower).
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    full = Window.orderBy("room", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("weight", w.cast("long"))
        .withColumn("room", cap * F.col("source_size") / F.col("weight"))
        .withColumn("before_size", F.coalesce(F.sum("source_size").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        # The level if every source before this one is full and the others are not.
        .withColumn("level", (share * F.col("total") - cap * F.col("before_size")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") <= F.col("room"))
        .withColumn("final", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    )
    return ranked.select(
        "source",
        "source_size",
        F.least(cap * F.col("source_size"), F.coalesce("final", F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    seed: str = "mix",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rows (id, source, size, source_size, target, epochs, taken): one per document.

    ``epochs`` is the number of times the document enters the mix, ``taken`` its words times that.
    """
    w = quality_weight(F.col(text_col)) if weight is None else weight
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        (-F.log(uniform(F.col(id_col), seed)) / w).alias("key"),
    )
    rows = stage(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("key", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("cuts"),
    )
    totals = stage(totals, "mix-totals")
    plan = targets(totals.select("source", "source_size")).join(
        totals.select(F.col("source").alias("s"), "n", "cuts"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    plan = (
        plan.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("steps", F.ceil(F.col("n") / (CUTS * slice_rows)))
        .withColumnRenamed("source", "s")
    )
    part = F.greatest(F.size(F.filter("cuts", lambda c: c <= F.col("key"))), F.lit(1))
    low, high = F.element_at("cuts", F.col("part")), F.element_at("cuts", F.least(F.col("part") + 1, F.size("cuts")))
    along = F.when(high > low, F.least((F.col("key") - low) / (high - low), F.lit(1.0))).otherwise(0.0)
    sliced = (
        rows.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
        .withColumn("part", part)
        .withColumn("slice", F.col("part") * (F.col("steps") + 1) + F.floor(F.greatest(along, F.lit(0.0)) * F.col("steps")))
        .drop("cuts")
    )
    per_slice = sliced.groupBy("s", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        F.col("s").alias("cs"), F.col("slice").alias("cslice"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carry")
    )
    inside = (
        Window.partitionBy("s", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    out = sliced.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        carry, F.col("s").eqNullSafe(F.col("cs")) & (F.col("slice") == F.col("cslice")), "left"
    )
    extra = (F.col("carry") + F.col("ahead") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    return out.withColumn("epochs", F.col("whole") + F.when(extra, 1).otherwise(0)).select(
        "id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken")
    )


#: The same mix in DuckDB SQL over a table with doc_id, text and source.
MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE)
         / (greatest(floor(100 * length(translate(coalesce(text, ''), '0123456789#*$%&|<>!', ''))::DOUBLE
            / greatest(length(coalesce(text, '')), 1)), 5) / 100.0::DOUBLE) AS key
  FROM {docs}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM totals),
roomy AS (SELECT *, 2.0::DOUBLE * source_size / weight AS room FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM roomy WINDOW f AS (ORDER BY room, source IS NULL, encode(source))),
planned AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN level <= room THEN level END) OVER (), 'inf'::DOUBLE) * weight) AS target
  FROM levels),
parts AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole,
         target - floor(target / greatest(source_size, 1)) * source_size AS rest
  FROM planned),
ordered AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
chosen AS (
  SELECT *, CAST(whole + CASE WHEN rest > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs
  FROM ordered)
"""
