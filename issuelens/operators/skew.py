"""Skew-safe building blocks.

Any key (a user, a repo, a class, an issue) may hold a third of all rows, so
per-key work is never done by one task:

* ``best_per_key`` - top-1 row per key as an aggregate (``min_by`` over a
  total order), so map-side partial aggregation collapses a hot key before
  the shuffle.
* ``prefix_aggregate`` - running sums / maxima per key in a given order.
  Rows are range-partitioned on (key, order), which cuts a hot key into
  many order-preserving slices; each (key, slice) is aggregated locally and
  a carry from the earlier slices of the same key is added.  The carry table
  has at most ``slices - 1`` rows (each slice boundary lies inside at most one
  key), so broadcasting it is bounded by construction, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.session import cut_lineage


def num_slices(df: DataFrame, slices: int | None = None) -> int:
    if slices:
        return slices
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _agg(kind: str, c: Column) -> Column:
    if kind == "sum":
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    raise ValueError(kind)


def prefix_aggregate(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    aggs: list[tuple[str, str, Column]],
    slices: int | None = None,
    stage_input: bool = False,
) -> DataFrame:
    """Inclusive running aggregates per key in ``order``.

    ``aggs`` holds ``(out_name, kind, expr)`` with kind ``sum`` or ``max``.
    ``order`` must be a total order within a key (add a unique tie-breaker).
    ``stage_input`` first writes the (narrow) input to the shared folder:
    range partitioning samples its input in a job of its own, so an
    expensive input would otherwise be computed twice.
    """
    if stage_input:
        df = cut_lineage(df)
    n = num_slices(df, slices)
    sliced = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn(
        "_slice", F.spark_partition_id()
    )
    # Fix the slice of every row once: both branches below must see the same
    # slices, also when a lost executor forces a recomputation.
    sliced = cut_lineage(sliced)

    w_local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.select("*", *[_agg(kind, e).over(w_local).alias(f"_loc_{name}") for name, kind, e in aggs])

    totals = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_tot__n"), *[_agg(kind, e).alias(f"_tot_{name}") for name, kind, e in aggs])
    w_carry = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_slice", F.sum("_tot__n").over(w_carry).alias("_car__n"),
        *[_agg(kind, F.col(f"_tot_{name}")).over(w_carry).alias(f"_car_{name}") for name, kind, _ in aggs]
    ).where(F.col("_car__n").isNotNull()).drop("_car__n")  # only slices preceded by the same key
    # At most (slices - 1) rows by construction -> safe to broadcast.
    # Null-safe on the key: rows with a null key are one group and keep their carry.
    renamed = carry.withColumnsRenamed({k: f"_key_{k}" for k in keys} | {"_slice": "_key_slice"})
    same = F.col("_slice") == F.col("_key_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = local.join(F.broadcast(renamed), on=same, how="left").drop("_key_slice", *[f"_key_{k}" for k in keys])
    for name, kind, _ in aggs:
        loc, car = F.col(f"_loc_{name}"), F.col(f"_car_{name}")
        if kind == "sum":
            val = loc + F.coalesce(car, F.lit(0))
        else:
            val = F.greatest(loc, car)
        out = out.withColumn(name, val)
    return out.drop("_slice", *[f"_loc_{n_}" for n_, _, _ in aggs], *[f"_car_{n_}" for n_, _, _ in aggs])


def running_count(df: DataFrame, keys: list[str], order: list[Column], out: str, slices: int | None = None
                  ) -> DataFrame:
    """0-based position of each row within its key (pandas ``cumcount``)."""
    res = prefix_aggregate(df, keys, order, [(out, "sum", F.lit(1).cast("bigint"))], slices)
    return res.withColumn(out, F.col(out) - 1)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """First row per key under ``order`` (ascending), as an aggregate.

    ``order`` should be a total order (end with unique columns) so the result
    is deterministic.  Null-safe: wrap nullable order terms with
    ``nulls_last``/``nulls_first`` helpers before passing them.
    """
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.struct(*[F.col(c) for c in payload])
    agg = df.groupBy(*keys).agg(F.min_by(row, ordering).alias("_best"))
    return agg.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload if c not in keys])


def asc_nulls_last(c: Column) -> list[Column]:
    """Two ordering terms: non-null first, then the value ascending."""
    return [c.isNull().cast("int"), c]


def desc_nulls_last_num(c: Column) -> list[Column]:
    """Numeric value descending, nulls last."""
    return [c.isNull().cast("int"), -c]
