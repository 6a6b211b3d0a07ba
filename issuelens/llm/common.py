"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.session import prepare, scratch_path

# The ASCII white space that separates words ([^\x20\x09-\x0D]+ is a word).
SPACES = " \t\n\x0b\x0c\r"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; several branches can
    then read the rows without computing them again.
    """
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_column(text: Column) -> Column:
    """Array of the words of a text (null: empty array), computed in the JVM."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " ", -1), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is the empty text."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def row_blocks(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``limit`` bytes (one row at least)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_codes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of every run of k words."""
    n = len(hashes) - k + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        code = (code ^ hashes[i : i + n]) * PRIME
        code ^= code >> np.uint64(31)
    return code


def signed(data: bytes) -> int:
    """XXH64 of the bytes as a signed long."""
    value = xxhash.xxh64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of each pair (a, b): every label becomes its class's smallest index."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up


def components(edges: DataFrame, name: str, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): rows (node, component), component = smallest node.

    Alternates large-star and small-star steps; each is an aggregate and a join on the node, so a
    node with very many neighbours is pre-aggregated and its rows may be split by a skewed join.
    Every round's edges are written to the shared folder.
    """
    e = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{name}-edges",
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), f"{name}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = small.unionByName(low.select("u", F.col("m").alias("v")))
        e = stage(pairs.distinct(), f"{name}-small")
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
    raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
