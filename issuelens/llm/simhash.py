"""SimHash near-duplicate detection with a Gray-order hierarchical index.

``fingerprints``  64-bit SimHash of every whole text.
``near_duplicates``  class of every document under "fingerprints differ in at most ``radius`` bits".

Distinct fingerprints are routed to buckets by the pigeonhole rule (``radius`` + 1 blocks of bits: two
fingerprints within the radius agree on one block at least), so no task ever sees all of them.  A bucket
with more than ``split_above`` fingerprints is routed again by blocks of its remaining bits, level by level, without
losing a pair.  Inside a task each bucket is sorted by Gray rank and indexed bottom-up: a node keeps the
bits that all its children share (their masked pattern), children keep the rest.  A search adds up the
differences on its way down and drops a whole group when the sum exceeds the radius.  Pairs never leave
the task: each bucket emits a spanning forest (at most one edge per fingerprint), and the classes are the
connected components of all forests.

Edge cases: null or wordless texts have fingerprint 0 and link like any other; rows with equal ids are
kept as they are; a row with a null id is a document like any other, which links and is linked through; its
component is the smallest id of its class (null if the class has none); an empty table gives no rows; columns other than
id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import components, hook, stage, text_bytes

SEED = 42
BITS = 64
FAN = 8


def simhash(data: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text (UTF-8): a bit is set if it is set in over half of the shingle hashes."""
    words = data.lower().split()  # bytes: lower() maps A-Z only, split() cuts at ASCII white space
    if not words:
        return 0
    return int(vote(shingle_hashes(words, shingle)))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())],
        dtype=np.uint64,
    )


def vote(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 18):  # bounded unpacking for very long texts
        part = hashes[i : i + (1 << 18)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp): one per row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in text_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


class GrayIndex:
    """Hierarchical index over codes in (group, Gray rank) order; groups are searched separately."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.codes = codes
        first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1)) if len(group) else np.zeros(0, np.int64)
        self.group_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
        value, mask = codes.copy(), np.full(len(codes), ~np.uint64(0))
        last = np.arange(len(codes))
        owner = self.group_of
        self.levels = []  # from the leaves up: value, bits left to compare, children [start, end), last leaf
        start = end = None
        while True:
            sizes = np.bincount(owner, minlength=len(first))
            if not len(codes) or sizes.max() <= 1:
                self.levels.append((value, mask, start, end, last))
                return
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            heads = np.flatnonzero((rank % FAN) == 0)
            parent = np.cumsum((rank % FAN) == 0) - 1
            shared = ~(np.bitwise_or.reduceat(value, heads) ^ np.bitwise_and.reduceat(value, heads))
            shared &= np.bitwise_and.reduceat(mask, heads)
            up_value = np.bitwise_and.reduceat(value, heads) & shared
            rest = mask & ~shared[parent]
            self.levels.append((value & rest, rest, start, end, last))
            start, end = heads, np.append(heads[1:], len(owner))
            value, mask, last, owner = up_value, shared, last[end - 1], owner[heads]

    def pairs(self, radius: int, budget: int = 1 << 18):
        """Blocks of leaf pairs (i < j) of one group that differ in at most ``radius`` bits."""
        n = len(self.codes)
        work = np.cumsum(np.bincount(self.group_of)[self.group_of]) if n else np.zeros(0, np.int64)
        at = 0
        while at < n:
            base = work[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(work, base + budget, side="right")))
            query = np.arange(at, to)
            node, diff = self.group_of[query], np.zeros(to - at, np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                value, mask, start, end, last = self.levels[level]
                diff = diff + np.bitwise_count((self.codes[query] & mask[node]) ^ value[node])
                keep = (diff <= radius) & (last[node] > query)
                query, node, diff = query[keep], node[keep], diff[keep]
                if level:
                    count = (end - start)[node]
                    first = np.repeat(start[node], count)
                    step = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
                    query, diff, node = np.repeat(query, count), np.repeat(diff, count), first + step
            yield query, node
            at = to


def forest(key: np.ndarray, codes: np.ndarray, reps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, rep of the class's first leaf) of a spanning forest inside every bucket."""
    order = np.lexsort((gray_rank(codes), key))
    codes, reps = codes[order], reps[order]
    labels = np.arange(len(codes))
    for a, b in GrayIndex(key[order], codes).pairs(radius):
        labels = hook(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return reps[moved], reps[labels[moved]]


def _cut(rest: Column, left: int, step: int, i: int) -> tuple[Column, Column]:
    """Block ``i`` of ``step`` bits of the ``left`` low bits of ``rest``, and the other bits closed up."""
    at = step * i
    if step == BITS:
        return rest, F.lit(0).cast("long")
    block = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << step) - 1))
    low = rest.bitwiseAND(F.lit((1 << at) - 1))
    if at + step >= left:
        return block, low
    return block, F.shiftleft(F.shiftrightunsigned(rest, at + step), at).bitwiseOR(low)


def _routed(rows: DataFrame, left: int, blocks: int) -> DataFrame:
    """Every row once per block of its bits left: rows (fp, rep, bucket, rest)."""
    step = left // blocks
    ways = []
    for i in range(blocks):
        block, rest = _cut(F.col("rest"), left, step, i)
        ways.append(F.struct(F.xxhash64("bucket", F.lit(left), F.lit(i), block).alias("bucket"), rest.alias("rest")))
    return rows.select("fp", "rep", F.explode(F.array(*ways)).alias("way")).select("fp", "rep", "way.bucket", "way.rest")


def buckets(fps: DataFrame, radius: int = 3, split_above: int = 20_000) -> DataFrame:
    """Rows (bucket, fp, rep): two fingerprints within the radius share a bucket, and no bucket outgrows ``split_above`` for long.

    Members of a bucket agree on the bits that brought them there, so they differ in the bits left only and the
    pigeonhole rule holds for these again.  A bucket above ``split_above`` is cut by it until it is small or the bits left
    cannot tell more than ``split_above`` fingerprints apart, so every bucket is bounded without comparing blocks in pairs.
    """
    blocks = radius + 1
    left = BITS
    level = _routed(fps.select("fp", "rep", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("bucket")), left, blocks)
    done = []
    while True:
        left -= left // blocks
        if left < blocks or 1 << left <= split_above:
            done.append(level)
            break
        crowded = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_above)
        hot = stage(crowded.select("bucket"), "simhash-hot")
        if hot.isEmpty():
            done.append(level)
            break
        done.append(level.join(hot, "bucket", "left_anti").select("fp", "rep", "bucket", "rest"))
        level = stage(_routed(level.join(hot, "bucket", "left_semi"), left, blocks), "simhash-level")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.select("bucket", "fp", "rep")


def links(fps: DataFrame, radius: int = 3, split_above: int = 20_000, cut: int = 200_000) -> DataFrame:
    """Forest edges (a, b) between the ``rep`` of distinct fingerprints; input rows (fp, rep)."""
    keyed = buckets(fps, radius, split_above)

    def run(batches):
        kept = []
        size = 0

        def out(key, codes, reps):
            a, b = forest(key, codes, reps, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:  # sorted by bucket: whole buckets are taken as soon as enough rows are there
            kept.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= cut:
                key, fp, rep = (np.concatenate(c) for c in zip(*kept))
                edge = int(np.searchsorted(key, key[-1]))
                if edge:
                    yield out(key[:edge], fp[:edge].view(np.uint64), rep[:edge])
                kept, size = [[key[edge:], fp[edge:], rep[edge:]]], len(key) - edge
        if size:
            key, fp, rep = (np.concatenate(c) for c in zip(*kept))
            yield out(key, fp.view(np.uint64), rep)

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3
) -> DataFrame:
    """Rows (id, fp, component): every row of ``docs`` with the smallest id it is linked to, itself included."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    # An id that occurs twice with different texts joins their classes, as one document would.
    twice = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    same = fps.join(twice.select("id", "x"), "id").select(F.col("fp").alias("a"), F.col("x").alias("b"))
    # Fingerprints are the nodes, so rows without an id link, and are linked through, like any other.
    classes = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius).unionByName(same), "simhash")
    linked = distinct.join(classes, distinct.fp == classes.node).select("fp", "id", F.col("component").alias("class"))
    smallest = linked.groupBy("class").agg(F.min("id").alias("component"))
    linked = linked.join(smallest, "class").select("fp", F.col("component").alias("id"))
    owner = distinct.join(classes, distinct.fp == classes.node, "left_anti").select("fp", "id").unionByName(linked)
    return fps.join(owner.withColumnRenamed("id", "component"), "fp", "left").select("id", "fp", "component")
