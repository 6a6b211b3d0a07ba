"""The term model over staged codes: words and bigrams hashed once, then a multinomial logistic regression over them.

The same model as ``learn.text_pipeline`` (words by ``(?U)\\W+``, bigrams, Murmur3 buckets, IDF, standardised features, L2,
L-BFGS with the same history, line search and stopping rules), for tables whose every pass counts.  A text is cut and hashed
in Arrow batches by array operations over its bytes, and kept as one bucket number of two bytes per term.  The fit turns them into
blocks of two bytes a term, held in memory or on disk; a pass works on one block at a time, whatever the size of the table, and
sends back one gradient a task (of more than ``DIRECT_TASKS`` tasks, merged in a tree).

Edge cases: lower case goes by the Unicode rules (Java ends some words in a capital sigma otherwise), and a letter by Python's
version of Unicode; a null text is an empty one; a text without a word has the probabilities of the intercepts; null labels and
labels that are no class are refused; where all rows have one class, that class is certain.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens import config as C

SEED = 42
CUT_CHARS = 1 << 20  # characters cut at once
HASHED = 1 << 16  # terms hashed at once
SUMMED = 1 << 17  # terms summed at once
BLOCK_TERMS = 1 << 22
BLOCK_ROWS = 1 << 16  # a row's number takes two bytes
DIRECT_TASKS = 32  # sums of more tasks are merged in a tree
HISTORY = 10
SEARCHES = 10
REGULAR = 0.01
TOLERANCE = 1e-6


# ------------------------------------------------------------------ terms
@cache
def word_characters() -> np.ndarray:
    """Whether a code point is of a word as in ``(?U)\\w``: alphabetic, mark, decimal digit, connector or join control."""
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc"}
    out = np.fromiter((unicodedata.category(chr(i)) in kinds for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    for a, b in ((0x200C, 0x200D), (0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)):
        out[a : b + 1] = True
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words in lower case, one space between those of a text; where each starts and ends; words per text."""
    joined = "\0".join(texts)
    if joined.count("\0") >= len(texts):
        joined = "\0".join(t.replace("\0", " ") for t in texts)
    joined = joined.lower()
    plain = joined.isascii()
    given = np.frombuffer(joined.encode() if plain else joined.encode("utf-32-le"), np.uint8 if plain else np.uint32)
    word = word_characters()[given]
    kept = word | (given == 0)
    kept[1:] |= word[:-1]
    data = np.where(word | (given == 0), given, given.dtype.type(32))[kept]
    if not plain:
        data = np.frombuffer(data.tobytes().decode("utf-32-le").encode(), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data > 32
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    counts = np.diff(np.searchsorted(starts, np.flatnonzero(data == 0)), prepend=0, append=len(starts))
    return data, starts, ends, counts


def murmur(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Murmur3 (32 bits, seed 42) of spans of bytes."""
    data = np.concatenate((data, np.zeros(4, np.uint8)))
    four = np.ndarray(len(data) - 3, "<u4", data, 0, (1,)).copy()  # the four bytes from every place
    out = np.empty(len(starts), np.uint32)
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)

    def mixed(k):
        k *= c1
        k = (k << np.uint32(15)) | (k >> np.uint32(17))
        k *= c2
        return k

    for a in range(0, len(starts), HASHED):
        size = sizes[a : a + HASHED]
        order = np.argsort((size >> 2).astype(np.uint16) if size.max() < 1 << 18 else size >> 2, kind="stable")
        at, size = starts[a : a + HASHED][order], size[order]
        blocks = size >> 2
        h = np.full(len(at), SEED, np.uint32)
        for j, first in enumerate(np.searchsorted(blocks, np.arange(int(blocks[-1])), "right").tolist()):
            part = h[first:]
            part ^= mixed(four[at[first:] + 4 * j])
            part[:] = (part << np.uint32(13)) | (part >> np.uint32(19))
            part *= np.uint32(5)
            part += np.uint32(0xE6546B64)
        left = size & 3
        h ^= mixed(four[at + 4 * blocks] & np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[left])
        h ^= size.astype(np.uint32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        out[a : a + HASHED][order] = h
    return out


def _codes(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text's words and bigrams, text after text, and their number per text."""
    data, starts, ends, words = _words(texts)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), words
    # Beside each word the bigram that it begins; the last word of a text begins none.
    both = np.ones((n, 2), bool)
    both[np.cumsum(words)[words > 0] - 1, 1] = False
    upto = np.stack((ends, np.append(ends[1:], ends[-1])), axis=1)[both]
    from_ = np.repeat(starts, both.sum(axis=1))
    hashed = murmur(data, from_, upto - from_).view(np.int32)
    return hashed.astype(np.int64) % buckets, np.maximum(2 * words - 1, 0)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def coded(df: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """The rows without their text, with ``_terms``: the buckets of all terms of the text."""
    rest = [c for c in df.columns if c != text]
    kind = _kind(buckets)
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.struct(*rest).alias("_row"))

    def run(batches):
        for b in batches:
            texts, out = b.column(0).to_pylist(), []
            a = 0
            while a < len(texts):
                some, size = a, 0
                while some < len(texts) and (some == a or size + len(texts[some]) <= CUT_CHARS):
                    size += len(texts[some])
                    some += 1
                codes, counts = _codes(texts[a:some], buckets)
                ends = (np.cumsum(counts) * np.dtype(kind).itemsize).tolist()
                data = codes.astype(kind).tobytes()
                out += [data[x:y] for x, y in zip([0, *ends], ends)]
                a = some
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["_row", "_terms"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("_terms", "binary")).select("_row.*", "_terms")


def _pieces(column: pa.Array, kind: type) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, their terms one after the other, terms per row) of a column of ``coded``, some ``SUMMED`` terms at once."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], kind) if column.buffers()[2] is not None else np.zeros(0, kind)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SUMMED, "right")) - 1)
        yield slice(a, b), data[offsets[a] : offsets[b]].astype(np.intp), np.diff(offsets[a : b + 1])
        a = b


# ------------------------------------------------------------------ blocks
@dataclass
class Block:
    """Rows of a block and their terms, bucket after bucket: the row of each term, and the number of terms in each bucket.

    Sums over a bucket run along the terms, and what is looked up or added to is as small as the rows of a block.
    """

    label: np.ndarray
    row: np.ndarray
    counts: np.ndarray

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(buckets, the rows of their terms, terms per bucket) of the buckets in use, some ``SUMMED`` terms at once."""
        used = np.flatnonzero(self.counts)
        counts = self.counts[used].astype(np.int64)
        ends = np.cumsum(counts)
        a = 0
        while a < len(used):
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + SUMMED, "right")))
            yield used[a:b], self.row[before : int(ends[b - 1])].astype(np.intp), counts[a:b]
            a = b


def _blocks(rows: DataFrame, buckets: int, classes: int) -> RDD:
    """Blocks of rows (label, terms of ``coded``)."""
    kind = _kind(buckets)

    def packed(held):
        label = np.concatenate([y for y, _, _ in held])
        terms = np.concatenate([t for _, t, _ in held])
        sizes = np.concatenate([n for _, _, n in held])
        row = np.repeat(np.arange(len(label), dtype=np.uint16), sizes)[np.argsort(terms, kind="stable")]
        counts = np.bincount(terms, minlength=buckets).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (label, row, counts)], names=["label", "row", "counts"])

    def run(batches):
        held, many, size = [], 0, 0
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            if b.column(0).null_count or ((y < 0) | (y >= classes) | (y != np.rint(y))).any():
                raise ValueError(f"labels must be whole numbers from 0 to {classes - 1}")
            for at, terms, sizes in _pieces(b.column(1), kind):
                more = at.stop - at.start
                for a in range(0, more, BLOCK_ROWS):  # only where texts are nearly empty a piece has more rows
                    n = sizes[a : a + BLOCK_ROWS]
                    first = int(sizes[:a].sum())
                    part = terms[first : first + int(n.sum())]
                    if held and (many + len(n) > BLOCK_ROWS or size + len(part) > BLOCK_TERMS):
                        yield packed(held)
                        held, many, size = [], 0, 0
                    held.append((y[at][a : a + BLOCK_ROWS].astype(np.uint8), part.astype(kind), n))
                    many, size = many + len(n), size + len(part)
        if held:
            yield packed(held)

    found = rows.mapInArrow(run, "label binary, row binary, counts binary")
    return found.rdd.map(lambda r: Block(np.frombuffer(r[0], np.uint8), np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.uint32)))


# ------------------------------------------------------------------ sums over the blocks
def _merged(blocks: RDD, part: Callable[[Iterator[Block]], np.ndarray], size: int) -> np.ndarray:
    """The sum of the vectors of ``size`` that ``part`` makes of each task's blocks."""
    parts = blocks.mapPartitions(lambda held: [part(held)])
    if parts.getNumPartitions() > DIRECT_TASKS:
        return parts.treeReduce(lambda a, b: a + b, 2)
    return sum(parts.collect(), np.zeros(size))  # an empty table may have no task at all


def _counted(blocks: RDD, buckets: int, classes: int) -> np.ndarray:
    """Per bucket the rows that hold it, its terms and the squares of its counts in a row; then the rows of each class."""

    def part(held):
        sums, labels = np.zeros((3, buckets)), np.zeros(classes)
        for b in held:
            labels += np.bincount(b.label, minlength=classes)
            sums[1] += b.counts
            for used, row, counts in b.pieces():
                new = np.diff(row, prepend=-1) != 0  # a row's terms of one bucket are neighbours
                new[np.cumsum(counts) - counts] = True
                first = np.flatnonzero(new)
                at, times = np.repeat(np.arange(len(used)), counts)[first], np.diff(first, append=len(row)).astype(np.float64)
                sums[0, used] += np.bincount(at, minlength=len(used))
                sums[2, used] += np.bincount(at, times * times, len(used))
        return np.concatenate((sums.ravel(), labels))

    return _merged(blocks, part, 3 * buckets + classes)


def _loss(blocks: RDD, buckets: int, table: np.ndarray, offset: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss and its gradients by the weights (class, bucket) of a term and by the offsets (class)."""
    classes, apart = len(offset), table[:-1] - table[-1]

    def part(held):
        by_term, by_offset, loss = np.zeros((classes - 1, buckets)), np.zeros(classes), 0.0
        for b in held:
            n = len(b.label)
            z = np.zeros((classes, n))
            for used, row, counts in b.pieces():
                for k in range(classes - 1):
                    z[k] += np.bincount(row, np.repeat(apart[k, used], counts), n)
            z[:-1] += (offset[:-1] - offset[-1])[:, None]
            at, top = np.arange(n), z.max(axis=0)
            e = np.exp(z - top)
            whole = e.sum(axis=0)
            loss += float((np.log(whole) + top - z[b.label, at]).sum())
            e /= whole
            e[b.label, at] -= 1.0
            by_offset += e.sum(axis=1)
            # Two classes to a complex number: one look-up and one sum for both.
            twos = [e[k] + 1j * (e[k + 1] if k + 1 < classes - 1 else 0.0) for k in range(0, classes - 1, 2)]
            for used, row, counts in b.pieces():
                starts = np.cumsum(counts) - counts
                for i, two in enumerate(twos):
                    found = np.add.reduceat(two[row], starts)
                    by_term[2 * i, used] += found.real
                    if 2 * i + 1 < classes - 1:
                        by_term[2 * i + 1, used] += found.imag
        return np.concatenate((by_term.ravel(), by_offset, [loss]))

    sums = _merged(blocks, part, (classes - 1) * buckets + classes + 1)
    by_term = sums[: (classes - 1) * buckets].reshape(classes - 1, buckets)
    return float(sums[-1]), np.concatenate((by_term, -by_term.sum(axis=0)[None])), sums[-classes - 1 : -1]  # a row's gradients add up to 0


# ------------------------------------------------------------------ minimising
class SearchError(Exception):
    pass


def _strong_wolfe(phi: Callable[[float], tuple[float, float]], t: float) -> float:
    """A step that meets the strong Wolfe conditions: cubic steps between brackets."""
    c1, c2 = 1e-4, 0.9
    low = (0.0, *phi(0.0))
    value, slope = low[1:]
    if slope > 0:
        raise SearchError("no descent")

    def between(a, b):
        a, b = (a, b) if a[0] <= b[0] else (b, a)
        d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
        d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        wide = b[0] - a[0]
        at = b[0] - wide * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
        return at if np.isnan(at) else min(max(at, a[0] + 0.1 * wide), a[0] + 0.9 * wide)

    def zoom(low, high):
        for _ in range(SEARCHES):
            at = between(low, high)
            c = (at, *phi(at))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= c2 * abs(slope):
                    return c[0]
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchError("no step found")

    for i in range(SEARCHES):
        c = (t, *phi(t))
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchError("no step found")


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """L-BFGS: the last point and the values on the way.

    Ends after ``max_iter`` steps, when the value has moved by less than ``tolerance`` of the first in 20 steps, when the gradient
    is that small, or when a search fails twice.
    """
    last: dict = {}

    def at(x):
        if not len(last) or not np.array_equal(last["x"], x):
            last["x"], last["found"] = x.copy(), f(x)
        return last["found"]

    value, grad = at(x)
    values, steps, seen, failed = [value], [], [np.inf], False
    for_long = 20
    while True:
        moved = len(seen) >= 2 and abs(values[-1] - max(seen)) <= tolerance * abs(values[0])
        if len(values) > max_iter or moved or np.linalg.norm(grad) <= max(tolerance * values[-1], 1e-8):
            return x, values
        try:
            way = grad.copy()
            shares = []
            for s, d in steps:
                shares.append((s @ way) / (s @ d))
                way -= shares[-1] * d
            if steps:
                s, d = steps[0]
                if not s @ d >= 0:
                    raise SearchError("no curvature")
                way *= (s @ d) / (d @ d)
            for (s, d), share in zip(reversed(steps), reversed(shares)):
                way += (share - (d @ way) / (s @ d)) * s
            way = -way

            def phi(t, x=x, way=way):
                v, g = at(x + t * way)
                return v, g @ way

            step = _strong_wolfe(phi, 1.0 / np.linalg.norm(way) if len(values) == 1 else 1.0)
            if step * np.linalg.norm(grad) < 1e-10:
                raise SearchError("step too small")
        except SearchError:
            if failed:
                return x, values
            failed, steps = True, []
            continue
        failed, new = False, x + step * way
        value, then = at(new)
        steps = [(new - x, then - grad), *steps][:HISTORY]
        x, grad = new, then
        values.append(value)
        seen = [*seen, value][-for_long:]


# ------------------------------------------------------------------ the model
@dataclass
class TermModel:
    """Weights (class, bucket) of one term and offsets (class)."""

    weights: np.ndarray
    offset: np.ndarray
    losses: list[float]


def fit(rows: DataFrame, buckets: int, max_iter: int, classes: int | None = None) -> TermModel:
    """Fit on rows (label, terms of ``coded``)."""
    classes = classes or len(C.PROB_FEATURES)
    rows = rows.select(F.col(rows.columns[0]).cast("double"), rows.columns[1])
    blocks = _blocks(rows, buckets, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(blocks, buckets, max_iter, classes)
    finally:
        blocks.unpersist()


def _fitted(blocks: RDD, buckets: int, max_iter: int, classes: int) -> TermModel:
    counted = _counted(blocks, buckets, classes)
    (held, total, squares), labels = counted[: 3 * buckets].reshape(3, buckets), counted[3 * buckets :]
    n = labels.sum()
    if not n:
        raise ValueError("no row to fit the term model on")
    if (labels > 0).sum() == 1:
        return TermModel(np.zeros((classes, buckets)), np.where(labels > 0, 0.0, -np.inf), [])
    idf = np.log((n + 1) / (held + 1))
    spread = idf * np.sqrt(np.maximum(squares - total * total / n, 0.0) / max(n - 1, 1))
    scale = np.divide(idf, spread, out=np.zeros(buckets), where=spread > 0)  # of one term: weighted by IDF, in deviations
    mean = scale * total / n
    first = np.log1p(labels)
    start = np.concatenate((np.zeros((classes, buckets)), (first - first.mean())[:, None]), axis=1)

    def loss(x):
        x = x.reshape(classes, buckets + 1)
        w = x[:, :-1]
        value, by_term, by_offset = _loss(blocks, buckets, w * scale, x[:, -1] - w @ mean)
        grad = (by_term * scale - by_offset[:, None] * mean) / n + REGULAR * w
        return value / n + 0.5 * REGULAR * float((w * w).sum()), np.concatenate((grad, by_offset[:, None] / n), axis=1).ravel()

    x, losses = minimised(loss, start.ravel(), max_iter)
    x = x.reshape(classes, buckets + 1)
    return TermModel(x[:, :-1] * scale, x[:, -1] - x[:, :-1] @ mean, losses)


def _paired(table: np.ndarray) -> list[np.ndarray]:
    """Differences of each class's weights to the last class's, two classes to a complex table: one look-up for both."""
    apart = table[:-1] - table[-1]
    return [apart[i] + 1j * (apart[i + 1] if i + 1 < len(apart) else 0.0) for i in range(0, len(apart), 2)]


def _scores(paired: list[np.ndarray], offset: np.ndarray, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores (class, row) less the last class's."""
    out = np.zeros((len(offset), len(sizes)))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for i, table in enumerate(paired):
            found = np.add.reduceat(table[terms], starts)
            out[2 * i, some] = found.real
            if 2 * i + 1 < len(offset) - 1:
                out[2 * i + 1, some] = found.imag
    out[:-1] += (offset[:-1] - offset[-1])[:, None]
    return out


def score(model: TermModel, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``coded`` without its terms, with the class probabilities as ``columns``."""
    columns = columns or C.PROB_FEATURES
    kind, offset = _kind(model.weights.shape[1]), model.offset
    certain = not np.isfinite(offset).all()
    paired = _paired(model.weights)
    table = rows.select("_terms", F.struct(*[c for c in rows.columns if c != "_terms"]).alias("_row"))

    def run(batches):
        for b in batches:
            p = np.zeros((len(offset), b.num_rows))
            if certain:
                p[np.isfinite(offset)] = 1.0
            else:
                for at, terms, sizes in _pieces(b.column(0), kind):
                    z = _scores(paired, offset, terms, sizes)
                    e = np.exp(z - z.max(axis=0))
                    p[:, at] = e / e.sum(axis=0)
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(x) for x in p]], names=["_row", *(f"_p{k}" for k in range(len(p)))])

    schema = table.select("_row").schema
    for k in range(len(offset)):
        schema = schema.add(f"_p{k}", "double")
    return table.mapInArrow(run, schema).select("_row.*", *[F.col(f"_p{k}").alias(c) for k, c in enumerate(columns)])
