"""Periodic runs of words by online dyadic square catching.

A square is a stretch of words written twice in a row; a run is a maximal stretch of period q.  ``Catchers`` takes
words in the order they are appended.  For every level l it keeps a catcher over each completed block of L = 2^l
words that starts at a multiple of L, as long as a square of period p, 2L <= p < 4L, may still be waiting for its
second half: the half of such a square always holds one whole block.  An appended word completes one window of
L words a level; only the two blocks 2L to 4L before it can catch it.  A block that comes back at distance p opens a
comparison: how far do the words agree with those p before them, to the left and to the right?  If the agreement is
p words or more, a square has been caught, and all squares of one period that overlap by p words merge into a run.
Comparisons that reach the last appended word stay open and are advanced by the next append.  Periods of one word
are compared directly.  A block inside a known run of period q <= L, together with its copy, is passed over: by the
periodicity lemma such a square is part of that run.

Agreement is measured with prefix hashes modulo 2^61 - 1 in jumps of powers of two, so a word costs a logarithmic
number of steps however repetitive the text.  Every run reported is compared word by word afterwards; should a
hash have lied, the text is searched again with another base.  Words are numbered per task, not hashed.

Many short texts are appended at once, parted by words that occur nowhere else; a long text is appended in pieces
of ``PIECE`` words.  Memory is about 80 bytes a word of the texts in hand; nothing is shuffled.

Edge cases: null and wordless texts have no words and no runs; every row is judged alone, so null ids, equal ids and
repeated rows come back as they are; an empty table gives no rows; other columns pass through by the caller's choice
(``keep``, under their own names unless they clash with an output column, which the caller should rename first).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import row_blocks, text_bytes

MIN_LENGTH = 6
MIN_EXPONENT = 4
PIECE = 1 << 18
BLOCK_BYTES = 1 << 20
MOD = np.uint64((1 << 61) - 1)
LOW = np.uint64((1 << 32) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^61 - 1 for any 64-bit x."""
    x = (x & MOD) + (x >> np.uint64(61))
    return np.where(x >= MOD, x - MOD, x)


def mul_mod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for a, b below it."""
    a_hi, a_lo, b_hi, b_lo = a >> np.uint64(32), a & LOW, b >> np.uint64(32), b & LOW
    mid_1, mid_2 = _fold(a_hi * b_lo), _fold(a_lo * b_hi)
    mid = _fold(mid_1 + mid_2)
    # 2^64 = 8 and mid * 2^32: the upper 29 bits of mid wrap around.
    wrapped = (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _fold(_fold(_fold(a_lo * b_lo) + _fold(wrapped)) + _fold((a_hi * b_hi) << np.uint64(3)))


def sums_mod(x: np.ndarray, start: int) -> np.ndarray:
    """Running sums modulo 2^61 - 1 of at most 2^31 numbers, beginning at ``start``."""
    low, high = np.cumsum(x & LOW), np.cumsum(x >> np.uint64(32))
    high = _fold(high)
    wrapped = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
    return _fold(_fold(_fold(low) + _fold(wrapped)) + np.uint64(start))


class Catchers:
    """Runs of at least two periods in the words appended so far."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 40, 1 << 60))
        self.shift = np.uint64(rng.integers(1 << 40, 1 << 60))
        self.codes = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.power = np.ones(1, np.uint64)
        # Rows (start, end, period): the runs found so far, and agreements that end with the text and may become one.
        self.found = np.zeros((0, 3), np.int64)
        self.waiting = np.zeros((0, 3), np.int64)

    def append(self, codes: np.ndarray, reach: np.ndarray | None = None) -> None:
        """Append words.  ``reach`` (non-increasing, one per word): no period above it is sought at that word."""
        old, n = len(self.codes), len(self.codes) + len(codes)
        if old == n:
            return
        self.codes = np.concatenate((self.codes, codes))
        while len(self.power) <= n:
            k = len(self.power)
            self.power = np.concatenate((self.power, mul_mod(self.power, np.uint64(pow(self.base, k, int(MOD))))))[: max(n + 1, 64)]
        values = mul_mod(_fold(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.shift), self.power[old:n])
        self.sums = np.concatenate((self.sums, sums_mod(values, int(self.sums[-1]))))
        self._advance(old)
        self._single(old)
        level = 0
        while 4 << level <= n:
            limit = n if reach is None else int(np.searchsorted(-reach, -(2 << level), side="right"))
            if not limit:
                break
            self._catch(old, limit, 1 << level)
            level += 1
        self._merge(np.zeros((0, 3), np.int64))

    def _same(self, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        """Whether ``size`` words from x and from y > x agree."""
        a = self.sums[x + size] + (MOD - self.sums[x])
        b = self.sums[y + size] + (MOD - self.sums[y])
        return mul_mod(_fold(a), self.power[y - x]) == _fold(b)

    def _right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x on agree with those from y on."""
        n, total = len(self.codes), np.zeros(len(x), np.int64)
        size = 1  # gallop up, then down: short agreements cost few steps
        alive = np.arange(len(x))
        top = np.zeros(len(x), np.int64)
        while len(alive):
            alive = alive[y[alive] + total[alive] + size <= n]
            ok = self._same(x[alive] + total[alive], y[alive] + total[alive], size)
            alive = alive[ok]
            total[alive] += size
            top[alive] = size
            size *= 2
        while size > 1:
            size //= 2
            use = np.flatnonzero((size <= top) & (y + total + size <= n))
            use = use[self._same(x[use] + total[use], y[use] + total[use], size)]
            total[use] += size
        return total

    def _left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x agree with those before y."""
        total = np.zeros(len(x), np.int64)
        size = 1
        alive = np.arange(len(x))
        top = np.zeros(len(x), np.int64)
        while len(alive):
            alive = alive[x[alive] - total[alive] - size >= 0]
            ok = self._same(x[alive] - total[alive] - size, y[alive] - total[alive] - size, size)
            alive = alive[ok]
            total[alive] += size
            top[alive] = size
            size *= 2
        while size > 1:
            size //= 2
            use = np.flatnonzero((size <= top) & (x - total - size >= 0))
            use = use[self._same(x[use] - total[use] - size, y[use] - total[use] - size, size)]
            total[use] += size
        return total

    def _advance(self, old: int) -> None:
        """Runs and agreements that ended with the text go on as far as the new words agree."""
        open_ = np.flatnonzero(self.found[:, 1] == old)
        if len(open_):
            end = self.found[open_, 1]
            self.found[open_, 1] = end + self._right(end - self.found[open_, 2], end)
        rows, self.waiting = self.waiting, self.waiting[:0]
        if len(rows):
            rows[:, 1] += self._right(rows[:, 1] - rows[:, 2], rows[:, 1])
            self._report(rows)

    def _report(self, rows: np.ndarray) -> None:
        """Agreements (start, end, period): squares join the runs, those that may still become one wait."""
        square = rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2]
        self._merge(rows[square])
        wait = rows[~square & (rows[:, 1] == len(self.codes))]
        if len(wait):
            self.waiting = np.unique(np.concatenate((self.waiting, wait)), axis=0)

    def _single(self, old: int) -> None:
        """Runs of one repeated word among the new words (and the one before them)."""
        at = max(old - 1, 0)
        same = np.concatenate(([False], self.codes[at + 1 :] == self.codes[at:-1], [False]))
        starts, ends = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
        rows = np.stack((starts + at, ends + at + 1, np.ones(len(starts), np.int64)), 1)
        if len(rows) and old and rows[0, 0] == at:  # continues what an earlier append began
            before = self.found[(self.found[:, 2] == 1) & (self.found[:, 0] <= at) & (self.found[:, 1] > at)]
            if len(before):
                rows = rows[1:]
        self._merge(rows)

    def _catch(self, old: int, limit: int, size: int) -> None:
        """Windows of ``size`` words that end among the new words, against the blocks 2 and 3 sizes before."""
        codes = self.codes[:limit]
        first = max(old - size + 1, 0) // size * size  # the block row in which the first new window starts
        rows = -(-(len(codes) - first) // size)
        found = []
        for back in (2, 3):
            skip = max(0, back - first // size)
            if rows <= skip:
                continue
            here = codes[first + skip * size :]
            pad = (rows - skip) * size - len(here)
            table = np.concatenate((here, np.full(pad, -1))).reshape(-1, size)
            heads = codes[first + (skip - back) * size :][:: size][: len(table)]
            row, col = np.nonzero(table == heads[:, None])
            block = first + (row + skip - back) * size
            start = first + (row + skip) * size + col
            ok = (start + size <= len(codes)) & (start + size > old)
            block, start = block[ok], start[ok]
            if size > 1:
                ok = self.codes[block + size - 1] == self.codes[start + size - 1]
                block, start = block[ok], start[ok]
                ok = self._same(block, start, size)
                block, start = block[ok], start[ok]
            found.append((block, start))
        if not found or not sum(len(b) for b, _ in found):
            return
        block, start = (np.concatenate(x) for x in zip(*found))
        known = self.found[self.found[:, 2] <= size]
        if len(known):
            far = np.zeros(len(self.codes) + 1, np.int64)
            np.maximum.at(far, known[:, 0], known[:, 1])
            fresh = np.maximum.accumulate(far)[block] < start + size
            block, start = block[fresh], start[fresh]
        # Neighbouring blocks with one period belong to one comparison: the first of them stands for all.
        order = np.lexsort((block, start - block))
        block, start = block[order], start[order]
        lead = np.ones(len(block), bool)
        lead[1:] = (np.diff(start - block) != 0) | (np.diff(block) != size)
        block, start = block[lead], start[lead]
        period = start - block
        left, right = self._left(block, start), self._right(block, start)
        self._report(np.stack((block - left, start + right, period), 1))

    def _merge(self, rows: np.ndarray) -> None:
        """Add runs; of equal stretches the smallest period stays, of equal starts and periods the longest."""
        both = np.concatenate((self.found, rows))
        if not len(both):
            return
        both = both[np.lexsort((-both[:, 1], both[:, 2], both[:, 0]))]
        keep = np.ones(len(both), bool)
        keep[1:] = (np.diff(both[:, 0]) != 0) | (np.diff(both[:, 2]) != 0)
        both = both[keep]
        both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
        keep = np.ones(len(both), bool)
        keep[1:] = (np.diff(both[:, 0]) != 0) | (np.diff(both[:, 1]) != 0)
        self.found = both[keep]

    def runs(self, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
        """Rows (start, end, period) by start and period, of the length asked for."""
        size = self.found[:, 1] - self.found[:, 0]
        found = self.found[(size >= min_length) & (size >= min_exponent * self.found[:, 2])]
        return found[np.lexsort((found[:, 2], found[:, 0]))]

    def exact(self, rows: np.ndarray) -> bool:
        """Whether every run holds word by word and cannot be extended."""
        c, n = self.codes, len(self.codes)
        for s, e, q in rows.tolist():
            if not np.array_equal(c[s : e - q], c[s + q : e]) or (s and c[s - 1] == c[s + q - 1]) or (e < n and c[e] == c[e - q]):
                return False
        return True


def text_runs(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, piece: int = PIECE) -> list[np.ndarray]:
    """Runs (start, end, period) of every word list, each on its own word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    least = min_length if min_exponent < 2 else max(min_length, min_exponent)
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i] >= least]
    if not order:
        return out
    number: dict[bytes, int] = {}
    parts = []
    for k, i in enumerate(order):
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in texts[i]), np.int64, len(texts[i])))
    for k in range(len(order)):
        parts[k] = np.append(parts[k], len(number) + k)  # a word of its own parts the texts
    codes = np.concatenate(parts)
    length = sizes[order]
    reach = np.repeat(length // max(min_exponent, 2), length + 1)  # longest texts first: long periods are sought there only
    for seed in range(1, 100):
        state = Catchers(seed)
        for a in range(0, len(codes), piece):
            state.append(codes[a : a + piece], reach[: min(a + piece, len(codes))])
        rows = state.runs(min_length, min_exponent)
        if state.exact(rows):
            break
    first = np.cumsum(length + 1) - (length + 1)
    owner = np.searchsorted(first, rows[:, 0], side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(order) + 1))
    for k, i in enumerate(order):
        mine = rows[cuts[k] : cuts[k + 1]]
        if len(mine):
            out[i] = mine - np.array([first[k], first[k], 0])
    return out


def kept_words(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(rows):
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
    np.add.at(gone, rows[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def strongest(rows: np.ndarray) -> list[int] | None:
    """(start, length, period) of the run with the greatest exponent; ties: smallest start, then period."""
    best = None
    for s, e, q in rows.tolist():  # by start and period
        if best is None or (e - s) * best[2] > best[1] * q:
            best = [s, e - s, q]
    return best


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Every row as (id, n_words, runs, best, text) and the columns ``keep``.

    ``runs`` by start and period; ``best`` has the greatest exponent (null without a run); ``text`` holds the words that
    no run contains after its first period, joined by one space.
    """
    keep = keep or []
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias("id"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            raw = text_bytes(b.column(0))
            for a, z in row_blocks(raw, BLOCK_BYTES):
                words = [t.split() for t in raw[a:z]]
                found = text_runs(words, min_length, min_exponent)
                lists = [[{"start": s, "length": e - s, "period": q} for s, e, q in rows.tolist()] for rows in found]
                best = [dict(zip(("start", "length", "period"), x)) if (x := strongest(rows)) else None for rows in found]
                text = [b" ".join(kept_words(w, rows)) for w, rows in zip(words, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(a, z - a) for c in b.columns[1:]],
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array(lists, pa.list_(kind)),
                        pa.array(best, kind),
                        pa.array(text, pa.binary()).cast(pa.string()),
                    ],
                    names=[*b.schema.names[1:], "n_words", "runs", "best", "text"],
                )

    schema = rows.drop("_text").schema
    for name, kind_of in (("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("best", RUN), ("text", T.StringType())):
        schema = schema.add(name, kind_of)
    found = rows.mapInArrow(run, schema)
    return found.select("id", "n_words", "runs", "best", "text", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
