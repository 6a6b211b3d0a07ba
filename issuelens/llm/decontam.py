"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

For every benchmark item, each window of a document with as many words as the item is compared with it:
both get a weighted SimHash over five-word shingles (rare shingles of the benchmark weigh more); windows
within ``radius`` bits are found by a multi-index over ``BLOCKS`` wide blocks of the items' fingerprints (two
fingerprints within the radius differ in few bits of one block at least, so none is lost, while one item in seven is a
candidate for a random window); candidates are then checked by the exact weighted Jaccard similarity of their shingles.

Windows that share no shingle with any item of their size have similarity 0 and are skipped; that test is one
pass over the words of all texts against the set of item shingles.  Words are lower-cased, and ASCII
punctuation separates words.  Items shorter than five words form one shingle.  ``radius`` 19 of 64 bits is where
a pair with similarity 0.8 is missed with a chance below 0.001 (expected distance 9.7 bits, deviation 2.9).

The benchmark is taken in blocks of at most about ``block_bytes`` of text; each block is broadcast and read
against all documents, so nothing of unbounded size is broadcast and no document is compared by a join.  Weights come
from the whole benchmark: how many items hold a shingle is counted once, by Spark, in ``BUCKETS`` counters by hash of the shingle (a table
of fixed size), so no result depends on how the items are cut into blocks.

Edge cases: null, empty or wordless texts and items never match; repeated document ids give one row per id
and item (the best match); repeated items match each on their own id; null ids are kept; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import PRIME, row_blocks, shingle_codes, text_bytes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCKS = 4
BLOCK_BYTES = 32 << 20
BUCKETS = 1 << 20

#: ASCII punctuation and control bytes become blanks; letters, digits and bytes of other characters stay.
_KEEP = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).lower().split()


def prefix_votes(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums over shingles of +weight for a set bit and -weight for a clear one: (n + 1, 64)."""
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.where(bits == 1, weights[:, None], -weights[:, None])
    return np.concatenate([np.zeros((1, 64)), np.cumsum(votes, axis=0)])


def pack(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 1e-9, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class MultiIndex:
    """Fingerprints by the value of each block of bits; a query meets the values within a block's reach of its own.

    The reaches of the ``BLOCKS`` blocks add up to radius - BLOCKS + 1: a pair beyond the reach of every block differs
    in more than ``radius`` bits, so none is lost.  ``met`` counts the candidates, block by block.
    """

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius, self.met = codes, radius, 0
        self.width = 64 // BLOCKS
        reach, more = divmod(radius - BLOCKS + 1, BLOCKS)
        spread = np.bitwise_count(np.arange(1 << self.width))
        self.tables = []  # shift, reach, distinct values, place of each value, first item of each, items in order, turns
        for i in range(BLOCKS):
            near = reach + (i < more)
            if near < 0:
                continue
            own = self._block(codes, self.width * i)
            order = np.argsort(own, kind="stable")
            values, first = np.unique(own[order], return_index=True)
            turns = np.flatnonzero(spread <= near)
            place = None
            if len(values) > len(turns):
                place = np.full(1 << self.width, -1)
                place[values] = np.arange(len(values))
            self.tables.append((self.width * i, near, values, place, np.append(first, len(own)), order, turns))

    def _block(self, codes: np.ndarray, shift: int) -> np.ndarray:
        return (codes >> np.uint64(shift)).astype(np.int64) & ((1 << self.width) - 1)

    def search(self, queries: np.ndarray, budget: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) numbers within the radius."""
        n = len(self.codes)
        found = [np.zeros(0, np.int64)]
        step = max(1, budget // max(n, 1))
        for start in range(0, len(queries) if n else 0, step):  # bounded tables of candidates
            part = queries[start : start + step]
            hits = []
            for shift, near, values, place, first, order, turns in self.tables:
                own = self._block(part, shift)
                if place is None:  # few values: all are looked at
                    q, v = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= near)
                else:  # many: those that a turned value hits
                    q, turn = np.nonzero(place[own[:, None] ^ turns[None, :]] >= 0)
                    v = place[own[q] ^ turns[turn]]
                count = first[v + 1] - first[v]
                self.met += int(count.sum())
                at = np.repeat(first[v] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                q, item = np.repeat(q, count), order[at]
                close = np.bitwise_count(part[q] ^ self.codes[item]) <= self.radius
                hits.append((q[close] + start) * n + item[close])
            found.append(np.unique(np.concatenate(hits)))
        pairs = np.concatenate(found)
        return np.divmod(pairs, max(n, 1))


def bucket(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(40)).astype(np.int64) % BUCKETS


def frequencies(items: DataFrame) -> tuple[np.ndarray, int]:
    """Items per bucket of shingles, and items with a word, over the whole benchmark (rows (item, text))."""

    def run(batches):
        for b in batches:
            for text in text_bytes(b.column(1)):
                if words := tokens(text):
                    found = np.unique(bucket(shingle_codes(word_hashes(words), min(SHINGLE, len(words)))))
                    # Bucket -1 counts the items.
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int64())], names=["bucket"])

    table = np.zeros(BUCKETS + 1, np.int64)
    for r in items.mapInArrow(run, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # BUCKETS + 1 rows at most
        table[r["bucket"]] = r["n"]
    return table[:-1], int(table[-1])


class Benchmark:
    """One block of items, ready for search."""

    def __init__(self, items: list[tuple], frequency: np.ndarray, count: int, radius: int = RADIUS, similarity: float = SIMILARITY):
        """``frequency``: items of the whole benchmark per bucket of shingles; ``count``: its items with a word."""
        self.similarity = similarity
        self.weight_of = 1 + np.log(max(1, count) / np.maximum(frequency, 1))
        self.items = []  # item id, number of words, {shingle: count}, total weight
        words_of = [(i, w) for i, t in items if (w := tokens(t))]
        self.place: dict[bytes, int] = {}
        for _, words in words_of:
            for w in words:
                self.place.setdefault(w, len(self.place) + 1)
        known = {w: h for w, h in zip(self.place, word_hashes(list(self.place)).tolist())}
        codes_of = [shingle_codes(np.array([known[w] for w in words], np.uint64), min(SHINGLE, len(words))) for _, words in words_of]
        self.shingles = np.unique(np.concatenate(codes_of)) if codes_of else np.zeros(0, np.uint64)
        sizes: dict[int, list] = {}
        self.spellings: dict[int, np.ndarray] = {}  # words per shingle -> codes over word numbers, sorted
        by_length: dict[int, set] = {}
        for (item, words), codes in zip(words_of, codes_of):
            weights = self.weights(codes)
            fingerprint = pack(prefix_votes(codes, weights)[-1:])[0]
            counts: dict[int, int] = {}
            for c in codes.tolist():
                counts[c] = counts.get(c, 0) + 1
            k = min(SHINGLE, len(words))
            by_length.setdefault(k, set()).update(
                shingle_codes(np.array([self.place[w] for w in words], np.uint64), k).tolist()
            )
            sizes.setdefault(len(words), []).append((item, fingerprint, counts, float(weights.sum())))
        self.spellings = {k: np.array(sorted(v), np.uint64) for k, v in by_length.items()}
        self.sizes = {m: (MultiIndex(np.array([x[1] for x in own], np.uint64), radius), own) for m, own in sizes.items()}
        # Which sizes have an item with a given shingle.
        self.sizes_of: dict[int, set] = {}
        for m, (_, own) in self.sizes.items():
            for x in own:
                for c in x[2]:
                    self.sizes_of.setdefault(c, set()).add(m)

    def weights(self, codes: np.ndarray) -> np.ndarray:
        """Weight of each shingle: 1 + log(items / items in its bucket, one at least)."""
        return self.weight_of[bucket(codes)]

    def suspects(self, texts: list[bytes]) -> list[int]:
        """Texts that share a shingle with an item."""
        get = self.place.get
        ids: list[int] = []
        ends = []
        for t in texts:
            ids.extend([get(w, 0) for w in tokens(t)])
            ids.append(0)
            ends.append(len(ids))
        flat = np.array(ids, np.uint64)
        known = flat != 0
        found = np.zeros(0, np.int64)
        for k, spelled in self.spellings.items():
            run = known[: max(len(flat) - k + 1, 0)].copy()
            for i in range(1, k):
                run &= known[i : i + len(run)]
            at = np.flatnonzero(run)
            code = np.zeros(len(at), np.uint64)
            for i in range(k):
                code = (code ^ flat[at + i]) * PRIME
                code ^= code >> np.uint64(31)
            where = np.minimum(np.searchsorted(spelled, code), len(spelled) - 1)
            found = np.concatenate([found, at[spelled[where] == code]])
        return np.unique(np.searchsorted(ends, found, side="right")).tolist()

    def matches(self, text: bytes) -> dict[int, tuple]:
        """Best window for each item that the text contains: item -> (similarity, first word, words, distance)."""
        words = tokens(text)
        hashes = word_hashes(words)
        best: dict = {}
        for k in self.spellings:
            codes = shingle_codes(hashes, k)
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(self.shingles, codes), len(self.shingles) - 1)
            hits = np.flatnonzero(self.shingles[at] == codes)
            starts: dict[int, list] = {}
            for p in hits.tolist():
                for m in self.sizes_of.get(int(codes[p]), ()):
                    if min(SHINGLE, m) == k:
                        starts.setdefault(m, []).append(p)
            weights = self.weights(codes)
            mass = np.concatenate([[0.0], np.cumsum(weights)])
            for m, hit in starts.items():
                span = m - k + 1  # shingles of a window
                hit = np.array(hit)
                low, high = np.maximum(hit - span + 1, 0), np.minimum(hit, len(codes) - span)
                cover = np.zeros(len(codes) + 2, np.int64)
                ok = low <= high
                np.add.at(cover, low[ok], 1)
                np.add.at(cover, high[ok] + 1, -1)
                windows = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                index, own = self.sizes[m]
                for run in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1) if len(windows) else []:
                    a, b = int(run[0]), int(run[-1]) + span
                    for c in range(a, b - span + 1, 4096):  # bounded tables for very long runs
                        d = min(b, c + 4096 + span - 1)
                        votes = prefix_votes(codes[c:d], weights[c:d])
                        prints = pack(votes[span:] - votes[:-span])
                        for q, i in zip(*index.search(prints)):
                            first = c + int(q)
                            item, fingerprint, counts, total = own[i]
                            shared = 0.0
                            left = dict(counts)
                            for code, w in zip(codes[first : first + span].tolist(), weights[first : first + span].tolist()):
                                if left.get(code, 0):
                                    left[code] -= 1
                                    shared += w
                            sim = shared / (mass[first + span] - mass[first] + total - shared)
                            if sim >= self.similarity - 1e-9 and (item not in best or (sim, -first) > (best[item][0], -best[item][1])):
                                best[item] = (sim, first, m, int(np.bitwise_count(prints[q] ^ fingerprint)))
        return best


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    radius: int = RADIUS,
    similarity: float = SIMILARITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (id, item, similarity, first_word, n_words, distance): the best window of each pair that matches."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, similarity double, first_word long, n_words long, distance int"
    counted = spark.sparkContext.broadcast(frequencies(items))
    parts = []
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect()
        shared = spark.sparkContext.broadcast(sorted(((r.item, r.text.encode()) for r in block), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches, shared=shared):
            bench = Benchmark([(n, t) for n, (_, t) in enumerate(shared.value)], *counted.value, radius, similarity)
            names = [i for i, _ in shared.value]
            for b in batches:
                texts, ids = text_bytes(b.column(1)), b.column(0).to_pylist()
                out = []
                for a, z in row_blocks(texts, 4 << 20):
                    for s in bench.suspects(texts[a:z]):
                        for n, (sim, first, m, dist) in sorted(bench.matches(texts[a + s]).items()):
                            out.append((ids[a + s], names[n], sim, first, m, dist))
                if out:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(("id", "item", "similarity", "first_word", "n_words", "distance"), r)) for r in out],
                        schema=pa.schema([("id", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())]),
                    )

        parts.append(rows.mapInArrow(run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rest = F.struct(F.col("similarity"), (-F.col("first_word")).alias("f"), "n_words", "distance")
    return (
        found.groupBy("id", "item")
        .agg(F.max(rest).alias("m"))
        .select("id", "item", "m.similarity", (-F.col("m.f")).alias("first_word"), "m.n_words", "m.distance")
    )
