"""Repeated-substring dedup by merging Burrows-Wheeler transforms of shards.

A byte is removed when it lies in a ``SPAN``-byte string (UTF-8) that also starts in a document with a smaller id.

Where can a repeated string be?  Every string's anchor is the smallest hash among its ``GRAM``-byte grams, so equal
strings have equal anchors; consecutive starts with the same anchor form a run, and a run's window is the
text that its strings cover.  Strings whose anchor occurs in one document only cannot repeat and are left out.

The windows of an anchor meet in one bucket of anchors; equal windows are one, with their smallest id, and a window that
stays alone with its anchor shares no string with another.  The others are indexed: shards of windows get their own suffix
order and transform; the transforms are merged by refining the interleave of the shards: starting from "all rows of shard 0,
then shard 1, ...", one pass per symbol deals the rows by the symbol before them, which sorts them by one
more leading symbol, and rows that a pass separates get their longest common prefix.  After ``SPAN`` passes the rows
between two separations are the intervals with a common prefix of ``SPAN`` or more.  No suffix is sorted again.  The smallest id of
each interval goes back to the documents.

Nothing unbounded meets in one place.  Documents are grouped in blocks by a hash of the id; a bucket gets each
different window of a block once, with the smallest id; verdicts go back per block and window.  Anchors that
are frequent in a batch of documents send one summary and keep their list of documents in a side table.  The
windows of an anchor in more than ``HOT`` places are cut into single strings and dealt by the whole string,
so the different contexts of a very common line spread over all buckets.

Buckets, blocks and shards follow the size of the table.  Windows and anchors are told apart by 64-bit hashes.

Edge cases: null and empty texts have no byte; texts shorter than ``SPAN`` lose nothing; a null id counts as larger
than all others; rows with the same id do not remove each other's bytes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens.llm.common import row_blocks, stage, text_bytes

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM + 1
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 6 << 20
SHARD_BYTES = 1 << 19
STEP_BYTES = 4 << 20
PACK_BYTES = 32 << 20  # text of a task whose documents are packed together
TEXT_LEVEL = 1
CHUNK = 1 << 15
FREQUENT = 64
HOT = 5_000
NO_ID = (1 << 63) - 1

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), kind)


def blocks_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each id: crc32 of the id as text."""
    distinct, place = np.unique(ids, return_inverse=True)
    return np.fromiter((zlib.crc32(b"%d" % i) % blocks for i in distinct.tolist()), np.int64, len(distinct))[place]


def least_gram(eight: np.ndarray, at: int, to: int) -> np.ndarray:
    """Smallest hash among the REACH grams from each place; ``eight``: the eight bytes at each place."""
    h = eight[at:to] * _C[0]
    for i in range(8, GRAM, 8):
        h ^= h >> np.uint64(32)
        h += eight[at + i : to + i]
        h *= _C[1]
    h ^= h >> np.uint64(29)
    h *= _C[2]
    width = 1
    while width * 2 <= REACH:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (REACH - width)], h[REACH - width :])


_MIXED = (np.arange(1, 257, dtype=np.uint64) * _C[3]) ^ (np.arange(1, 257, dtype=np.uint64) * _C[1] >> np.uint64(7))
_powers = np.zeros(0, np.uint64)


def powers_of_base(n: int) -> np.ndarray:
    """The first n powers of the base of the polynomial hash; kept for the next call."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(n + (n >> 2), _C[0]))
    return _powers[:n]


class Runs:
    """Runs of starts with a common anchor over several texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        n = int(self.sizes.sum())
        self.data = b"".join(texts) + bytes(64)
        self.bytes = np.frombuffer(self.data, np.uint8)
        if n < SPAN:
            self.start = self.length = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            self.text = self.start
            return
        eight = np.ndarray((n + GRAM,), "<u8", buffer=self.data, strides=(1,))
        h = np.empty(n - REACH + 1, np.uint64)
        for at in range(0, len(h), CHUNK):  # pieces that stay in the processor's cache
            to = min(at + CHUNK, len(h))
            h[at:to] = least_gram(eight, at, to + REACH - 1)
        valid = np.ones(len(h) + 1, bool)
        valid[-1] = False
        for end, size in zip(self.ends.tolist(), self.sizes.tolist()):
            valid[max(end - size, end - SPAN + 1) : end] = False
        change = np.ones(len(h) + 1, bool)
        change[1:-1] = (h[1:] != h[:-1]) | (valid[1:-1] != valid[:-2])
        edge = np.flatnonzero(change)
        start, length = edge[:-1], np.diff(edge)
        keep = valid[start]
        start, length = start[keep], length[keep]
        if len(length) and length.max() > REACH:  # periodic text: cut long runs
            parts = -(-length // REACH)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + nth * REACH
            length = np.minimum(np.repeat(length, parts) - nth * REACH, REACH)
        self.start, self.length = start, length
        self.anchor = h[start]
        self.text = np.searchsorted(self.ends, start, side="right")

    def prefix(self) -> tuple[np.ndarray, np.ndarray]:
        """Running polynomial hash of all bytes, and the powers of its base."""
        powers = powers_of_base(len(self.bytes))
        total = np.zeros(len(powers) + 1, np.uint64)
        np.cumsum(_MIXED[self.bytes] * powers, out=total[1:])
        return total, powers

    def hashes(self, start: np.ndarray, size: np.ndarray, prefix) -> np.ndarray:
        """64-bit hash of each piece of text: the same wherever it stands."""
        total, powers = prefix
        raw = (total[start + size] - total[start]) * powers[len(powers) - 1 - start]
        # Every piece is now scaled by the same power, that of the last place; the scale must not depend on the block.
        raw *= inverse_power(len(powers))
        raw = (raw ^ (raw >> np.uint64(31))) * _C[2] + size.astype(np.uint64)
        return (raw ^ (raw >> np.uint64(30))) * _C[1]


def inverse_power(n: int) -> np.uint64:
    """Inverse, modulo 2**64, of the base to the power n."""
    return np.uint64(pow(int(_C[0]), -n, 1 << 64))


def codes_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the anchor in the upper half, the anchor's lower half below."""
    low = anchor & np.uint64(0xFFFFFFFF)
    return ((anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | low


def _groups(key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def suffix_order(flat: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a shard; ``stop``: place of the terminator (0) that ends each suffix."""
    width = int((stop - np.arange(len(flat))).max()) + 1
    width += -width % 8
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    table = np.lib.stride_tricks.as_strided(padded, (len(flat), width), (1, 1)).copy()
    left = (stop - np.arange(len(flat)))[:, None]
    table *= np.arange(width)[None, :] < left
    return np.argsort(table.view(f"S{width}").reshape(-1), kind="stable")


def merge(shards: list[np.ndarray], ends: list[np.ndarray], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Interval of every place of every shard (-1: alone), and each place's common prefix with the row before it (of places that begin with a symbol).

    A shard is an array of symbols in which 0 ends each text; ``ends`` holds, per place, where its text ends.
    Places with equal intervals start with the same ``span`` symbols.  The common prefix is ``span`` where it is as long
    as that.  A row that stays alone at some depth is final: so are the rows that follow from it, and they
    leave the interleave.
    """
    orders = [suffix_order(s, e) for s, e in zip(shards, ends)]
    transform = np.concatenate([s[o - 1] for s, o in zip(shards, orders)])  # the symbol before each suffix
    n = len(transform)
    back = np.empty(n, np.int32)  # the row of the suffix that is one symbol longer
    at = 0
    for o in orders:
        rank = np.empty(len(o), np.int32)
        rank[o] = np.arange(at, at + len(o))
        back[at : at + len(o)] = rank[o - 1]
        at += len(o)
    interleave = np.arange(n, dtype=np.int32)  # shard after shard
    block = np.zeros(n, np.int32)
    common = np.full(n, span, np.int16)
    for depth in range(span):
        symbol = transform[interleave]
        going = np.flatnonzero(symbol)  # what follows a terminator begins another text
        symbol = symbol[going]
        dealt = np.argsort(symbol, kind="stable")
        from_ = going[dealt]
        symbol, own = symbol[dealt], block[from_]
        interleave = back[interleave[from_]]
        apart = np.ones(len(from_) + 1, bool)
        apart[1:-1] = (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
        heads = interleave[apart[:-1]]
        common[heads] = np.minimum(common[heads], depth)
        shared = ~(apart[:-1] & apart[1:])
        interleave, block = interleave[shared], np.cumsum(apart[:-1], dtype=np.int32)[shared]
    interval = np.full(n, -1, np.int32)
    interval[interleave] = block
    where = np.concatenate([o + at for o, at in zip(orders, np.cumsum([0] + [len(o) for o in orders[:-1]]))])
    named, prefix = np.empty(n, np.int32), np.empty(n, np.int16)
    named[where], prefix[where] = interval, common
    return named, prefix


def smallest_ids(windows: list[bytes], ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each start in each window: the smallest id of a window that holds the start's string."""
    shards, ends, owners, offsets = [], [], [], []
    at = 0
    while at < len(windows):
        size, to = 0, at
        while to < len(windows) and (size == 0 or size < shard_bytes):
            size += len(windows[to]) + 1
            to += 1
        lengths = np.fromiter(map(len, windows[at:to]), np.int64, to - at)
        # Symbols are bytes + 1: byte 255 does not occur in UTF-8.
        flat = np.frombuffer(b"\xff".join(windows[at:to]) + b"\xff", np.uint8) + np.uint8(1)
        stop = np.cumsum(lengths + 1) - 1
        shards.append(flat)
        ends.append(np.repeat(stop, lengths + 1))
        owners.append(np.repeat(np.arange(at, to), lengths + 1))
        offsets.append(np.arange(len(flat)) - np.repeat(stop - lengths, lengths + 1))
        at = to
    if not shards:
        return []
    interval = merge(shards, ends)[0]
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    sizes = np.fromiter(map(len, windows), np.int64, len(windows))
    start = offset <= sizes[owner] - SPAN
    interval, owner = interval[start], owner[start]
    least = np.full(int(interval.max()) + 2, NO_ID, np.int64)  # the last entry, of places that are alone, is not used
    np.minimum.at(least, interval, ids[owner])
    counts = np.maximum(sizes - SPAN + 1, 0)
    return np.split(np.where(interval < 0, ids[owner], least[interval]), np.cumsum(counts)[:-1])


def _anchor_rows(buckets: int, frequent: int):
    """Batches (id, text) -> rows (route, kind, code, keys, ids): anchors by bucket."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), text_bytes(b.column(1))
            codes, owners = [], []
            for a, z in row_blocks(texts, STEP_BYTES):
                runs = Runs(texts[a:z])
                codes.append(codes_of(runs.anchor, buckets))
                owners.append(ids[a:z][runs.text] if len(runs.text) else np.zeros(0, np.int64))
            code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            heads = _groups(code)
            count = np.diff(np.append(heads, len(code)))
            rows = []
            often = count > frequent
            low, high = (np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)) if len(heads) else (owner, owner)
            rare = np.repeat(~often, count)
            few, few_ids = code[rare], owner[rare]
            bucket = (few >> np.uint64(32)).astype(np.int64)
            cut = _groups(bucket)
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(few)).tolist()):
                rows.append((int(bucket[a]), 0, 0, pack(few[a:z].astype(np.uint32)), pack(few_ids[a:z]), b""))
            much = code[heads[often]]
            bucket = (much >> np.uint64(32)).astype(np.int64)
            cut = _groups(bucket)
            spans = np.stack([low[often], high[often], count[often]], axis=1) if len(much) else np.zeros((0, 3), np.int64)
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(much)).tolist()):
                rows.append((int(bucket[a]), 1, 0, pack(much[a:z].astype(np.uint32)), pack(spans[a:z]), b""))
            for h, n, c in zip(heads[often].tolist(), count[often].tolist(), much.tolist()):
                own = np.unique(owner[h : h + n])
                spread = (c ^ int(own[0]) * 0x9E3779B1) % (buckets * 4 + 1)
                rows.append((-1 - spread, 2, c - (1 << 64) if c >> 63 else c, b"", pack(own), b""))
            if rows:
                names = ["route", "kind", "code", "keys", "ids", "more"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


ROW = "route long, kind int, code long, keys binary, ids binary, more binary"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS)], names=_NAMES)


def _by_route(batches):
    """Rows of each route in turn; the input is sorted by route."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            if row[0] < 0:
                yield [row]
            else:
                held.append(row)
    if held:
        yield held


def _repeated_anchors(blocks: int, limit: int):
    """Rows of one bucket -> per block the codes of anchors in two documents or more, verdicts on frequent anchors."""

    def run(batches):
        for rows in _by_route(batches):
            if rows[0][0] < 0:
                yield _batch(rows)
                continue
            route = rows[0][0]
            plain = [r for r in rows if r[1] == 0]
            keys = np.concatenate([unpack(r[3], np.uint32) for r in plain] or [np.zeros(0, np.uint32)])
            ids = np.concatenate([unpack(r[4], np.int64) for r in plain] or [np.zeros(0, np.int64)])
            often = [r for r in rows if r[1] == 1]
            many = np.concatenate([unpack(r[3], np.uint32) for r in often] or [np.zeros(0, np.uint32)])
            spans = np.concatenate([unpack(r[4], np.int64).reshape(-1, 3) for r in often] or [np.zeros((0, 3), np.int64)])
            all_keys = np.concatenate([keys, many])
            distinct, place = np.unique(all_keys, return_inverse=True)
            low, high = np.full(len(distinct), NO_ID), np.full(len(distinct), -NO_ID - 1)
            np.minimum.at(low, place, np.concatenate([ids, spans[:, 0]]))
            np.maximum.at(high, place, np.concatenate([ids, spans[:, 1]]))
            count = np.bincount(place, np.concatenate([np.ones(len(ids)), spans[:, 2]]), len(distinct))
            repeated, hot = low != high, count > limit
            full = (np.uint64(route) << np.uint64(32)) | distinct.astype(np.uint64)
            out = []
            own = place[: len(keys)]
            sel = repeated[own]
            block, which = blocks_of(ids[sel], blocks), own[sel]
            order = np.lexsort((which, block))
            block, which = block[order], which[order]
            cut = _groups(block)
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(block)).tolist()):
                w = np.unique(which[a:z])
                out.append((int(block[a]), 0, 0, pack(full[w]), pack(hot[w]), b""))
            told = np.unique(place[len(keys) :])
            for w in told[repeated[told]].tolist():
                out.append((0, 1, int(full[w].view(np.int64)), b"\x01" if hot[w] else b"\x00", b"", b""))
            if out:
                yield _batch(out)

    return run


def _spread_frequent(blocks: int):
    """Rows (code, hot, ids) of frequent anchors -> per block the codes that its documents hold."""

    def run(batches):
        code, hot, block = [], [], []
        size = 0

        def flush():
            c, h, b = (np.concatenate(x) for x in (code, hot, block))
            order = np.lexsort((c, b))
            c, h, b = c[order], h[order], b[order]
            cut = _groups(b)
            rows = []
            for a, z in zip(cut.tolist(), np.append(cut[1:], len(b)).tolist()):
                w = _groups(c[a:z]) + a
                rows.append((int(b[a]), 0, 0, pack(c[w]), pack(h[w]), b""))
            code.clear(), hot.clear(), block.clear()
            return _batch(rows)

        for batch in batches:
            for c, h, data in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                own = np.unique(blocks_of(unpack(data, np.int64), blocks))
                code.append(np.full(len(own), c, np.int64).view(np.uint64))
                hot.append(np.full(len(own), h == b"\x01"))
                block.append(own)
                size += len(own)
            if size > 4_000_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _packed(blocks: int):
    """Batches (id, text) -> rows (block, kind 2, a, c): the documents of a block laid end to end and compressed, as they are shuffled twice."""

    def flush(ids, texts):
        ids = np.concatenate(ids)
        block = blocks_of(ids, blocks)
        order = np.argsort(block, kind="stable")
        cut = _groups(block[order])
        rows = []
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
            own = order[a:z]
            parts = [texts[k] for k in own.tolist()]
            head = np.stack([ids[own], np.fromiter(map(len, parts), np.int64, len(parts))], axis=1)
            rows.append((int(block[own[0]]), 2, pack(head), zstandard.ZstdCompressor(level=TEXT_LEVEL).compress(b"".join(parts))))
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["block", "kind", "a", "c"])

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            all_ids, all_texts = b.column(0).to_numpy(zero_copy_only=False), text_bytes(b.column(1))
            for a, z in row_blocks(all_texts, STEP_BYTES):
                ids.append(all_ids[a:z])
                texts += all_texts[a:z]
                size += sum(map(len, texts[len(texts) - (z - a) :]))
                if size >= PACK_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts)

    return run


def _unpacked(head: bytes, data: bytes):
    """(id, text) of the documents of a packed row."""
    text, at = zstandard.ZstdDecompressor().decompressobj().decompress(data), 0
    for i, size in unpack(head, np.int64).reshape(-1, 2).tolist():
        yield i, text[at : at + size]
        at += size


def _with_block(batches, work):
    """Feeds ``work(block, notes, ids, texts)`` with the documents of one block in parts of bounded size.

    The input, sorted by (block, kind), has a block's notes (kind 0 and 1) before its packed documents (kind 2).
    """
    block, notes, ids, texts, size = None, [], [], [], 0
    for b in batches:
        for blk, kind, a, c in zip(*[b.column(k).to_pylist() for k in range(4)]):
            if blk != block:
                if texts:
                    yield work(block, notes, ids, texts)
                    ids, texts, size = [], [], 0
                block, notes = blk, []
            if kind < 2:
                notes.append((kind, a, c))
                continue
            for i, text in _unpacked(a, c):
                if size >= STEP_BYTES:
                    yield work(block, notes, ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
    if texts:
        yield work(block, notes, ids, texts)


def _lookup(notes, kind: int, types) -> list[np.ndarray]:
    """Notes of a kind, joined and sorted by the first array."""
    own = [n for n in notes if n[0] == kind]
    first = np.concatenate([unpack(n[1], types[0]) for n in own] or [np.zeros(0, types[0])])
    second = np.concatenate([unpack(n[2], types[1]) for n in own] or [np.zeros(0, types[1])])
    order = np.argsort(first, kind="stable")
    return [first[order], second[order]]


def _member(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in a sorted array, or -1."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def _pieces(runs: Runs, selected: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of string starts, and run of each piece: whole runs, and hot runs string by string."""
    calm, many = np.flatnonzero(selected & ~hot), np.flatnonzero(selected & hot)
    each = runs.length[many]
    step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    start = np.concatenate([runs.start[calm], np.repeat(runs.start[many], each) + step])
    length = np.concatenate([runs.length[calm], np.ones(len(step), np.int64)])
    return start, length, np.concatenate([calm, np.repeat(many, each)])


def _windows(buckets: int):
    """Documents with their block's repeated anchors -> rows by bucket: different windows with their smallest id."""

    def work(block, notes, ids, texts):
        runs = Runs(texts)
        owner = np.array(ids, np.int64)[runs.text] if len(runs.text) else np.zeros(0, np.int64)
        known, hot = _lookup(notes, 0, (np.uint64, np.bool_))
        code = codes_of(runs.anchor, buckets)
        at = _member(known, code)
        is_hot = np.zeros(len(code), bool)
        is_hot[at >= 0] = hot[at[at >= 0]]
        start, length, run = _pieces(runs, at >= 0, is_hot)
        if not len(start):
            return _batch([])
        size = length + SPAN - 1
        name = runs.hashes(start, size, runs.prefix())
        who = owner[run]
        # A single string of a hot anchor is dealt by itself and meets no other one: it carries no anchor.
        anchor = np.where(is_hot[run], -1, (code[run] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        route = np.where(is_hot[run], (name >> np.uint64(20)) % np.uint64(buckets), code[run] >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((who, name, route))
        heads = order[_groups_two(route[order], name[order])]
        last = np.append(_groups_two(route[order], name[order])[1:], len(order)) - 1
        several = who[order[last]] != who[heads]
        rows = []
        cut = _groups(route[heads])
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(heads)).tolist()):
            h = heads[a:z]
            text = b"".join([runs.data[s : s + n] for s, n in zip(start[h].tolist(), size[h].tolist())])
            head = np.stack([name[h].view(np.int64), who[h], anchor[h]], axis=1)
            tail = np.stack([length[h], several[a:z]], axis=1).astype(np.uint8)
            rows.append((int(route[h[0]]), block, 0, pack(head), pack(tail), zstandard.ZstdCompressor(level=1).compress(text)))
        return _batch(rows)

    return lambda batches: (out for out in _with_block(batches, work) if out.num_rows)


def _groups_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))


def _verdicts(batches):
    """Windows of one bucket -> per block: window, first start, number of starts and smallest id of pieces that repeat."""
    for rows in _by_route(batches):
        names, ids, anchors, lengths, several, block, data, starts = ([] for _ in range(8))
        at = 0
        for r in rows:
            head, tail = unpack(r[3], np.int64).reshape(-1, 3), unpack(r[4], np.uint8).reshape(-1, 2)
            names.append(head[:, 0].view(np.uint64))
            ids.append(head[:, 1])
            anchors.append(head[:, 2])
            lengths.append(tail[:, 0].astype(np.int64))
            several.append(tail[:, 1] > 0)
            block.append(np.full(len(head), r[1]))
            data.append(zstandard.ZstdDecompressor().decompress(r[5], max_output_size=1 << 31))
            size = lengths[-1] + SPAN - 1
            starts.append(at + np.cumsum(size) - size)
            at += len(data[-1])
        data = b"".join(data)
        name, who, anchor, length, several, block, start = (
            np.concatenate(x) for x in (names, ids, anchors, lengths, several, block, starts)
        )
        distinct, first, place = np.unique(name, return_index=True, return_inverse=True)
        least = np.full(len(distinct), NO_ID)
        np.minimum.at(least, place, who)
        counts, anchor, start = length[first], anchor[first], start[first]
        # Windows share a string only if they share its anchor: one that is alone with its anchor needs no index.
        _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
        met = np.flatnonzero((members[group] > 1) & (anchor >= 0))
        flat = np.repeat(least, counts)
        owner = np.repeat(np.arange(len(distinct)), counts)
        if len(met):
            texts = [data[a : a + n] for a, n in zip(start[met].tolist(), (counts[met] + SPAN - 1).tolist())]
            inside = np.zeros(len(distinct), bool)
            inside[met] = True
            flat[inside[owner]] = np.concatenate(smallest_ids(texts, least[met]))
        heads = _groups_two(owner, flat)  # pieces of a window with the same smallest id
        span = np.diff(np.append(heads, len(flat)))
        offset = heads - (np.cumsum(counts) - counts)[owner[heads]]
        piece_from = np.searchsorted(owner[heads], np.arange(len(distinct)))
        pieces = np.bincount(owner[heads], minlength=len(distinct))
        # Every mention of a window gets its pieces, but for those that start in its block's only document with it.
        times = pieces[place]
        mention = np.repeat(np.arange(len(place)), times)
        piece = piece_from[place][mention] + np.arange(len(mention)) - np.repeat(np.cumsum(times) - times, times)
        useful = several[mention] | (flat[heads[piece]] < who[mention])
        mention, piece = mention[useful], piece[useful]
        order = np.lexsort((name[mention], block[mention]))
        mention, piece = mention[order], piece[order]
        cut = _groups(block[mention])
        out = []
        for a, z in zip(cut.tolist(), np.append(cut[1:], len(mention)).tolist()):
            m, p = mention[a:z], piece[a:z]
            told = np.empty(z - a, PIECE)
            told["least"], told["offset"], told["count"] = flat[heads[p]], offset[p], span[p]
            out.append((int(block[m[0]]), 0, 0, pack(name[m]), pack(told.view(np.uint8)), b""))
        if out:
            yield _batch(out)


#: What a block is told about a part of a window: smallest id, first start, number of starts.
PIECE = np.dtype([("least", "<i8"), ("offset", "u1"), ("count", "u1")])


def _cut_out(buckets: int):
    """Documents with their block's verdicts -> rows (id, n_bytes, n_removed, n_spans, kept)."""

    def work(block, notes, ids, texts):
        runs = Runs(texts)
        n = int(runs.sizes.sum())
        edges = np.zeros(n + 1, np.int32)
        own = [x for x in notes if x[0] == 0]
        names = np.concatenate([unpack(x[1], np.uint64) for x in own] or [np.zeros(0, np.uint64)])
        told = np.concatenate([unpack(x[2], np.uint8).view(PIECE) for x in own] or [np.zeros(0, PIECE)])
        if len(names) and len(runs.start):
            order = np.argsort(names, kind="stable")
            names, told = names[order], told[order]
            hot = _lookup(notes, 1, (np.uint64, np.bool_))[0]
            is_hot = _member(hot, codes_of(runs.anchor, buckets)) >= 0
            start, length, run = _pieces(runs, np.ones(len(runs.start), bool), is_hot)
            name = runs.hashes(start, length + SPAN - 1, runs.prefix())
            low, high = np.searchsorted(names, name), np.searchsorted(names, name, side="right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            which = np.repeat(hit, count)
            note = np.repeat(low[hit], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            mine = np.array(ids, np.int64)[runs.text[run[which]]]
            gone = told["least"][note] < mine
            which, note = which[gone], note[gone]
            first = start[which] + told["offset"][note]
            np.add.at(edges, first, 1)
            np.add.at(edges, first + told["count"][note].astype(np.int64) - 1 + SPAN, -1)
        out = np.cumsum(edges[:n]) > 0
        kept_all = runs.bytes[:n]
        columns: list[list] = [[], [], [], []]
        at = 0
        for size in runs.sizes.tolist():
            part = out[at : at + size]
            removed = int(part.sum())
            columns[0].append(size)
            columns[1].append(removed)
            columns[2].append(int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if removed else 0)
            columns[3].append(kept_all[at : at + size][~part].tobytes() if removed else runs.data[at : at + size])
            at += size
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip([ids, *columns], kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    return lambda batches: _with_block(batches, work)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, hot_above: int = HOT
) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans, kept): one per row of ``docs``; kept: the bytes that are left."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    spark = docs.sparkSession
    routed = rows.mapInArrow(_anchor_rows(buckets, frequent), ROW).repartition("route").sortWithinPartitions("route")
    told = stage(routed.mapInArrow(_repeated_anchors(blocks, hot_above), ROW), "bwt-anchors")
    often = (
        told.where("kind = 2").select("code", "ids")
        .join(told.where("kind = 1").select("code", F.col("keys").alias("hot")), "code")
        .select("code", "hot", "ids")
        .mapInArrow(_spread_frequent(blocks), ROW)
    )
    notes = stage(told.where("kind = 0").unionByName(often), "bwt-notes")
    of_block = notes.select(F.col("route").alias("block"), F.lit(0).alias("kind"), F.col("keys").alias("a"), F.col("ids").alias("c"))
    documents = rows.mapInArrow(_packed(blocks), "block long, kind int, a binary, c binary")
    grouped = of_block.unionByName(documents).repartition("block").sortWithinPartitions("block", "kind")
    windows = grouped.mapInArrow(_windows(buckets), ROW).repartition("route").sortWithinPartitions("route")
    verdicts = stage(windows.mapInArrow(_verdicts, ROW), "bwt-verdicts")
    hot = of_block.select("block", F.lit(1).alias("kind"), "a", "c").mapInArrow(_only_hot, "block long, kind int, a binary, c binary")
    judged = verdicts.select(F.col("route").alias("block"), F.lit(0).alias("kind"), F.col("keys").alias("a"), F.col("ids").alias("c"))
    last = judged.unionByName(hot).unionByName(documents).repartition("block").sortWithinPartitions("block", "kind")
    out = last.mapInArrow(_cut_out(buckets), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def _only_hot(batches):
    """Notes reduced to the codes of hot anchors."""
    for b in batches:
        rows = []
        for block, kind, a, c in zip(*[b.column(k).to_pylist() for k in range(4)]):
            hot = unpack(c, np.bool_)
            if hot.any():
                rows.append((block, kind, pack(unpack(a, np.uint64)[hot]), pack(hot[hot])))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=b.schema.names)
