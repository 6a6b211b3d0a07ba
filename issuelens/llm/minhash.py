"""MinHash near-duplicates of whole documents, verified by sequential Bayesian tests.

A document's set holds its distinct five-word shingles, lower-cased (A-Z); with fewer words, the whole sequence as one.
Documents with equal sets are one node, so copies cost nothing beyond a count.  Two nodes are candidates if the
MinHash signatures of their sets agree in a band.  A candidate pair's signatures are compared batch by batch: after h
hashes of which m agree, the posterior of the similarity under a uniform prior is Beta(m + 1, h - m + 1), and the pair
is pruned as soon as the chance of reaching the threshold falls below ``MISS``.  Survivors of all batches are confirmed
on their full sets.  Classes are the connected components of the confirmed links.

How pairs are kept few.  Nodes that share a band, directly or over others, form a cluster, and each node's set travels
once, to its cluster.  Inside a task a cluster is explored from the node that meets most others: what is linked is in one
class already and is not compared again, and only the edges of a spanning forest leave the task.  A cluster of more than
``MEMBERS`` nodes or ``VOLUME`` shingles is cut into blocks by hash.  Its ``CENTRES`` best connected nodes visit every block,
so a family around one text comes together in the first round; then every node outside the cluster's largest class
visits the other blocks and is compared with the members of other classes there.  Two nodes of different classes are
never both in the largest one, so no pair of a band goes unseen, and no task holds a whole hot cluster.

At the threshold itself a pair shares no band with a chance of (1 - 0.85^8)^32 = 0.00004 and is pruned with a chance of at most
``MISS`` a batch; more similar pairs are missed less.  Identity of shingles and sets goes by 64-bit hashes.

Edge cases: null, empty and wordless texts have the empty set and are linked with nothing; rows are documents, so rows with
equal ids and different texts may fall into different classes; a row with a null id links like any other, and a class takes
its smallest id that is not null (null if there is none); an empty table gives no rows; very long texts are
read whole; other columns pass through by the caller's choice (``keep``).
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm.common import PRIME, components, row_blocks, shingle_codes, stage, text_bytes, word_hashes

SHINGLE = 5
PERCENT = 85
ROWS = 8
BANDS = 32
BATCH = 32
MISS = 1e-6
MEMBERS = 4_096
VOLUME = 1 << 21
CENTRES = 32
BLOCK_BYTES = 2 << 20
FIRST, GUEST = 0, 1  # members of a block come before its visitors


def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> list[int]:
    """Per batch boundary h: the fewest agreeing hashes for which P(similarity >= threshold | m of h) >= miss.

    With a uniform prior the posterior is Beta(m + 1, h - m + 1); its upper tail at t is the chance that a
    Binomial(h + 1, t) is at most m.
    """
    out = []
    for h in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
        out.append(m)
    return out


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct codes of a document's shingles."""
    return np.unique(shingle_codes(word_hashes(words), min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def signatures(codes: np.ndarray, starts: np.ndarray, hashes: int = ROWS * BANDS, seed: int = 12) -> np.ndarray:
    """MinHash values (set, hash) of sets laid end to end."""
    rng = np.random.default_rng(seed)
    short = (codes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), hashes), np.uint32)
    for k in range(hashes):
        turn, odd = np.uint32(rng.integers(0, 1 << 32)), np.uint32(rng.integers(0, 1 << 31) * 2 + 1)
        out[:, k] = np.minimum.reduceat((short ^ turn) * odd, starts)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per set and band: (set, band)."""
    parts = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    keys = np.arange(1, parts.shape[1] + 1, dtype=np.uint64)[None, :] * PRIME
    for k in range(rows):
        keys = (keys ^ parts[:, :, k]) * PRIME
        keys ^= keys >> np.uint64(31)
    return keys


def _key(id_col: str, text_col: str) -> Column:
    """The id, or for a null id a number from the text: finds a row's text again."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def sets_of(texts: list[bytes]) -> tuple[list[np.ndarray], list[int | None]]:
    """Shingle sets and nodes (null: empty set)."""
    sets = [shingle_set(t.lower().split()) for t in texts]
    return sets, [digest(s) if len(s) else None for s in sets]


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets laid end to end, and where each one starts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets), np.cumsum(sizes) - sizes


def nodes_of(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Every row as (id, key, node, n, bands) and ``keep``; node is null for an empty set, bands null but for a node's
    first row in a batch."""
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("id"), _key(id_col, text_col).alias("key"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )

    def run(batches):
        for b in batches:
            raw = text_bytes(b.column(0))
            for a, z in row_blocks(raw, BLOCK_BYTES):
                sets, node = sets_of(raw[a:z])
                seen: dict[int, int] = {}
                for i, k in enumerate(node):
                    if k is not None:
                        seen.setdefault(k, i)
                bands: list = [None] * (z - a)
                if seen:
                    keys = band_keys(signatures(*flat([sets[i] for i in seen.values()]))).view(np.int64)
                    for k, i in enumerate(seen.values()):
                        bands[i] = keys[k]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(a, z - a) for c in b.columns[1:]],
                        pa.array(node, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=[*b.schema.names[1:], "node", "n", "bands"],
                )

    return rows.mapInArrow(run, rows.drop("_text").schema.add("node", "long").add("n", "long").add("bands", T.ArrayType(T.LongType())))


def digest(codes: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    value = xxhash.xxh64_intdigest(codes.tobytes(), 5)
    return value - (1 << 64) if value >> 63 else value


class Verifier:
    """Sequential test of candidate pairs, and the exact check of what survives."""

    def __init__(self, percent: int = PERCENT, miss: float = MISS):
        self.percent = percent
        self.bounds = least_matches(ROWS * BANDS, BATCH, percent / 100, miss)

    def survivors(self, bands: np.ndarray, low: np.ndarray, others: np.ndarray, own: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Those of ``others`` that share one of the bands ``own`` and are not pruned by any batch of the signature ``mine``."""
        others = others[(bands[others] == own).any(axis=1)]
        agree = np.zeros(len(others), np.int64)
        for k, bound in enumerate(self.bounds):
            at = slice(k * BATCH, (k + 1) * BATCH)
            agree += (low[others, at] == mine[at]).sum(axis=1)
            stay = agree >= bound
            others, agree = others[stay], agree[stay]
        return others

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """100 * intersection >= percent * union, on the full sets."""
        if len(a) > len(b):
            a, b = b, a
        if 100 * len(a) < self.percent * len(b):
            return False
        at = np.searchsorted(b, a)
        both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * both >= self.percent * (len(a) + len(b) - both)


class Group:
    """Rows of one task's group: nodes with their classes, bands, signatures and sets."""

    def __init__(self, rows: list[tuple]):
        node, label, bands, low, self.sets = zip(*rows)
        self.node, self.label = np.array(node, np.int64), np.array(label, np.int64)
        self.bands, self.low = np.stack(bands), np.stack(low)

    def explore(self, verifier: Verifier) -> list[tuple[int, int]]:
        """Spanning forest of the confirmed links; rows come with the best connected node first."""
        left = np.arange(len(self.node))
        edges = []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                one = queue.pop()
                near = verifier.survivors(self.bands, self.low, left, self.bands[one], self.low[one])
                found = [i for i in near if verifier.linked(self.sets[one], self.sets[i])]
                if found:
                    edges += [(int(self.node[one]), int(self.node[i])) for i in found]
                    queue += found
                    left = left[~np.isin(left, found)]
        return edges

    def visit(self, guests: list[tuple], verifier: Verifier) -> list[tuple[int, int]]:
        """Confirmed links between guests and members of another class, one per pair of classes."""
        edges, joined = [], {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for node, label, bands, low, codes in guests:
            mine = root(label)
            for i in verifier.survivors(self.bands, self.low, np.flatnonzero(self.label != label), bands, low):
                other = root(int(self.label[i]))
                if other != mine and verifier.linked(codes, self.sets[i]):
                    edges.append((node, int(self.node[i])))
                    joined[mine] = other
                    mine = other
        return edges


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _grouped(rows: DataFrame) -> DataFrame:
    """A group's rows together: members before guests, the best connected first."""
    named = rows.select("grp", "role", "node", "label", "bands", "signature", "codes", "weight")
    return named.repartition(F.col("grp")).sortWithinPartitions("grp", "role", F.col("weight").desc(), "node")


def _rows(batch: pa.RecordBatch):
    """(group, role, (node, label, bands, signature, codes)) of every row."""
    plain = [batch.column(i).to_pylist() for i in range(4)]
    binary = [[np.frombuffer(x, kind) for x in batch.column(i).to_pylist()] for i, kind in ((4, np.int64), (5, np.uint16), (6, np.uint64))]
    for grp, role, *rest in zip(*plain, *binary):
        yield grp, role, tuple(rest)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def explored(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Forest edges inside every group."""

    def run(batches):
        verifier, grp, held = Verifier(percent, miss), None, []
        for b in batches:
            for key, _, row in _rows(b):
                if key != grp:
                    if len(held) > 1:
                        yield _edges(Group(held).explore(verifier))
                    grp, held = key, []
                held.append(row)
        if len(held) > 1:
            yield _edges(Group(held).explore(verifier))

    return _grouped(rows).mapInArrow(run, EDGE)


def visited(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links between each group's guests and members; members are held, guests pass by."""

    def run(batches):
        verifier, grp, held, group = Verifier(percent, miss), None, [], None
        for b in batches:
            guests = []
            for key, role, row in _rows(b):
                if key != grp:
                    if guests and group:
                        yield _edges(group.visit(guests, verifier))
                    grp, held, group, guests = key, [], None, []
                if role == FIRST:
                    held.append(row)
                else:
                    if group is None and held:
                        group = Group(held)
                    guests.append(row)
            if guests and group:
                yield _edges(group.visit(guests, verifier))

    return _grouped(rows).mapInArrow(run, EDGE)


def bodies(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, cluster, blocks, weight, bands, signature, codes) of the nodes ``placed`` puts at a row's key."""
    at = placed.groupBy(F.col("key").alias("_at")).agg(F.collect_list(F.struct("node", "cluster", "blocks", "weight")).alias("nodes"))
    texts = docs.select(_key(id_col, text_col).alias("_key"), F.col(text_col).cast("string").alias("text"))
    # A row has one node; rows that share an id, a few.  The keys grow with the table: texts and keys meet by a shuffle at any size.
    joined = texts.join(at.hint("shuffle_merge"), F.col("_key") == F.col("_at")).select("text", "nodes")

    def run(batches):
        for b in batches:
            raw, wanted = text_bytes(b.column(0)), b.column(1).to_pylist()
            for a, z in row_blocks(raw, BLOCK_BYTES):
                sets, node = sets_of(raw[a:z])
                out = [(i, w) for i, x in enumerate(node) for w in wanted[a + i] if w["node"] == x]
                if not out:
                    continue
                values = signatures(*flat([sets[i] for i, _ in out]))
                keys, low = band_keys(values), values.astype(np.uint16)
                numbers = [pa.array([w[c] for _, w in out], pa.int64()) for c in ("node", "cluster", "blocks", "weight")]
                parts = [[keys[k].tobytes(), low[k].tobytes(), sets[i].tobytes()] for k, (i, _) in enumerate(out)]
                yield pa.RecordBatch.from_arrays(
                    [*numbers, *[pa.array(x, pa.binary()) for x in zip(*parts)]],
                    names=["node", "cluster", "blocks", "weight", "bands", "signature", "codes"],
                )

    found = joined.mapInArrow(run, "node long, cluster long, blocks long, weight long, bands binary, signature binary, codes binary")
    return found.withColumn("label", F.col("node"))


def _own_block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks)


def links(
    docs: DataFrame, found: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, miss: float = MISS, members: int = MEMBERS,
    volume: int = VOLUME, centres: int = CENTRES,
) -> DataFrame:
    """Edges (a, b) between nodes whose components are the near-duplicate classes; ``found`` as from ``nodes_of``, staged."""
    nodes = found.where(F.col("bands").isNotNull()).groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stage(nodes, "minhash-bands")
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), F.min("node").alias("hub")).where("met > 1")
    # How often a node meets others, and one edge to each bucket's hub: linear in the buckets' sizes.
    star = stage(dealt.join(crowded, "bucket").groupBy("node", "hub").agg(F.sum("met").alias("met")), "minhash-met")
    clusters = components(star.select(F.col("node").alias("a"), F.col("hub").alias("b")), "minhash-clusters")
    weight = star.groupBy("node").agg(F.sum("met").alias("weight")).join(clusters, "node").join(nodes.select("node", "key", "n"), "node")
    placed = stage(weight.withColumnRenamed("component", "cluster"), "minhash-placed")
    size = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("rows") / members), F.ceil(F.col("total") / volume)).cast("long")
    placed = stage(placed.join(size.select("cluster", blocks.alias("blocks")), "cluster"), "minhash-blocks")
    sets = bodies(docs, placed, id_col, text_col).dropDuplicates(["node", "cluster"])
    spots = placed.where("blocks > 1")
    hot = spots.limit(1).count() > 0
    if hot:
        sets = stage(sets, "minhash-sets")
    grp = F.xxhash64("cluster", _own_block(F.col("blocks")))
    held = sets.withColumn("grp", grp).withColumn("role", F.lit(FIRST))

    # First round: every block by itself, the hot clusters' centres among the members of each of their blocks.
    if hot:
        held = held.unionByName(_guests(sets, _best(spots, centres), FIRST))
    first = stage(explored(held, percent, miss), "minhash-first")
    if not hot:
        return first

    # Second round, hot clusters only: who is outside the largest class visits the other blocks.
    classes = components(first, "minhash-classes").withColumnRenamed("component", "label")
    labelled = spots.select("node", "cluster").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "minhash-labels")
    sizes = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("largest"))
    rest = labelled.join(largest, "cluster").where("label <> largest").select("node")
    named = stage(sets.where("blocks > 1").drop("label").join(labelled.select("node", "label"), "node"), "minhash-named")
    inside = named.withColumn("grp", grp).withColumn("role", F.lit(FIRST))
    second = stage(visited(inside.unionByName(_guests(named, rest, GUEST)), percent, miss), "minhash-second")
    return first.unionByName(second)


def _best(spots: DataFrame, centres: int) -> DataFrame:
    """The nodes of each hot cluster that meet most others."""
    order = Window.partitionBy("cluster").orderBy(F.col("weight").desc(), "node")
    return spots.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= centres).select("node")


def _guests(sets: DataFrame, who: DataFrame, role: int) -> DataFrame:
    """The nodes of ``who``, one row per other block of their cluster."""
    others = F.expr("filter(sequence(0L, blocks - 1), b -> b <> pmod(xxhash64(node), blocks))")
    rows = sets.join(who, "node", "left_semi").select("*", F.explode(others).alias("_block"))
    return rows.withColumn("grp", F.xxhash64("cluster", "_block")).drop("_block").withColumn("role", F.lit(role))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, percent: int = PERCENT, miss: float = MISS,
    members: int = MEMBERS, volume: int = VOLUME, centres: int = CENTRES,
) -> DataFrame:
    """Every row as (id, n_shingles, component, kept) and the columns ``keep``.

    ``component`` is the smallest id of the row's class; ``kept`` marks the rows that bear it.
    """
    keep = keep or []
    found = stage(nodes_of(docs, id_col, text_col, keep), "minhash-nodes")
    edges = links(docs, found, id_col, text_col, percent, miss, members, volume, centres)
    classes = components(edges, "minhash-final")
    least = found.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k"))
    least = stage(least, "minhash-least")
    mine = least.join(classes, "node").groupBy(F.col("component")).agg(F.min("least").alias("least"))
    linked = classes.join(mine, "component").select(F.col("node").alias("_node"), F.col("least").alias("class"))
    # Nodes of one row that link to nothing need no entry: their row is its own class.
    owner = least.where("k > 1").select(F.col("node").alias("_node"), "least").join(linked, "_node", "full")
    owner = stage(owner.select("_node", F.coalesce("class", "least").alias("_class")), "minhash-owner")
    rows = found.select("id", "n", "node", *[f"_keep_{i}" for i in range(len(keep))])
    joined = rows.join(owner, rows.node == owner._node, "left")
    component = F.when(F.col("_node").isNotNull(), F.col("_class")).otherwise(F.col("id"))
    return joined.select(
        "id",
        F.col("n").alias("n_shingles"),
        component.alias("component"),
        F.col("id").eqNullSafe(component).alias("kept"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )
