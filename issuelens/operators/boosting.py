"""Joint three-class (softmax) gradient boosting over once-binned features.

Every round grows one regression tree per class on the gradients of the same softmax, level by level: rows of each node
are summed into one histogram per feature, and the driver picks the splits.  Rows are held in blocks of bytes, one
byte per feature, written once to the shared folder.  A level is one pass over the blocks' gradients, which a round computes once; the
sums of a level have a fixed size (nodes x features x bins), whatever the number of rows; those of many tasks are merged in a tree
before they reach the driver.

Gradients are whole multiples of 2^-24, so sums are exact and the trees do not depend on how rows are dealt to tasks.
That is why one task may do all rounds for a table of at most ``LOCAL_ROWS`` rows (it holds ``LOCAL_ROWS`` times a few bytes) and the
cluster does the same rounds beyond it, with equal trees.

Rounds stop when the validation loss has not fallen for ``patience`` rounds; predictions use the trees up to the best round.
``fit`` continues from the trees of an earlier fit.  Row sample (per round) and column sample (per tree) go by hashes.

Regularised as in the usual second-order method: leaf -G / (H + L2), split gain by G^2 / (H + L2), and at least
``MIN_HESSIAN`` in a child.  Missing values (null, NaN) lie below every threshold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.session import prepare, scratch_path

BINS = 255  # bin 0 holds missing values
L2 = 1.0
MIN_HESSIAN = 1.0
UNIT = float(1 << 24)
LOCAL_ROWS = 1 << 19
MOVE_EVERY = 2  # distributed: rows get new margins after so many rounds; until then each round adds the last trees to them
FOLD_EVERY = 20  # distributed: rows with their margins are written to the shared folder after so many rounds
BLOCK_ROWS = 1 << 17  # distributed: rows worked on at once
TASK_ROWS = 1 << 19  # distributed: rows of a task, where there are more than cores
DIRECT_TASKS = 32  # distributed: sums of more tasks are merged in a tree


@dataclass
class Settings:
    """Settings of a fit; the defaults are the reference's."""

    rounds: int = C.GBT_TREES
    patience: int = C.GBT_EARLY_STOP
    depth: int = C.GBT_DEPTH
    step: float = C.GBT_STEP
    row_sample: float = C.GBT_SUBSAMPLE
    column_sample: float = C.GBT_COLSAMPLE
    seed: int = C.RANDOM_STATE


@dataclass
class Tree:
    """A complete binary tree, children of node i at 2 i + 1 and 2 i + 2; a row goes right if its bin exceeds ``cut``."""

    feature: np.ndarray  # -1: leaf
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def parts(self, bins: np.ndarray, level: int | None = None) -> list[tuple[int, np.ndarray]]:
        """(node, its rows) where the rows (feature, row) end, or stand at a level."""
        done, open_ = [], [(0, np.arange(bins.shape[1]))]
        while open_:
            node, rows = open_.pop()
            if self.feature[node] < 0 or (level is not None and node >= (1 << level) - 1):
                done.append((node, rows))
                continue
            right = bins[self.feature[node], rows] > self.cut[node]
            open_ += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
        return done

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row (feature, row) ends in."""
        at = np.zeros(bins.shape[1], np.int64)
        for node, rows in self.parts(bins):
            at[rows] = node
        return at


@dataclass
class Model:
    """Thresholds of the bins per feature, rounds of one tree per class, and the validation losses."""

    features: list[str]
    edges: list[list[float]]
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    best: int = 0  # rounds in use
    settings: Settings = field(default_factory=Settings)

    @property
    def classes(self) -> int:
        return len(C.CLASSES)


def margins(rounds: list[list[Tree]], bins: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """``start`` plus the rounds' leaf values (class, row), added one round after the other."""
    out = np.zeros((len(C.CLASSES), bins.shape[1])) if start is None else start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[k] += tree.value[tree.leaves(bins)]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """32 hash bits of each row's number and a salt."""
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


# ------------------------------------------------------------------ rows
@dataclass
class Block:
    """Rows of one block: bins (feature, row), label, held-out flag, row number for sampling, margins (class, row)."""

    bins: np.ndarray
    label: np.ndarray
    held: np.ndarray
    salt: np.ndarray
    margin: np.ndarray

    def begin(self, s: Settings, recent: list[list[Tree]], round_: int) -> tuple[Block, Gradients]:
        """The block with the ``recent`` rounds added to its margins, and what a round's levels need of it."""
        margin = margins(recent, self.bins, self.margin) if recent else self.margin
        p = softmax(margin)
        loss = np.zeros(2, np.int64)
        if self.held.any():
            at = np.flatnonzero(self.held)
            loss[0] = int(np.rint(-np.log(np.maximum(p[self.label[at], at], 1e-15)) * UNIT).astype(np.int64).sum())
            loss[1] = len(at)
        chosen = np.flatnonzero(~self.held & (_mixed(self.salt, (s.seed << 20) + round_) < np.uint32(min(s.row_sample, 1.0) * 0xFFFFFFFF)))
        q, label = p[:, chosen], self.label[chosen]
        g = np.stack([np.rint((q[k] - (label == k)) * UNIT) for k in range(len(q))])
        h = np.rint(np.maximum(2 * q * (1 - q), 1e-6) * UNIT)
        own = Block(self.bins, self.label, self.held, self.salt, margin)
        return own, Gradients(self.bins[:, chosen], g.astype(np.int32), h.astype(np.int32), loss)


@dataclass
class Gradients:
    """The rows of a block drawn for a round: bins (feature, row), gradients and hessians (class, row) in units; the held-out loss and its rows."""

    bins: np.ndarray
    g: np.ndarray
    h: np.ndarray
    loss: np.ndarray

    def sums(self, growing: list[Tree], level: int, columns: list[np.ndarray], slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Histograms (slot, feature, bin, g / h) of the nodes of a level that have a slot (class, node), over each class's ``columns``."""
        out = np.zeros((int(slots.max()) + 1, len(self.bins), BINS + 1, 2), np.int64)
        first = (1 << level) - 1
        for k, tree in enumerate(growing):
            for node, rows in tree.parts(self.bins, level):
                if node < first or slots[k, node - first] < 0:
                    continue  # rows in leaves further up take no part
                slot, g, h = slots[k, node - first], self.g[k, rows].astype(np.float64), self.h[k, rows].astype(np.float64)
                for f in columns[k]:
                    place = self.bins[f, rows].astype(np.intp)
                    # Whole numbers below 2^53 in doubles: the sums of a block are exact.
                    out[slot, f, :, 0] = np.bincount(place, g, BINS + 1)
                    out[slot, f, :, 1] = np.bincount(place, h, BINS + 1)
        return out, self.loss


def _pack(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """Blocks (n, bins, label, held, salt) of the rows (features, label, held, salt)."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            bins = np.stack([bin_column(b.column(i), edges[i]) for i in range(len(features))])
            label, held, salt = (b.column(len(features) + i).to_numpy(zero_copy_only=False) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([n], pa.int32()),
                    *[pa.array([x], pa.binary()) for x in (bins.tobytes(), label.astype(np.uint8).tobytes(), held.astype(np.uint8).tobytes(), salt.astype(np.int64).tobytes())],
                ],
                names=["n", "bins", "label", "held", "salt"],
            )

    return rows.mapInArrow(run, "n int, bins binary, label binary, held binary, salt binary")


def bin_column(column: pa.Array, edges: list[float]) -> np.ndarray:
    """0 for a missing value, else 1 + the number of edges below the value."""
    x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.searchsorted(np.array(edges), x, side="left") + 1
    return np.where(np.isnan(x), 0, out).astype(np.uint8)


def _unpack(n: int, bins, label, held, salt) -> Block:
    x = np.frombuffer(bins, np.uint8).reshape(-1, n)
    m = np.zeros((len(C.CLASSES), n))
    return Block(x, np.frombuffer(label, np.uint8), np.frombuffer(held, np.uint8).astype(bool), np.frombuffer(salt, np.int64), m)


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins`` - 1 ascending thresholds per feature: quantiles in one pass over the rows."""
    grid = [i / bins for i in range(1, bins)]
    # NaN counts as missing; the quantile sketch takes neither.
    clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in features])
    return [sorted(set(q)) for q in clean.approxQuantile(features, grid, 0.25 / bins)]


# ------------------------------------------------------------------ growing
def best_splits(sums: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: gain, feature and cut of the best split among ``columns``; sums (node, feature, bin, g / h)."""
    left = np.cumsum(sums[:, columns], axis=2)[:, :, :-1].astype(np.float64) / UNIT
    total = sums[:, columns].sum(axis=2)[:, :, None].astype(np.float64) / UNIT
    right = total - left

    def score(x):
        return x[..., 0] ** 2 / (x[..., 1] + L2)

    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < MIN_HESSIAN) | (right[..., 1] < MIN_HESSIAN)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)  # ties: the first feature, then the lowest cut
    return flat[np.arange(len(flat)), at], columns[at // gain.shape[2]], at % gain.shape[2]


def boost(model: Model, level_sums: Callable[[Model, list[Tree], int, int, list[np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Model:
    """Rounds until the patience or the rounds are spent.

    ``level_sums`` delivers the merged sums of those nodes of a level that have a slot.  Of two children only the smaller is
    summed: the other is the rest of its parent, exactly, since sums are whole numbers.
    """
    s = model.settings
    while True:
        round_ = len(model.rounds)
        trees = [Tree.empty(s.depth) for _ in range(model.classes)]
        rng = [np.random.default_rng([s.seed, round_, k]) for k in range(model.classes)]
        count = max(1, int(s.column_sample * len(model.features)))
        columns = [np.sort(r.permutation(len(model.features))[:count]) for r in rng]
        parents, slots = None, np.arange(model.classes)[:, None]
        for level in range(s.depth):
            if slots.max() < 0:
                break  # no node was split
            found, loss = level_sums(model, trees, level, round_, columns, slots)
            if level == 0:
                # The loss of the trees so far comes with the first pass of the next round.
                if loss[1]:
                    if len(model.losses) <= round_:
                        model.losses.append(loss[0] / loss[1] / UNIT)
                    model.best = int(np.argmin(model.losses))
                    stop = round_ - model.best >= s.patience
                else:
                    model.best, stop = round_, False
                if stop or round_ >= s.rounds:
                    return model
            first, nodes = (1 << level) - 1, 1 << level
            sums = np.zeros((model.classes, nodes, *found.shape[1:]), np.int64)
            for k, j in np.argwhere(slots >= 0):
                sums[k, j] = found[slots[k, j]]
                if level:
                    sums[k, j ^ 1] = parents[k, j >> 1] - sums[k, j]
            parents, slots, used = sums, np.full((model.classes, 2 * nodes), -1), 0
            for k, tree in enumerate(trees):
                gain, feature, cut = best_splits(sums[k], columns[k])
                total = sums[k][:, columns[k][0]].sum(axis=1) / UNIT  # (node, g / h): any feature holds all rows of a node
                weight = -s.step * total[:, 0] / (total[:, 1] + L2)
                split = gain > 1e-9
                if level == 0:
                    tree.value[0] = weight[0]
                for j in np.flatnonzero(split).tolist():
                    node = first + j
                    tree.feature[node], tree.cut[node], tree.gain[node] = feature[j], cut[j], gain[j]
                    low = sums[k][j, feature[j], : cut[j] + 1].sum(axis=0) / UNIT
                    for child, x in ((2 * node + 1, low), (2 * node + 2, total[j] - low)):
                        tree.value[child] = -s.step * x[0] / (x[1] + L2)
                    slots[k, 2 * j + int(low[1] > total[j, 1] - low[1])] = used
                    used += 1
        model.rounds.append(trees)


# ------------------------------------------------------------------ fit
def row_number(*keys: Column) -> Column:
    """The number by which a row is drawn into a round's sample."""
    return F.xxhash64(*keys)


def fit(
    rows: DataFrame, features: list[str], label: str = "label", held: str | None = None, key: list[str] | None = None,
    settings: Settings | None = None, resume: Model | None = None, local_rows: int = LOCAL_ROWS,
) -> Model:
    """Fit on the rows whose ``held`` column is not true; the others steer the early stop.

    ``key``: columns that tell rows apart (default: features and label), for the row sample.  ``resume``: a model on the same
    features; its bins and trees are kept and rounds are added.
    """
    spark = rows.sparkSession
    settings = settings or (resume.settings if resume else Settings())
    data = rows.select(
        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
        F.col(label).cast("int").alias("label"),
        (F.coalesce(F.col(held).cast("boolean"), F.lit(False)) if held else F.lit(False)).alias("held"),
        row_number(*[F.col(c) for c in (key or [*features, label])]).alias("salt"),
    ).where(F.col("label").isNotNull())
    path = scratch_path(spark, "boosting-rows")
    data.write.parquet(path)
    data = spark.read.schema(data.schema).parquet(path)
    names = [f"f{i}" for i in range(len(features))]
    edges = resume.edges if resume else bin_edges(data.where(~F.col("held")), names)
    model = Model(features, edges, settings=settings)
    if resume:
        model.rounds, model.losses = list(resume.rounds), list(resume.losses)
    total = data.count()
    if not total:
        return model
    packed = scratch_path(spark, "boosting-blocks")
    _pack(data, names, edges).write.parquet(packed)
    blocks = spark.read.schema("n int, bins binary, label binary, held binary, salt binary").parquet(packed)
    if total <= local_rows:
        return _fit_in_one_task(blocks, model)
    return _fit_on_cluster(blocks, model, total)


def _fit_in_one_task(blocks: DataFrame, model: Model) -> Model:
    start = to_json(model)

    def run(batches):
        block = _one([_unpack(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns))])
        fitted = from_json(start)
        state = {"block": block, "since": 0}

        def sums(m, trees, level, round_, columns, slots):
            if level == 0:
                state["block"], state["now"] = state["block"].begin(m.settings, m.rounds[state["since"] :], round_)
                state["since"] = len(m.rounds)
            return state["now"].sums(trees, level, columns, slots)

        yield pa.RecordBatch.from_arrays([pa.array([to_json(boost(fitted, sums))])], names=["model"])

    return from_json(blocks.coalesce(1).mapInArrow(run, "model string").first()["model"])


def _joined(rows) -> Iterator[Block]:
    """The blocks of a partition, put together to blocks of at least ``BLOCK_ROWS`` rows but the last."""
    held, n = [], 0
    for r in rows:
        held.append(_unpack(*r))
        n += r[0]
        if n >= BLOCK_ROWS:
            yield _one(held)
            held, n = [], 0
    if held:
        yield _one(held)


def _one(blocks: list[Block]) -> Block:
    return Block(*(np.concatenate(x, axis=-1) for x in zip(*((b.bins, b.label, b.held, b.salt, b.margin) for b in blocks))))


def _fit_on_cluster(blocks: DataFrame, model: Model, total: int) -> Model:
    """The same rounds with a level's sums merged from all tasks.

    A round's first pass keeps the round's gradients, and its other levels read nothing else; the rows themselves are
    written again only when they take new margins, every ``MOVE_EVERY`` rounds.
    """
    spark = blocks.sparkSession
    prepare(spark)
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    rows = blocks.repartition(tasks).rdd.mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)
    state = {"rows": rows, "now": None, "since": 0, "folded": 0}

    def sums(m, trees, level, round_, columns, slots):
        spent = []
        if level == 0:
            recent, settings = m.rounds[state["since"] :], m.settings
            if len(recent) >= MOVE_EVERY:
                spent.append(state["rows"])
                state["rows"] = _moved(state["rows"], recent)
                state["since"], recent = len(m.rounds), []
                if len(m.rounds) - state["folded"] >= FOLD_EVERY:
                    state["folded"] = len(m.rounds)
                    state["rows"].checkpoint()  # cuts the chain of rounds
            if state["now"] is not None:
                spent.append(state["now"])
            state["now"] = state["rows"].map(lambda b: b.begin(settings, recent, round_)[1]).persist(StorageLevel.MEMORY_AND_DISK)

        def part(rows):
            total = None
            for now in rows:
                found = now.sums(trees, level, columns, slots)
                total = found if total is None else (total[0] + found[0], total[1] + found[1])
            if total is not None:
                yield total

        def add(a, b):
            return a[0] + b[0], a[1] + b[1]

        partial = state["now"].mapPartitions(part)
        merged = partial.treeReduce(add, 2) if tasks > DIRECT_TASKS else partial.reduce(add)
        for old in spent:
            old.unpersist()
        return merged

    try:
        return boost(model, sums)
    finally:
        for held in (state["rows"], state["now"]):
            if held is not None:
                held.unpersist()


def _moved(rows: RDD, recent: list[list[Tree]]) -> RDD:
    """The blocks with the trees of ``recent`` in their margins."""
    return rows.map(lambda b: replace(b, margin=margins(recent, b.bins, b.margin))).persist(StorageLevel.MEMORY_AND_DISK)


# ------------------------------------------------------------------ use
def predict(model: Model, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every row with p_simple, p_moderate, p_complex of the best round (null labels and missing features included)."""
    columns = columns or model.features
    text, edges, used = to_json(model), model.edges, len(columns)
    rows = df.select(*[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(columns)], F.struct(*df.columns).alias("_row"))

    def run(batches):
        fitted = from_json(text)
        for b in batches:
            bins = np.stack([bin_column(b.column(i), edges[i]) for i in range(used)]) if b.num_rows else np.zeros((used, 0), np.uint8)
            p = softmax(margins(fitted.rounds[: fitted.best], bins)) if b.num_rows else np.zeros((fitted.classes, 0))
            yield pa.RecordBatch.from_arrays([b.column(used), *[pa.array(x) for x in p]], names=["_row", *(f"_p{k}" for k in range(len(p)))])

    schema = rows.select("_row").schema
    for k in range(model.classes):
        schema = schema.add(f"_p{k}", "double")
    out = rows.mapInArrow(run, schema)
    return out.select("_row.*", *[F.col(f"_p{k}").alias(f"p_{c}") for k, c in enumerate(C.CLASSES)])


def importance(model: Model) -> list[tuple[str, float]]:
    """Mean gain of each feature's splits in the rounds in use, normalised to sum 1, largest first."""
    gain, count = np.zeros(len(model.features)), np.zeros(len(model.features))
    for trees in model.rounds[: model.best]:
        for t in trees:
            split = t.feature >= 0
            np.add.at(gain, t.feature[split], t.gain[split])
            np.add.at(count, t.feature[split], 1)
    mean = gain / np.maximum(count, 1)
    share = mean / (mean.sum() or 1.0)
    return sorted(zip(model.features, share.tolist()), key=lambda x: (-x[1], x[0]))


def to_json(model: Model) -> str:
    def plain(t: Tree):
        return [t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.gain.tolist()]

    return json.dumps({
        "features": model.features, "edges": model.edges, "losses": model.losses, "best": model.best,
        "settings": asdict(model.settings), "rounds": [[plain(t) for t in trees] for trees in model.rounds],
    })


def from_json(text: str) -> Model:
    d = json.loads(text)
    rounds = [
        [Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(v), np.array(g)) for f, c, v, g in trees] for trees in d["rounds"]
    ]
    return Model(d["features"], d["edges"], rounds, d["losses"], d["best"], Settings(**d["settings"]))


def save(spark: SparkSession, model: Model, path: str) -> None:
    """One row of JSON; an earlier save is replaced."""
    spark.createDataFrame([(to_json(model),)], "model string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Model:
    return from_json(spark.read.text(path, wholetext=True).first()["value"].strip())
