"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters the network as a learned vector of the word plus the mean of learned vectors of its character
n-grams (hashed tables).  Two gated recurrent layers read each window of ``WINDOW`` words forwards and
backwards; attention weighs the states of the window, and a linear layer gives its log-odds.  Windows start
every ``STRIDE`` words, so they overlap and cover the whole text; a document's score is that of its most
toxic window.  Training, in numpy, is multiple-instance: the window that scores highest stands for its
document and is pushed towards the document's label.

The network is fitted on at most ``per_class`` labelled documents of each class, chosen by hash, and
``span_words`` words of each (from a hashed position); that bounded sample is collected.  Scoring runs on
the executors over whole texts.  Labels, language, source and id are not inputs.

Edge cases: texts that are null or without a word score 0; a null id counts as the empty text in the
hold-out rule; labels that are null or not 0 or 1 are not used; a document labelled both 0 and 1 counts as 1; if a
class has no usable row every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm import langid
from issuelens.llm.common import crc_mod, row_blocks, text_bytes

WINDOW = 32
STRIDE = 16
WORDS = 1 << 15
WIDTH = 12
HIDDEN = 8
BLOCK_BYTES = 1 << 20
LONGEST_WORD = 64
HOLD = 30.0  # update-gate input of a padding word: the state passes through unchanged

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(rng: np.random.Generator) -> Params:
    def draw(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"word": draw(WORDS, WIDTH, scale=0.1), "char": draw(langid.BUCKETS, WIDTH, scale=0.1)}
    for d in ("f", "b"):
        p[f"x{d}"] = draw(WIDTH, 3 * HIDDEN, scale=0.3)
        p[f"h{d}"] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p["look"] = draw(2 * HIDDEN, scale=0.3)
    p["out"] = draw(2 * HIDDEN, scale=0.3)
    p["bias"] = np.zeros(1, np.float32)
    return p


class Inputs:
    """Vectors of distinct words, kept with what the gradient needs."""

    def __init__(self, words: list[bytes]):
        self.slots = np.array([hash_word(w) for w in words], np.int64)
        self.features = langid.word_features(words, {})
        used = (self.features.index > 0).astype(np.float32)
        self.share = used / np.maximum(np.repeat(np.add.reduceat(used, self.features.starts), self.features.count()), 1)

    def vectors(self, p: Params) -> np.ndarray:
        chars = p["char"][self.features.index] * self.share[:, None]
        return p["word"][self.slots] + np.add.reduceat(chars, self.features.starts, axis=0)

    def gradient(self, d: np.ndarray, grads: Params) -> None:
        grads["word"] = scatter(self.slots, d, WORDS)
        spread = np.repeat(d, self.features.count(), axis=0) * self.share[:, None]
        grads["char"] = scatter(self.features.index, spread, langid.BUCKETS)


def word_vectors(words: list[bytes], p: Params, step: int = 16384) -> np.ndarray:
    """Vectors of many words, ``step`` at a time: the n-grams of all of them never lie in memory together."""
    parts = [Inputs(words[a : a + step]).vectors(p) for a in range(0, len(words), step)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def scatter(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], size) for j in range(values.shape[1])], 1).astype(np.float32)


def hash_word(word: bytes) -> int:
    import zlib

    return zlib.crc32(word) % WORDS


def gate_table(vectors: np.ndarray, p: Params, way: str) -> np.ndarray:
    """Gate inputs of every distinct word, and of the padding word in the last row."""
    table = np.empty((len(vectors) + 1, 3 * HIDDEN), np.float32)
    table[:-1] = vectors @ p[f"x{way}"] + p[f"c{way}"]
    table[-1] = 0
    table[-1, :HIDDEN] = HOLD
    return table


def recur(table: np.ndarray, ids: np.ndarray, weights: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """States (time, window, hidden) of one direction over word numbers ``ids`` (time, window)."""
    steps, n = ids.shape
    states = np.empty((steps, n, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        x = table[ids[t]]
        u = h @ weights
        g = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        if trace is not None:
            trace.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
        h = c + z * (h - c)
        states[t] = h
    return states


def window_scores(tables, ids: np.ndarray, p: Params) -> np.ndarray:
    """Log-odds of windows; padding is the last row of the tables."""
    pad = len(tables[0]) - 1
    forward = recur(tables[0], ids, p["hf"], False)
    backward = recur(tables[1], ids, p["hb"], True)
    look = forward @ p["look"][:HIDDEN] + backward @ p["look"][HIDDEN:]
    look[ids == pad] = -1e9
    look = np.exp(look - look.max(axis=0))
    value = forward @ p["out"][:HIDDEN] + backward @ p["out"][HIDDEN:]
    return (look * value).sum(axis=0) / look.sum(axis=0) + p["bias"][0]


def gradients(inputs: Inputs, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray, p: Params) -> Params:
    """Gradient of the weighted log loss of windows ``ids`` (time, window) with document labels."""
    vectors = inputs.vectors(p)
    tables = [gate_table(vectors, p, "f"), gate_table(vectors, p, "b")]
    pad = len(vectors)
    traces: list[list] = [[], []]
    states = [recur(tables[0], ids, p["hf"], False, traces[0]), recur(tables[1], ids, p["hb"], True, traces[1])]
    both = np.concatenate(states, axis=2)
    look = both @ p["look"]
    look[ids == pad] = -1e9
    att = np.exp(look - look.max(axis=0))
    att /= att.sum(axis=0)
    value = both @ p["out"]
    mean = (att * value).sum(axis=0)
    d = (sigmoid(mean + p["bias"][0]) - labels) * weight
    grads: Params = {"bias": np.array([d.sum()], np.float32)}
    d_value = att * d
    d_look = att * (value - mean) * d
    grads["out"] = np.einsum("tn,tnh->h", d_value, both)
    grads["look"] = np.einsum("tn,tnh->h", d_look, both)
    d_both = d_value[:, :, None] * p["out"] + d_look[:, :, None] * p["look"]
    d_vectors = np.zeros_like(vectors)
    for k, way in enumerate("fb"):
        weights, d_states = p[f"h{way}"], d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_weights = np.zeros_like(weights)
        d_table = np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32)
        carried = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, z, r, c, uc in reversed(traces[k]):
            dh = d_states[t] + carried
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            d_rec = np.concatenate([dz, dr, dc * r], axis=1)
            carried = dh * z + d_rec @ weights.T
            d_weights += h.T @ d_rec
            np.add.at(d_table, ids[t], np.concatenate([dz, dr, dc], axis=1))
        real = d_table[:-1]
        grads[f"h{way}"], grads[f"x{way}"], grads[f"c{way}"] = d_weights, vectors.T @ real, real.sum(axis=0)
        d_vectors += real @ p[f"x{way}"].T
    inputs.gradient(d_vectors, grads)
    return grads


def cut_windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of texts with ``sizes`` words: owner, first word (in the text), length."""
    count = np.where(sizes > 0, np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return owner, first, np.minimum(WINDOW, sizes[owner] - first)


def encode(texts: list[bytes], place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of all texts in turn (new words enter ``place``), each text's number of words."""
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = langid.tokens(text)
        sizes[i] = len(words)
        ids.extend([place.setdefault(w, len(place)) for w in words])
    return np.array(ids, np.int64), sizes


def lay_out(flat: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (window, time) with padding, and each window's text."""
    owner, first, length = cut_windows(sizes)
    at = ((np.cumsum(sizes) - sizes)[owner] + first)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, pad), owner


class Scorer:
    """Scores texts; gate inputs of words seen before are kept, up to ``limit`` words."""

    def __init__(self, p: Params, limit: int = 250_000):
        self.p, self.limit = p, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.tables = [np.zeros((0, 3 * HIDDEN), np.float32)] * 2

    def __call__(self, texts: list[bytes], step: int = 1024) -> np.ndarray:
        """Probability of toxicity of each text: that of its highest window."""
        if len(self.place) > self.limit:
            self.clear()
        known = len(self.place)
        flat, sizes = encode(texts, self.place)
        best = np.full(len(texts), -np.inf)
        if len(flat):
            new = list(itertools.islice(self.place, known, None))
            vectors = word_vectors(new, self.p)
            self.tables = [
                np.concatenate([old[:known], gate_table(vectors, self.p, way)]) for old, way in zip(self.tables, "fb")
            ]
            windows, owner = lay_out(flat, sizes, len(self.place))
            for a in range(0, len(windows), step):
                np.maximum.at(best, owner[a : a + step], window_scores(self.tables, windows[a : a + step].T, self.p))
        return sigmoid(np.maximum(best, -700).astype(np.float64)) * (sizes > 0)


def train(samples: list[tuple[int, bytes]], rounds: int = 6, batch: int = 128, steps: int = 96, seed: int = 3) -> Params:
    """Fit on (label, text) pairs by Adam; in each round the highest window of a text stands for it.

    Few pairs make few steps a round; they get more rounds, ``steps`` steps at least.
    """
    rng = np.random.default_rng(seed)
    p = initial(rng)
    labels = np.array([y for y, _ in samples], np.float32)
    place: dict[bytes, int] = {}
    flat, sizes = encode([t for _, t in samples], place)
    words = list(place)
    windows, owner = lay_out(flat, sizes, len(words))
    # A first guess for one entry of each word's vector: how much likelier toxic texts are to hold it.
    doc = np.repeat(np.arange(len(sizes)), sizes)
    slots = np.array([hash_word(w) for w in words], np.int64)
    holder, slot = np.divmod(np.unique(doc * WORDS + slots[flat]), WORDS)
    toxic = np.bincount(slot, labels[holder], WORDS)
    clean = np.bincount(slot, 1 - labels[holder], WORDS)
    odds = np.log((toxic + 0.5) / (labels.sum() + 1)) - np.log((clean + 0.5) / ((1 - labels).sum() + 1))
    p["word"][:, 0] += np.where(toxic + clean >= 5, np.clip(odds, -2, 4), 0) / 2
    moment = {k: np.zeros_like(v) for k, v in p.items()}
    spread = {k: np.zeros_like(v) for k, v in p.items()}
    per_class = len(labels) / np.maximum(2 * np.bincount(labels.astype(int), minlength=2), 1)
    done = 0
    for _ in range(max(rounds, -(-steps // max(1, -(-len(samples) // batch))))):
        vectors = word_vectors(words, p)
        tables = [gate_table(vectors, p, "f"), gate_table(vectors, p, "b")]
        level = np.concatenate([window_scores(tables, windows[a : a + 4096].T, p) for a in range(0, len(windows), 4096)])
        order = np.lexsort((-level, owner))
        head = order[np.concatenate(([True], np.diff(owner[order]) > 0))]
        head = head[rng.permutation(len(head))]
        for a in range(0, len(head), batch):
            own = head[a : a + batch]
            ids = windows[own]
            distinct, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            real = distinct[distinct < len(words)]
            y = labels[owner[own]]
            grads = gradients(Inputs([words[i] for i in real]), local.T, y, per_class[y.astype(int)].astype(np.float32) / len(own), p)
            done += 1
            for k, g in grads.items():
                moment[k] += 0.1 * (g - moment[k])
                spread[k] += 0.001 * (g * g - spread[k])
                p[k] -= 0.01 * (moment[k] / (1 - 0.9**done)) / (np.sqrt(spread[k] / (1 - 0.999**done)) + 1e-8)
    return p


def training_sample(docs, labels, id_col, text_col, label_col, usable, per_class, span_words) -> list[tuple[int, bytes]]:
    """One span of ``span_words`` words of each of ``per_class`` hashed documents a class; words of over ``LONGEST_WORD`` bytes are
    left out of it."""
    # First within 64 parts of a class, so that no task gets the candidates of all tasks.
    part = F.row_number().over(Window.partitionBy("y", F.pmod("pick", F.lit(64))).orderBy("pick", "id"))
    rank = F.row_number().over(Window.partitionBy("y").orderBy("pick", "id"))
    ids = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .where(usable(F.col("id")))
        .withColumn("pick", F.xxhash64("id"))
        .withColumn("part", part)
        .where(F.col("part") <= per_class)
        .withColumn("rank", rank)
        .where(F.col("rank") <= per_class)
        .select("id", "y", "pick")
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(ids), "id").select("pick", "y", "text")  # two classes of per_class ids at most

    def cut(batches):
        for b in batches:
            spans = []
            for pick, text in zip(b.column(0).to_pylist(), text_bytes(b.column(2))):
                words = text.split()
                start = pick % max(1, len(words) - span_words + 1)
                spans.append(b" ".join(w for w in words[start : start + span_words] if len(w) <= LONGEST_WORD))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], names=["pick", "y", "span"])

    spans = chosen.mapInArrow(cut, "pick long, y int, span binary")
    rows = spans.groupBy("pick", "y").agg(F.min("span").alias("span")).collect()  # one span a document
    return [(r.y, bytes(r.span)) for r in sorted(rows, key=lambda r: (r.pick, bytes(r.span)))]


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = 0.7,
    per_class: int = 1000,
    span_words: int = 4000,
) -> DataFrame:
    """Rows (id, held_out, score, predicted): one per row of ``docs``."""

    def usable(c):
        return crc_mod(c, folds) != held_fold

    samples = training_sample(docs, labels, id_col, text_col, label_col, usable, per_class, span_words)
    fitted = len({y for y, t in samples if t.split()}) == 2
    model = docs.sparkSession.sparkContext.broadcast(train(samples) if fitted else None)  # tables of fixed size
    rows = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.col(id_col).alias("id"),
        (crc_mod(F.col(id_col), folds) == held_fold).alias("held_out"),
    )

    def run(batches):
        scorer = Scorer(model.value) if model.value else None
        for b in batches:
            texts = text_bytes(b.column(0))
            found = [scorer(texts[a:z]) if scorer else np.zeros(z - a) for a, z in row_blocks(texts, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(np.concatenate(found) if found else [], pa.float64())], names=["id", "held_out", "score"]
            )

    out = rows.mapInArrow(run, rows.drop("text").schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
