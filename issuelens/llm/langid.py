"""Language identification with a linear-chain conditional random field over words.

Every word gets a language label; emissions come from hashed byte n-grams of the word with its borders
(those that touch a border are its affixes) and from a lexicon of the most frequent words, transitions are
learned, and forward-backward gives each word's label distribution, so code-switched text is labelled word
by word.  A document's language is the one with the largest sum of word probabilities.

Training takes ``per_language`` labelled documents of each language, chosen by hash (100 languages at most), and a span of
``span_words`` words of each (from a hashed position); spans of different languages are joined into
code-switched sequences, so the transitions see switches.  That bounded sample is collected; scoring runs
on the executors over whole texts, in sequences of ``SEQUENCE`` words.

Edge cases: a text that is null or has no letter is ``und`` with score 0; ties take the first language in code
point order; a null id counts as the empty text in the hold-out rule; without any labelled row every text
is ``und``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import crc_mod, row_blocks, text_bytes

BUCKETS = 1 << 17
GRAMS = (2, 3, 4)
SEQUENCE = 128
LONGEST_WORD = 64
BLOCK_BYTES = 1 << 21
UND = "und"

#: ASCII bytes that are not letters become blanks; bytes of other letters stay.
_KEEP = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and of non-ASCII characters."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_KEEP).lower().split()


def has_letter(text: bytes) -> bool:
    if any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or text.upper() != text.lower():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclasses.dataclass
class Features:
    """Hashed n-grams of distinct words: feature numbers, and where each word's features start."""

    index: np.ndarray
    starts: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.index)))


def word_features(words: list[bytes], lexicon: dict[bytes, int]) -> Features:
    """Byte n-grams of `` word `` with its blanks, and one feature for a word of the lexicon."""
    buffer = np.frombuffer(b" " + b" ".join(words) + b"    ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    heads = np.cumsum(lengths + 1) - (lengths + 1)  # the blank before each word
    size = int(lengths.sum()) + len(words)
    blank = buffer == 32
    code = buffer.astype(np.uint64)
    rolling = code[:size].copy()
    rows = np.zeros((len(GRAMS) + 1, size), np.int64)
    inner = np.zeros(size, bool)
    step = 1
    for row, n in enumerate(GRAMS):
        while step < n:
            rolling = rolling * np.uint64(0x9E3779B1) + code[step : step + size]
            if step > 1:
                inner |= blank[step - 1 : step - 1 + size]
            step += 1
        mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1
        rows[row] = np.where(inner, 0, slot)  # feature 0 has no weight
    get = lexicon.get
    rows[-1, heads] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    return Features(rows.T.reshape(-1), heads * (len(GRAMS) + 1))


def emissions(words: list[bytes], model: "Model") -> np.ndarray:
    """Log potentials (word, language) of distinct words."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    for a in range(0, len(words), 1 << 16):
        part = words[a : a + (1 << 16)]
        f = word_features(part, model.lexicon)
        out[a : a + len(part)] = np.add.reduceat(model.weights[f.index], f.starts, axis=0)
    return out


@dataclasses.dataclass
class Model:
    languages: list[str]
    lexicon: dict[bytes, int]
    weights: np.ndarray  # (features, languages); feature 0 is zero
    transitions: np.ndarray  # (from, to), log potentials

    @property
    def features(self) -> int:
        return BUCKETS + len(self.lexicon)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray):
    """Label distributions of padded sequences, and expected transition counts.

    ``scores`` is (time, sequence, label), sequences sorted by falling length; padding is left zero.
    """
    steps, n, labels = scores.shape
    alive = (lengths[None, :] > np.arange(steps)[:, None]).sum(axis=1)
    best = scores.max(axis=2, keepdims=True)
    potential = np.exp(scores - best)
    top = transitions.max()
    move = np.exp(transitions - top)
    alpha = np.zeros_like(potential)
    beta = np.ones_like(potential)
    a = potential[0] / potential[0].sum(axis=1, keepdims=True)
    alpha[0] = a
    for t in range(1, steps):
        k = alive[t]
        a = (a[:k] @ move) * potential[t, :k]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t, :k] = a
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        b = (potential[t + 1, :k] * beta[t + 1, :k]) @ move.T
        beta[t, :k] = b / b.sum(axis=1, keepdims=True)
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=2, keepdims=True), 1e-30)
    return marginal, alpha, beta, potential, move, alive


def expected_moves(alpha, beta, potential, move, alive) -> np.ndarray:
    total = np.zeros_like(move)
    for t in range(1, len(alpha)):
        k = alive[t]
        joint = alpha[t - 1, :k, :, None] * move[None] * (potential[t, :k] * beta[t, :k])[:, None, :]
        total += (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
    return total


def train(samples: list[tuple[str, bytes]], epochs: int = 4, seed: int = 7, lexicon_size: int = 400) -> Model:
    """Fit by AdaGrad on the conditional log-likelihood of code-switched sequences of the samples."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    number = {lang: i for i, lang in enumerate(languages)}
    spans = [(number[lang], words) for lang, text in samples if (words := tokens(text))]
    lexicon: dict[bytes, int] = {}
    for label in range(len(languages)):
        seen: dict[bytes, int] = {}
        for own, words in spans:
            if own == label:
                for w in words:
                    seen[w] = seen.get(w, 0) + 1
        for w in sorted(seen, key=lambda w: (-seen[w], w))[:lexicon_size]:
            if seen[w] > 1:
                lexicon.setdefault(w, BUCKETS + len(lexicon))
    model = Model(languages, lexicon, np.zeros((BUCKETS + len(lexicon), len(languages)), np.float32), np.zeros((len(languages),) * 2, np.float32))
    sum_w, sum_t = np.full(model.weights.shape, 1e-2, np.float32), np.full(model.transitions.shape, 1e-2, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        chunks, at = [], 0
        while at < len(order):  # one to four spans in a sequence, cut into pieces of one to sixteen words
            pieces = [spans[i] for i in order[at : at + int(rng.integers(1, 5))]]
            at += len(pieces)
            sequence = []
            for label, words in pieces:
                cut = int(rng.integers(1, 17)) if len(pieces) > 1 else len(words)
                sequence.append((label, words[:cut], words[cut:]))
            chunks.append([(la, w) for la, h, t in sequence for w in h] + [(la, w) for la, h, t in sequence for w in t])
        for a in range(0, len(chunks), 64):
            pieces = [c[k : k + SEQUENCE] for c in chunks[a : a + 64] for k in range(0, len(c), SEQUENCE)]
            batch = sorted(pieces, key=len, reverse=True)
            flat = [w for c in batch for _, w in c]
            distinct = sorted(set(flat))
            place = {w: i for i, w in enumerate(distinct)}
            f = word_features(distinct, lexicon)
            score = np.add.reduceat(model.weights[f.index], f.starts, axis=0)
            lengths = np.array([len(c) for c in batch])
            padded = np.zeros((lengths[0], len(batch), len(languages)), np.float32)
            truth = np.zeros_like(padded)
            ids = np.array([place[w] for w in flat])
            gold = np.array([la for c in batch for la, _ in c])
            row = np.repeat(np.arange(len(batch)), lengths)
            time = np.concatenate([np.arange(n) for n in lengths])
            padded[time, row] = score[ids]
            truth[time, row, gold] = 1
            marginal, alpha, beta, potential, move, alive = forward_backward(padded, lengths, model.transitions)
            diff = (truth - marginal)[time, row]
            per_word = np.zeros((len(distinct), len(languages)), np.float32)
            np.add.at(per_word, ids, diff)
            spread = np.repeat(per_word, f.count(), axis=0)
            used = f.index > 0
            grad = np.stack([np.bincount(f.index[used], spread[used, j], model.features) for j in range(len(languages))], 1).astype(np.float32)
            grad -= 1e-3 * model.weights
            pairs = np.zeros_like(model.transitions)
            same = row[1:] == row[:-1]
            np.add.at(pairs, (gold[:-1][same], gold[1:][same]), 1)
            move_grad = pairs - expected_moves(alpha, beta, potential, move, alive)
            sum_w += grad**2
            sum_t += move_grad**2
            model.weights += 0.2 * grad / np.sqrt(sum_w)
            model.transitions += 0.2 * move_grad / np.sqrt(sum_t)
    return model


def label_words(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Word label distributions of all texts in turn, and each text's number of words."""
    place: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = tokens(text)
        sizes[i] = len(words)
        ids.extend([place.setdefault(w, len(place)) for w in words])
    flat = np.array(ids, np.int64)
    if not len(flat):
        return np.zeros((0, len(model.languages)), np.float32), sizes
    scores = emissions(list(place), model)
    # Sequences: SEQUENCE words of one text each, the last one shorter.
    pieces = -(-sizes // SEQUENCE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lengths = np.minimum(SEQUENCE, sizes[owner] - nth * SEQUENCE)
    starts = (np.cumsum(sizes) - sizes)[owner] + nth * SEQUENCE
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(flat), len(model.languages)), np.float32)
    for a in range(0, len(order), 4096):
        own = order[a : a + 4096]
        size = lengths[own]
        row = np.repeat(np.arange(len(own)), size)
        time = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        at = starts[own][row] + time
        padded = np.zeros((size[0], len(own), len(model.languages)), np.float32)
        padded[time, row] = scores[flat[at]]
        out[at] = forward_backward(padded, size, model.transitions)[0][time, row]
    return out, sizes


def predict(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    marginal, sizes = label_words(texts, model)
    owner = np.repeat(np.arange(len(texts)), sizes)
    total = np.stack([np.bincount(owner, marginal[:, j], len(texts)) for j in range(len(model.languages))], axis=1)
    best = total.argmax(axis=1)
    share = total[np.arange(len(texts)), best] / np.maximum(total.sum(axis=1), 1e-30)
    known = np.array([n > 0 and has_letter(t) for t, n in zip(texts, sizes)], bool)
    return [model.languages[b] if k else UND for b, k in zip(best, known)], np.where(known, np.clip(share, 0, 1), 0.0)


def training_sample(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, per_language: int, span_words: int
) -> list[tuple[str, bytes]]:
    """Spans of ``per_language`` hashed documents per language, one a document: at most ``span_words`` words of each leave the
    executors, and none of over ``LONGEST_WORD`` bytes.  Rows that share an id count once."""
    # First within 64 parts of a language, so that no task gets the candidates of all tasks.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod("pick", F.lit(64))).orderBy("pick", "id"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick", "id"))
    ids = (
        docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"))
        .distinct()
        .withColumn("pick", F.xxhash64("id"))
        .withColumn("part", part)
        .where(F.col("part") <= per_language)
        .withColumn("rank", rank)
        .where(F.col("rank") <= per_language)
        .select("id", "lang", "pick")
    )
    texts = docs.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("l"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(ids), texts.id.eqNullSafe(ids.id) & (texts.l == ids.lang)).select("pick", "lang", "text")

    def cut(batches):
        for b in batches:
            spans = []
            for pick, text in zip(b.column(0).to_pylist(), text_bytes(b.column(2))):
                words = text.split()
                start = pick % max(1, len(words) - span_words + 1)
                spans.append(b" ".join(w for w in words[start : start + span_words] if len(w) <= LONGEST_WORD))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.binary())], names=["pick", "lang", "span"])

    spans = chosen.mapInArrow(cut, "pick long, lang string, span binary")
    rows = spans.groupBy("pick", "lang").agg(F.min("span").alias("span")).collect()
    return [(r.lang, bytes(r.span)) for r in sorted(rows, key=lambda r: (r.lang, r.pick, bytes(r.span)))]


def detect(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    held_fold: int = 0,
    per_language: int = 800,
    span_words: int = 64,
    train_on: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows (id, held_out, lang_pred, score), and the columns ``keep`` of ``docs`` as they are.

    Documents whose crc32(id) mod ``folds`` is ``held_fold`` are never trained on.
    """
    source = docs if train_on is None else train_on
    usable = crc_mod(F.col(id_col), folds) != held_fold
    samples = training_sample(source, id_col, text_col, lang_col, usable, per_language, span_words)
    model = train(samples) if samples else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS + lexicon rows
    keep = keep or []
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"),
        F.col(id_col).alias("id"),
        (crc_mod(F.col(id_col), folds) == held_fold).alias("held_out"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )

    def run(batches):
        fitted = shared.value
        for b in batches:
            texts = text_bytes(b.column(0))
            langs, scores = [], []
            for a, z in row_blocks(texts, BLOCK_BYTES):
                part = texts[a:z]
                found = predict(part, fitted) if fitted else ([UND] * len(part), np.zeros(len(part)))
                langs += found[0]
                scores.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*b.schema.names[1:], "lang_pred", "score"],
            )

    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    out = rows.mapInArrow(run, schema)
    return out.select("id", "held_out", "lang_pred", "score", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
