"""Line dedup with a log-template tree.

Every line of every document (cut at newlines) goes down a tree of fixed depth: number of tokens, then the leading ``DEPTH``
tokens.  In a line with at least ``MIN_FIXED`` tokens without a digit, more than half of all, tokens with a digit
count as a variable ``<*>``; any other line, such as a row of numbers, stands for itself alone.  Lines of one token or without a
letter (brackets, rules, single numbers) are left alone: they recur by chance in clean documents.  Lines
of at least ``MIN_TOKENS`` tokens are looked up by keys that leave out positions while ``SIMILARITY`` of the tokens
stay: every combination of up to ``MOST_LEFT`` of ``BLOCKS`` blocks of positions and, for more fields, the positions
of most different tokens in the leaf, one more at a time.  What stays under such a key is a template when lines of
``min_docs`` documents have it.  So a leaf holds any number of
templates, and a line all that cover it; those of the blocks depend on no other line of the leaf.  A line is dropped from every
document but the smallest that any of its templates has, so no line need choose the template its neighbours choose, and
of lines that templates link, the first one stays.  Lines without a template recur exactly: in ``LONG_MIN_DOCS`` documents if they
have ``MIN_TOKENS`` words, else in ``min_docs``; the document with the smallest id keeps its own.

The result depends on no order.  Only hashes, ids and distinct lines of shared leaves are shuffled by leaf;
all counts are pre-aggregated, so a line or leaf that a third of all documents share meets in one row per
task.  Leaf numbers, lines and templates are compared by 64-bit hashes.

Edge cases: null texts stay null and have no lines; a null id stands for one document after all others;
rows with equal ids are one document; an empty table gives no rows; other columns pass through by the caller's
choice (``keep``).
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import PRIME, signed, stage, text_bytes

DEPTH = 3
MIN_TOKENS = 6
SIMILARITY = 0.7
MIN_DOCS = 3
#: Documents that an exact line of at least MIN_TOKENS words needs; shorter ones and templates may meet by chance.
LONG_MIN_DOCS = 2
#: Lines are cut into at most BLOCKS blocks behind the leading tokens; templates leave out up to MOST_LEFT of them.
BLOCKS = 10
MOST_LEFT = 3
#: Tokens without a digit that a line needs for its numbers to be variables.
MIN_FIXED = 2
VARIABLE = b"<*>"
NO_ID = (1 << 63) - 1
_DIGIT = re.compile(rb"[0-9]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line, numbers as the variable mark where enough of it is fixed; none if the line is left alone."""
    tokens = line.split()
    if len(tokens) < 2 or not _LETTER.search(line):
        return []
    if _DIGIT.search(line):
        marked = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
        fixed = len(marked) - marked.count(VARIABLE)
        if fixed >= MIN_FIXED and 2 * fixed > len(marked):
            return marked
    return tokens


def line_key(tokens: list[bytes]) -> int:
    return signed(b" ".join(tokens))


def leaf_key(tokens: list[bytes]) -> int:
    return signed(b"%d " % len(tokens) + b" ".join(tokens[:DEPTH]))


def _ids(docs: DataFrame, id_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, leaf, line, words, new): one per distinct line of a row; words are its tokens without a digit, new is 1
    at a leaf's first line in the row."""

    def run(batches):
        for b in batches:
            ids, leaves, keys, words, new = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                seen_leaves, seen = set(), set()
                for line in text.split(b"\n"):
                    tokens = masked(line)
                    if tokens and (key := line_key(tokens)) not in seen:
                        seen.add(key)
                        leaf = leaf_key(tokens)
                        ids.append(i)
                        keys.append(key)
                        words.append(len(tokens) - tokens.count(VARIABLE))
                        new.append(int(leaf not in seen_leaves))
                        leaves.append(leaf)
                        seen_leaves.add(leaf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(leaves, pa.int64()), pa.array(keys, pa.int64()),
                 pa.array(words, pa.int32()), pa.array(new, pa.int32())],
                names=["id", "leaf", "line", "words", "new"],
            )

    rows = docs.select(_ids(docs, id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, leaf long, line long, words int, new int")


def line_tokens(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (leaf, line, ids, tokens): hashed tokens of the lines that ``wanted`` (line, ids) names, if ``MIN_TOKENS`` long."""
    lists = wanted.groupBy(F.array_min("ids").alias("wid")).agg(F.collect_list(F.struct("line", "ids")).alias("lines"))
    rows = docs.select(_ids(docs, id_col), F.col(text_col).cast("string").alias("text"))
    # Both sides are exchanged at any size, as on large tables.
    joined = rows.join(lists.hint("merge"), F.col("id") == F.col("wid")).select("lines", "text")

    def run(batches):
        for b in batches:
            leaves, keys, ids, tokens_of = [], [], [], []
            for want, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                want = {w["line"]: w["ids"] for w in want}
                for line in text.split(b"\n"):
                    tokens = masked(line)
                    if len(tokens) >= MIN_TOKENS and (key := line_key(tokens)) in want:
                        ids.append(want.pop(key))
                        leaves.append(leaf_key(tokens))
                        keys.append(key)
                        tokens_of.append([signed(t) for t in tokens])
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves, pa.int64()), pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(tokens_of, pa.list_(pa.int64()))],
                names=["leaf", "line", "ids", "tokens"],
            )

    return joined.mapInArrow(run, "leaf long, line long, ids array<long>, tokens array<long>").dropDuplicates(["leaf", "line"])


def may_vary(n: int) -> int:
    """How many of ``n`` tokens a template may leave out."""
    return n - math.ceil(SIMILARITY * n - 1e-9)


@functools.lru_cache(1024)
def left_out(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sets): first positions of the blocks of a line of ``n`` tokens, and one row of 0/1 per set of blocks."""
    size = -(-(n - DEPTH) // BLOCKS)
    starts = np.arange(DEPTH, n, size)
    count = min(MOST_LEFT, may_vary(n) // size, len(starts))
    sets = [[b in chosen for b in range(len(starts))] for chosen in itertools.combinations(range(len(starts)), count)]
    return starts, np.array(sets, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def candidate_keys(tokens: np.ndarray, leaf: int, uneven: list[int]) -> np.ndarray:
    """Hashes of what stays of a line, one for each set of positions that may be left out.

    The sets are the combinations of blocks and, of the positions ``uneven`` of the leaf, the first one, two, ... .
    """
    n = len(tokens)
    at = mixed((np.arange(n, dtype=np.uint64) + np.uint64(1)) * PRIME)
    each = mixed(tokens.view(np.uint64) ^ at)
    whole = each.sum(dtype=np.uint64)
    starts, sets = left_out(n)
    names = np.add.reduceat(at, starts)
    kept, which = whole - sets @ np.add.reduceat(each, starts), sets @ names
    first = np.array(uneven[: may_vary(n)], np.int64)
    kept = np.concatenate([kept, whole - np.cumsum(each[first], dtype=np.uint64)])
    which = np.concatenate([which, np.cumsum(at[first], dtype=np.uint64)])
    seed = np.array([leaf], np.int64).view(np.uint64)
    return np.unique(mixed(mixed(kept ^ seed) + mixed(which))).view(np.int64)


def generalised(tokens: DataFrame, min_docs: int) -> DataFrame:
    """Rows (line, first): the lines that templates of ``min_docs`` documents cover, and the smallest document of these templates.

    ``tokens`` are distinct lines with their up to ``min_docs`` smallest ids, which tell whether that many documents hold
    one of a template's lines, and which is the first.
    """
    spread = (
        tokens.select("leaf", F.posexplode("tokens").alias("pos", "token"))
        .groupBy("leaf", "pos", "token")
        .agg(F.lit(1).alias("one"))
        .groupBy("leaf", "pos")
        .agg(F.count("one").alias("kinds"))
        .where("kinds > 1")
    )
    uneven = spread.groupBy("leaf").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("kinds")).alias("k"), "pos"))), lambda x: x["pos"]).alias("uneven")
    )
    joined = tokens.join(stage(uneven, "lines-uneven"), "leaf").select("leaf", "line", "tokens", "uneven", "ids")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                found = [
                    candidate_keys(np.array(t, np.int64), leaf, u)
                    for leaf, t, u in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())
                ]
                row = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(pa.array(row)), pa.array(np.concatenate(found)), part.column(4).take(pa.array(row))],
                    names=["line", "key", "ids"],
                )

    keyed = stage(joined.mapInArrow(run, "line long, key long, ids array<long>"), "lines-keys")
    recur = (
        keyed.select("key", F.explode("ids").alias("id")).distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"))
        .where(F.col("docs") >= min_docs).select("key", "first")
    )
    found = keyed.select("line", "key").join(stage(recur, "lines-recurring"), "key")
    return found.groupBy("line").agg(F.min("first").alias("first"))


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (id, line, words, first): the lines of shared leaves and, where templates cover them, the smallest document of these."""
    every = stage(lines(docs, id_col, text_col), "lines")
    # Staged, so that both sides of the join are exchanged and a hot leaf's rows can be split.
    shared = every.groupBy("leaf").agg(F.sum("new").alias("docs")).where(F.col("docs") >= min(min_docs, LONG_MIN_DOCS))
    shared = stage(shared.select("leaf", (F.col("docs") >= min_docs).alias("enough")), "lines-leaves")
    near = stage(every.join(shared, "leaf").select("id", "leaf", "line", "words", "enough"), "lines-shared")
    by_id = Window.partitionBy("leaf", "line").orderBy("id")
    held = near.where("enough").select("id", "leaf", "line").distinct().withColumn("rank", F.row_number().over(by_id))
    held = held.where(F.col("rank") <= min_docs).groupBy("leaf", "line").agg(F.collect_list("id").alias("ids"))
    tokens = stage(line_tokens(docs, held, id_col, text_col), "lines-tokens")
    found = stage(generalised(tokens, min_docs), "lines-generalised")
    return near.join(found, "line", "left").select("id", "line", "words", "first")


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows (id, lines): the lines (hashes) to drop from each document that has any."""
    named = stage(shared_lines(docs, id_col, text_col, min_docs), "lines-templates")
    alone = named.where("first IS NULL")
    need = F.when(F.col("words") >= MIN_TOKENS, F.lit(min(min_docs, LONG_MIN_DOCS))).otherwise(F.lit(min_docs))
    often = (
        alone.select("line", "id", need.alias("need")).distinct().groupBy("line")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("holder"), F.max("need").alias("need"))
        .where(F.col("docs") >= F.col("need"))
        .select("line", "holder")
    )
    exact = alone.join(often, "line").where(F.col("id") != F.col("holder")).select("id", "line")
    covered = named.where(F.col("id") > F.col("first")).select("id", "line")
    return covered.unionByName(exact).groupBy("id").agg(F.collect_set("line").alias("lines"))


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, min_docs: int = MIN_DOCS
) -> DataFrame:
    """Every row of ``docs`` as (id, text, n_lines, n_dropped) and the columns ``keep``: text without recurring lines."""
    keep = keep or []
    drops = recurring(docs, id_col, text_col, min_docs).withColumnRenamed("id", "did")
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"),
        F.col(id_col).alias("id"),
        _ids(docs, id_col).alias("_id"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    joined = rows.join(drops.hint("merge"), F.col("_id") == F.col("did"), "left").select(
        "lines", "_text", "id", *[f"_keep_{i}" for i in range(len(keep))]
    )

    def run(batches):
        for b in batches:
            texts, counts, dropped = [], [], []
            for out, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                left = cut = 0
                if text is not None:
                    parts = text.split(b"\n")
                    if out:
                        out = set(out)
                        kept = [p for p in parts if not ((t := masked(p)) and line_key(t) in out)]
                        left, cut = len(parts), len(parts) - len(kept)
                        text = b"\n".join(kept)
                    else:
                        left = len(parts)
                texts.append(text)
                counts.append(left)
                dropped.append(cut)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*b.schema.names[2:], "text", "n_lines", "n_dropped"],
            )

    schema = joined.drop("lines", "_text").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    out = joined.mapInArrow(run, schema)
    return out.select("id", "text", "n_lines", "n_dropped", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
