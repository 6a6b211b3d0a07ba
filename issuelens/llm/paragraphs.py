"""Substring dedup at paragraph level: MinHash banding, exact Jaccard check, connected components.

A paragraph is a line with a word.  Words are lower-cased (A-Z); a paragraph's set holds its five-word shingles
(fewer words: the whole sequence).  Paragraphs with the same word sequence are one node, so copies cost
nothing beyond a count.  Nodes whose MinHash signatures agree in a band meet; pairs with an exact Jaccard
similarity of at least ``THRESHOLD`` are linked, and classes are the connected components.  Of each class the
occurrence with the smallest (id, position) stays and all others are removed.

What stays may still hold a passage of another document, which the similarity of paragraphs doesn't show: a document
without line breaks is one paragraph, and a passage may be wrapped elsewhere.  Of every document each word is cut that a run of
``PASSAGE`` words covers, across line breaks, which also stands in a document with a smaller id (judged on the input).  Runs whose
smallest hash of ``GRAM`` words, their anchor, occurs in one document alone (copies count as one) are dropped before any text is read
again; the others are compared whole.

``min_words``: paragraphs of fewer words join no class.  Documents that have nothing else in common share short lines; where these
should stay, only passages longer than that count as repeated.

Bands are tuned (``tune``): the longest bands for which at most ``MAX_BANDS`` of them catch a pair at the
threshold with a chance of ``RECALL`` or more.  Buckets of one node are dropped before any text is read again.  A bucket
of more than ``BLOCK`` nodes is cut into blocks by hash.  First every block is checked by itself, with the bucket's
``CENTRES`` best connected nodes among its members, so a family around one paragraph comes together at once.  Then the nodes outside
the bucket's largest class, and only these, visit the other blocks: two nodes of different classes are never both in the
largest one, so no pair of a bucket goes unseen, no task holds a whole hot bucket, and a bucket of one class is copied
no further.  Pairs never leave a task, which emits the edges of a spanning forest only.

Edge cases: null and wordless texts have no paragraphs; a null id stands for one document after all others; rows
with equal ids are one document, whose occurrences are told apart by position and text; an empty table gives
no rows; other columns pass through by the caller's choice (``keep``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.common import PRIME, components, hook, row_blocks, shingle_codes, signed, stage, text_bytes, word_hashes

SHINGLE = 5
PASSAGE = 50  # words
GRAM = 4 * SHINGLE
THRESHOLD = 0.8
RECALL = 0.9995
MAX_BANDS = 12
BLOCK = 1000
CENTRES = 32
NO_ID = (1 << 63) - 1
WHOLE = -1  # the position of a document as a whole
BLOCK_BYTES = 4 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tune(threshold: float = THRESHOLD, recall: float = RECALL, max_bands: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): longest bands that still reach the recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 17):
        for bands in range(1, max_bands + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def split(text: bytes) -> list[tuple[int, list[bytes]]]:
    """Position and lower-cased words of each paragraph."""
    return [(i, w) for i, line in enumerate(text.split(b"\n")) if (w := line.lower().split())]


def shingle_sets(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle codes of all paragraphs in turn, and where each one's codes start."""
    sizes = np.fromiter(map(len, paragraphs), np.int64, len(paragraphs))
    flat = word_hashes([w for p in paragraphs for w in p])
    first = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - SHINGLE + 1, 1)
    starts = np.cumsum(count) - count
    codes = np.zeros(int(count.sum()), np.uint64)
    whole = shingle_codes(flat, SHINGLE)
    long_ = sizes >= SHINGLE
    own = np.repeat(long_, count)
    at = np.repeat(first, count) + np.arange(len(codes)) - np.repeat(starts, count)
    codes[own] = whole[at[own]]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(sizes == k)
        if len(short):
            codes[starts[short]] = shingle_codes(flat, k)[first[short]]
    return codes, starts


def band_keys(codes: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """One key per paragraph and band: (paragraph, band)."""
    rng = np.random.default_rng(seed)
    keys = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        for _ in range(rows):
            turn = np.uint64(rng.integers(0, 1 << 63))
            odd = np.uint64(rng.integers(0, 1 << 62) * 2 + 1)
            mixed = (codes ^ turn) * odd
            low = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
            keys[:, band] = (keys[:, band] ^ low) * PRIME
            keys[:, band] ^= keys[:, band] >> np.uint64(29)
        keys[:, band] += np.uint64(band + 1)
    return keys.view(np.int64)


def anchors(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every run of ``PASSAGE`` words, and its paragraph: the smallest hash of the ``GRAM``-word runs inside."""
    lead, span = GRAM - SHINGLE, PASSAGE - GRAM + 1
    runs = np.maximum(np.diff(np.append(starts, len(codes))) - (PASSAGE - SHINGLE), 0)
    owner = np.repeat(np.arange(len(starts)), runs)
    if not len(owner):
        return np.zeros(0, np.int64), owner
    low = codes[: len(codes) - lead]
    for k in range(SHINGLE, GRAM, SHINGLE):
        low = (low ^ codes[k : len(codes) - lead + k]) * PRIME
        low ^= low >> np.uint64(31)
    reach = 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(runs) - runs), runs)
    return low[at].view(np.int64), owner


def anchor_lists(codes: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Each paragraph's anchors, one for every stretch of runs that share it."""
    low, owner = anchors(codes, starts)
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    offsets = np.searchsorted(owner[new], np.arange(len(starts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(low[new], pa.int64()))


def passage_codes(words: list[bytes]) -> np.ndarray:
    """A code of every run of ``PASSAGE`` words."""
    return shingle_codes(word_hashes(words), PASSAGE).view(np.int64)


def covered_words(words: list[bytes], gone: np.ndarray) -> np.ndarray:
    """Whether the runs ``gone`` cover each word."""
    hit = np.flatnonzero(np.isin(passage_codes(words), gone))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + PASSAGE, -1)
    return np.cumsum(edge)[:-1] > 0


def without_words(line: bytes, covered: np.ndarray) -> bytes | None:
    """The line without its covered words; None if no word is left, the line itself if none goes."""
    if not covered.any():
        return line
    if covered.all():
        return None
    spans = [m.span() for m in WORD.finditer(line)]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0]))))
    out, kept = [], 0
    for a, z in turns.reshape(-1, 2).tolist():  # words a to z - 1 go with the space after them, the last ones with the space before
        last = z == len(covered)
        out.append(line[kept : spans[a - 1][1] if last else spans[a][0]])
        kept = spans[-1][1] if last else spans[z][0]
    return b"".join(out) + line[kept:]


def document_node(words: list[bytes]) -> int:
    """The number of a document's word sequence; no paragraph's."""
    return signed(b"\n" + b" ".join(words))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text")
    )


def occurrences(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, min_words: int = 1) -> DataFrame:
    """Rows (id, pos, node, keys, anchors): every paragraph of ``min_words`` words with its band keys, and at ``WHOLE`` every
    document of ``PASSAGE`` words with the anchors of its passages."""

    def run(batches):
        for b in batches:
            all_ids, texts = b.column(0).to_pylist(), text_bytes(b.column(1))
            for a, z in row_blocks(texts, BLOCK_BYTES):
                ids, places, nodes, paragraphs, owners, wholes = [], [], [], [], [], []
                for i in range(a, z):
                    parts = split(texts[i])
                    whole = [w for _, words in parts for w in words]
                    if len(whole) >= PASSAGE:
                        owners.append(all_ids[i])
                        wholes.append(whole)
                    for pos, words in parts:
                        if len(words) >= min_words:
                            ids.append(all_ids[i])
                            places.append(pos)
                            nodes.append(signed(b" ".join(words)))
                            paragraphs.append(words)
                if ids:
                    keys = band_keys(*shingle_sets(paragraphs), bands, rows)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(pa.list_(pa.int64()))
                    yield _occurring(ids, places, nodes, lists, pa.nulls(len(ids), pa.list_(pa.int64())))
                if owners:
                    marks = anchor_lists(*shingle_sets(wholes))
                    yield _occurring(owners, [WHOLE] * len(owners), list(map(document_node, wholes)), pa.nulls(len(owners), pa.list_(pa.int64())), marks)

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, pos int, node long, keys array<long>, anchors array<long>")


def _occurring(ids: list, places: list, nodes: list, keys: pa.Array, marks: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(nodes, pa.int64()), keys, marks], names=["id", "pos", "node", "keys", "anchors"]
    )


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, id, codes, runs) of the nodes that ``wanted`` (id, node, paired, marks) places in documents.

    Shingle sets (of ``paired`` nodes, paragraphs), and the codes of the runs of ``PASSAGE`` words whose anchor is one of the
    ``marks`` of the node (a document).
    """
    lists = wanted.groupBy(F.col("id").alias("wid")).agg(F.collect_list(F.struct("node", "paired", "marks")).alias("nodes"))
    joined = _rows(docs, id_col, text_col).join(lists, F.col("id") == F.col("wid")).select("nodes", "id", "text")

    def run(batches):
        for b in batches:
            nodes, ids, sets, runs = [], [], [], []
            for want, id_, text in zip(*(b.column(i).to_pylist() for i in range(2)), text_bytes(b.column(2))):
                want = {w["node"]: w for w in want}
                parts = split(text)
                whole = [w for _, words in parts for w in words]
                for node, words in [(document_node(whole), whole), *((signed(b" ".join(words)), words) for _, words in parts)]:
                    if node in want:
                        mine = want.pop(node)
                        codes, starts = shingle_sets([words])
                        nodes.append(node)
                        ids.append(id_)
                        sets.append(np.unique(codes).view(np.int64) if mine["paired"] else [])
                        runs.append(np.unique(passage_codes(words)[np.isin(anchors(codes, starts)[0], mine["marks"])]) if mine["marks"] else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(ids, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (sets, runs)]],
                names=["node", "id", "codes", "runs"],
            )

    return joined.mapInArrow(run, "node long, id long, codes array<long>, runs array<long>").dropDuplicates(["node"])


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of sorted distinct arrays with Jaccard similarity of at least ``threshold``."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        found = []
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) - 1e-9:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9:
                        found.append((i, j))
        return tuple(np.array(found, int).reshape(-1, 2).T)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # only shingles of two sets or more can be common to a pair
    column = (np.cumsum(shared) - 1)[place]
    use = shared[place]
    owner, column = owner[use], column[use]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for c in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, (c, c + width))
        table = np.zeros((len(sets), width), np.float32)
        table[owner[a:z], column[a:z] - c] = 1
        both += table @ table.T
    close = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    return np.nonzero(np.triu(close, 1))


def verified(members: DataFrame, threshold: float, cut: int = 4_000) -> DataFrame:
    """Forest edges (a, b) inside every group of rows (grp, node, codes)."""

    def edges(rows):
        out_a, out_b = [], []
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][0] == rows[start][0]:
                end += 1
            nodes = np.array([r[1] for r in rows[start:end]], np.int64)
            i, j = similar_pairs([r[2] for r in rows[start:end]], threshold)
            if len(i):
                labels = hook(np.arange(len(nodes)), i, j)
                moved = np.flatnonzero(labels != np.arange(len(nodes)))
                out_a.append(nodes[moved])
                out_b.append(nodes[labels[moved]])
            start = end
        both = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], names=["a", "b"])

    def run(batches):
        kept = []
        for batch in batches:  # sorted by group
            lists = batch.column(2)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            sets = [values[offsets[k] : offsets[k + 1]] for k in range(batch.num_rows)]
            kept += list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets))
            if len(kept) >= cut:
                edge = len(kept)
                while edge and kept[edge - 1][0] == kept[-1][0]:
                    edge -= 1
                if edge:
                    yield edges(kept[:edge])
                    kept = kept[edge:]
        if kept:
            yield edges(kept)

    grouped = members.select("grp", "node", F.array_sort("codes").alias("codes"))
    return grouped.repartition("grp").sortWithinPartitions("grp", "node").mapInArrow(run, "a long, b long")


def cross_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of ``left``, j of ``right``) of sorted distinct arrays with Jaccard similarity of at least ``threshold``."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*flat)
    spots = []  # per side: owner and column of each common shingle, by column
    for codes, size in zip(flat, sizes):
        column = np.minimum(np.searchsorted(common, codes), max(len(common) - 1, 0))
        use = np.flatnonzero(common[column] == codes) if len(common) else np.zeros(0, np.int64)
        use = use[np.argsort(column[use], kind="stable")]
        spots.append((np.repeat(np.arange(len(size)), size)[use], column[use]))
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for c in range(0, len(common), width):
        tables = []
        for (owner, column), size in zip(spots, sizes):
            a, z = np.searchsorted(column, (c, c + width))
            table = np.zeros((len(size), width), np.float32)
            table[owner[a:z], column[a:z] - c] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
    return np.nonzero(both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6)


def visited(rows: DataFrame, threshold: float, chunk: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the classes of guests and members of every group of rows (grp, guest, label, codes).

    A group's members are held, its guests pass by in chunks.
    """

    def met(members, guests):
        i, j = cross_pairs([c for _, c in members], [c for _, c in guests], threshold)
        names, place = np.unique([n for n, _ in members + guests], return_inverse=True)
        labels = hook(np.arange(len(names)), place[i], place[len(members) + j])
        moved = np.flatnonzero(labels != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int64()), pa.array(names[labels[moved]], pa.int64())], names=["a", "b"])

    def run(batches):
        group, members, guests = None, [], []
        for batch in batches:  # sorted by group, members first
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (grp, guest, label) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                if grp != group:
                    if members and guests:
                        yield met(members, guests)
                    group, members, guests = grp, [], []
                (guests if guest else members).append((label, values[offsets[k] : offsets[k + 1]]))
                if len(guests) >= chunk:
                    if members:
                        yield met(members, guests)
                    guests = []
        if members and guests:
            yield met(members, guests)

    named = rows.select("grp", "guest", "label", F.array_sort("codes").alias("codes"))
    return named.repartition("grp").sortWithinPartitions("grp", "guest").mapInArrow(run, "a long, b long")


def _elsewhere(rows: DataFrame) -> DataFrame:
    """Rows of (bucket, blocks, own) once per other block of their bucket, as ``grp``."""
    others = F.expr("filter(sequence(0L, blocks - 1), b -> b <> own)")
    return rows.select("*", F.explode(others).alias("at")).withColumn("grp", F.xxhash64("bucket", "at")).drop("at")


def linked(met: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """Edges (a, b) whose components are the classes: rows ``met`` (node, bucket, n: nodes of the bucket) and ``sets`` (node, codes), both staged."""
    single = met.where(F.col("n") <= block).select("node", F.col("bucket").alias("grp"))
    hot = met.where(F.col("n") > block)
    if hot.isEmpty():
        return verified(single.join(sets, "node"), threshold)
    weight = hot.groupBy("node").agg(F.sum("n").alias("weight"))
    blocks = F.ceil(F.col("n") / block).cast("long")
    hot = hot.join(weight, "node").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    hot = stage(hot.select("node", "bucket", "blocks", "own", "weight"), "paragraph-hot")
    home = F.xxhash64("bucket", "own").alias("grp")

    # First round: every block by itself, the centres in each block of their bucket.
    order = Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "node")
    best = hot.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= centres).drop("rank")
    groups = single.unionByName(hot.select("node", home)).unionByName(_elsewhere(best).select("node", "grp"))
    first = stage(verified(groups.join(sets, "node"), threshold), "paragraph-first")

    # Second round: who is outside its bucket's largest class visits the bucket's other blocks.
    labels = components(first, "paragraph-labels").withColumnRenamed("component", "label")
    labelled = hot.drop("weight").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stage(labelled, "paragraph-labelled")
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    several = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("k", "label")).alias("largest"), F.count(F.lit(1)).alias("kinds"))
    open_ = labelled.join(several.where("kinds > 1"), "bucket")  # a bucket of one class is done
    guests = _elsewhere(open_.where("label <> largest")).select("node", "label", "grp", F.lit(1).alias("guest"))
    rows = open_.select("node", "label", home, F.lit(0).alias("guest")).unionByName(guests)
    return first.unionByName(stage(visited(rows.join(sets, "node"), threshold, block), "paragraph-second"))


def shared_anchors(every: DataFrame) -> DataFrame:
    """Rows (node, marks): the anchors of a document's node that another one has too."""
    held = every.where(F.size("anchors") > 0).groupBy("node").agg(F.first("anchors").alias("anchors"))  # equal nodes have equal anchors
    held = held.select("node", F.explode("anchors").alias("anchor"))
    several = held.groupBy("anchor").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("anchor")
    return held.join(several, "anchor").groupBy("node").agg(F.collect_set("anchor").alias("marks"))


def gathered(docs: DataFrame, id_col: str, text_col: str, threshold: float, min_words: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every occurrence, the rows (node, bucket, n) of the buckets of several nodes, and what ``sets_of`` says of the nodes that meet others; all staged."""
    bands, rows = tune(threshold)
    every = stage(occurrences(docs, id_col, text_col, bands, rows, min_words), "paragraphs")
    nodes = every.where(F.col("pos") != WHOLE).groupBy("node").agg(F.first("keys").alias("keys"))  # equal nodes have equal keys
    placed = stage(nodes.select("node", F.explode("keys").alias("bucket")), "paragraph-bands")
    crowded = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(placed.join(crowded, "bucket"), "paragraph-met")
    marked = stage(shared_anchors(every), "paragraph-marks")
    paired = met.select("node").distinct().withColumn("paired", F.lit(True))
    some = paired.join(marked, "node", "full")
    first = every.join(some, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    where = first.join(some, "node")
    return every, met, stage(sets_of(docs, where, id_col, text_col), "paragraph-sets")


def classed(every: DataFrame, met: DataFrame, sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows (id, pos, node, class) of what ``gathered`` gives."""
    links = linked(met, sets.select("node", "codes"), threshold, block)
    found = components(links, "paragraphs")
    return every.where(F.col("pos") != WHOLE).join(found, "node", "left").select("id", "pos", "node", F.coalesce("component", "node").alias("class"))


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """Rows (id, pos, node, class): every paragraph occurrence; class is the smallest node linked to it."""
    return classed(*gathered(docs, id_col, text_col, threshold), threshold, block)


def repeated_runs(sets: DataFrame) -> DataFrame:
    """Rows (id, runs): the runs of ``PASSAGE`` words of a document that also stand in one with a smaller id.

    A document's later copies are removed whole (``copied``), so the first one speaks for all.
    """
    runs = sets.select("id", F.explode("runs").alias("run"))
    first = runs.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    return runs.join(first, "run").where("id > first").groupBy("id").agg(F.collect_set("run").alias("runs"))


def copied(every: DataFrame) -> DataFrame:
    """Rows (id, pos, node): the documents of ``PASSAGE`` words whose words in full are those of one with a smaller id."""
    whole = every.where(F.col("pos") == WHOLE).select("id", "pos", "node")
    first = whole.groupBy("node").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    return whole.join(first, "node").where("id > first").select("id", "pos", "node")


def remove_paragraphs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD,
    min_words: int = 1,
) -> DataFrame:
    """Every row as (id, text, n_paragraphs, n_removed) and the columns ``keep``; later members of a class and repeated passages are cut out.

    ``n_removed`` counts the paragraphs that are gone or shortened.  Paragraphs of fewer than ``min_words`` words go only as parts of a passage.
    """
    keep = keep or []
    every, met, sets = gathered(docs, id_col, text_col, threshold, min_words)
    placed = stage(classed(every, met, sets, threshold), "paragraph-classes")
    first = placed.groupBy("class").agg(
        F.min(F.struct("id", "pos", "node")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    gone = (
        placed.join(first, "class")
        .where(F.struct("id", "pos", "node") != F.col("first"))
        .select("id", "pos", "node")
        .unionByName(copied(every))
        .groupBy("id")
        .agg(F.collect_set(F.struct("pos", "node")).alias("gone"))
    )
    gone = gone.join(repeated_runs(sets), "id", "full").withColumnRenamed("id", "gid")
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        F.col(id_col).alias("id"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    joined = rows.join(gone, F.col("_id") == F.col("gid"), "left").select(
        F.col("gone.pos").alias("pos"), F.col("gone.node").alias("node"), "runs", "_text", "id", *[f"_keep_{i}" for i in range(len(keep))]
    )

    def run(batches):
        for b in batches:
            texts, counts, removed = [], [], []
            for pos, node, runs, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.binary()).to_pylist()):
                n = cut = 0
                if text is not None:
                    lines = text.split(b"\n")
                    n = sum(1 for line in lines if line.split())
                    if pos or runs:
                        out, parts = set(zip(pos or [], node or [])), split(text)
                        whole = [w for _, words in parts for w in words]
                        if (WHOLE, document_node(whole)) in out:
                            covered = np.ones(len(whole), bool)
                        else:
                            covered = covered_words(whole, np.array(runs, np.int64)) if runs else np.zeros(len(whole), bool)
                        at = 0
                        for p, words in parts:
                            if (p, signed(b" ".join(words))) in out:
                                left = None
                            else:
                                left = without_words(lines[p], covered[at : at + len(words)])
                            at += len(words)
                            cut += left != lines[p]
                            lines[p] = left
                        text = b"\n".join(line for line in lines if line is not None)
                texts.append(text)
                counts.append(n)
                removed.append(cut)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[4:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                names=[*b.schema.names[4:], "text", "n_paragraphs", "n_removed"],
            )

    schema = joined.drop("pos", "node", "runs", "_text").schema
    schema = schema.add("text", "string").add("n_paragraphs", "long").add("n_removed", "long")
    out = joined.mapInArrow(run, schema)
    return out.select("id", "text", "n_paragraphs", "n_removed", *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)])
