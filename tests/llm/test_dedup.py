"""SimHash, line templates, paragraphs and repeated substrings against brute force, and edge tables."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from issuelens.llm import bwt, line_dedup, paragraphs, simhash
from issuelens.llm.common import components

SCHEMA = "doc_id long, text string, fp string, component string, id long"  # extra columns with clashing names


def words(rng, n, kinds=4000):
    return " ".join("w%d" % rng.randrange(kinds) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(1, 120))) for i in range(60)]
    for i in range(60, 90):  # near copies
        w = rows[i - 60][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    shared = words(rng, 60)
    rows += [(i, words(rng, 10) + "\n" + shared + "\n" + words(rng, 12)) for i in range(90, 110)]
    rows += [(110, rows[3][1]), (111, rows[3][1]), (111, rows[3][1]), (112, ""), (113, None), (None, "no id here at all"),
             (None, None), (114, " \t\n"), (115, "x"), (116, "É" * 80), (117, "É" * 80 + "é"), (118, "ab" * 3000), (119, "ab" * 200)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "fp", "c", 7) for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes_equal_brute_force(spark, corpus):
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    prints = {i: plain_fingerprint(t) for i, t in corpus if i is not None}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    for r in got:
        if r.id is not None:
            assert r.fp & (2**64 - 1) == prints[r.id]
            assert r.component == root(r.id)


def test_gray_index_finds_all_pairs_and_hot_buckets_lose_none(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 12, dtype=np.uint64)
    codes = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, 3).tolist())) for b in base for _ in range(25)], np.uint64))
    want = {(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    order = np.argsort(simhash.gray_rank(codes))
    index = simhash.GrayIndex(np.zeros(len(codes)), codes[order])
    got = {tuple(sorted((int(order[a]), int(order[b])), reverse=True)) for x, y in index.pairs(3, budget=999) for a, b in zip(x, y)}
    assert got == want
    rows = spark.createDataFrame([(int(c.view(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long")
    parent = np.arange(len(codes))
    parent = simhash.hook(parent, *np.array(sorted(want)).T)
    for limit in (2, 20_000):  # 2: every bucket is routed a second time
        found = components(simhash.links(rows, 3, split_above=limit, cut=50), "t").collect()
        label = {r.node: r.component for r in found}
        assert [label.get(i, i) for i in range(len(codes))] == parent.tolist()


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_crowded_buckets_are_cut_until_small_and_lose_no_pair(spark, radius):
    rng = np.random.default_rng(5)
    crowd = (np.uint64(0x9E3779B97F) << np.uint64(24)) ^ rng.integers(0, 1 << 11, 500, dtype=np.uint64)  # 53 equal bits
    codes = np.unique(np.concatenate([crowd, rng.integers(0, 2**64, 40, dtype=np.uint64, endpoint=False)]))
    rows = spark.createDataFrame([(int(c.view(np.int64)), i) for i, c in enumerate(codes)], "fp long, rep long")
    limit = 40
    placed = simhash.buckets(rows, radius, split_above=limit).collect()
    members = {}
    for r in placed:
        members.setdefault(r.bucket, []).append(r.rep)
    if radius:
        assert max(map(len, members.values())) <= limit
    together = {(min(a, b), max(a, b)) for m in members.values() for a in m for b in m if a != b}
    want = {(i, j) for j in range(len(codes)) for i in range(j) if int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert want <= together
    found = {r.node: r.component for r in components(simhash.links(rows, radius, split_above=limit, cut=50), "t").collect()}
    label = np.arange(len(codes))
    if want:
        label = simhash.hook(label, *np.array(sorted(want)).T)
    assert [found.get(i, i) for i in range(len(codes))] == label.tolist()


def test_rows_without_an_id_link_like_any_other(spark):
    rng = random.Random(21)
    base = words(rng, 900).split()

    def edited(text):
        at = rng.randrange(len(text))
        return text[:at] + ["edited%d" % rng.randrange(99)] + text[at + 1 :]

    for _ in range(2000):  # a chain: the ends are too far apart, and only the row without an id joins them
        near = edited(base)
        far = edited(near)
        a, b, c = (simhash.simhash(" ".join(t).encode()) for t in (base, near, far))
        if 0 < (a ^ b).bit_count() <= 3 and 0 < (b ^ c).bit_count() <= 3 < (a ^ c).bit_count():
            break
    else:
        pytest.fail("no chain found")
    base, near, far = (" ".join(t) for t in (base, near, far))
    alone = words(rng, 50)
    got = simhash.near_duplicates(frame(spark, [(7, base), (None, near), (4, far), (None, alone), (9, None)])).collect()
    by_print = {r.fp & (2**64 - 1): (r.id, r.component) for r in got}
    assert by_print == {
        plain_fingerprint(base): (7, 4), plain_fingerprint(near): (None, 4), plain_fingerprint(far): (4, 4),
        plain_fingerprint(alone): (None, None), 0: (9, 9),
    }


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in range(200, 260)} == {7}


def test_line_templates(spark):
    head = "Licensed to the owner of this site under"
    rows = [(i, f"own text {i} " + "abcdefgh"[i] * 5 + f"\n{head} terms {'xyzuvwqr'[i]}x\nVisits: {i * 17} today\n") for i in range(6)]
    rows += [(7, "one of a kind line here"), (8, None), (9, ""), (None, "Visits: 99 today"), (10, "Visits: 1 today\n\nkept")]
    got = {r.id: r for r in line_dedup.drop_lines(frame(spark, rows), keep=["fp"]).collect()}
    assert got[0].text == rows[0][1]  # the first document keeps its lines
    for i in range(1, 6):
        assert got[i].n_dropped == 2 and head not in got[i].text and "Visits" not in got[i].text and "own text" in got[i].text
    assert got[10].text == "\nkept" and got[None].text == "" and got[8].text is None and got[9].text == ""
    assert got[7].n_dropped == 0 and got[7].fp == "fp"


def test_two_copies_of_a_line_do_not_recur(spark):
    got = line_dedup.drop_lines(frame(spark, [(1, "the same line twice"), (2, "the same line twice")]))
    assert got.agg(F.sum("n_dropped")).first()[0] == 0


def test_paragraph_classes_equal_brute_force(spark, corpus):
    rng = random.Random(9)
    long_one = words(rng, 80).split()
    extra = []
    for i in range(300, 340):
        w = list(long_one)
        w[rng.randrange(80)] = "z%d" % i
        extra.append((i, " ".join(w)))
    rows = corpus + extra
    for block in (1000, 3):  # 3: hot buckets are cut into blocks
        found = paragraphs.classes(frame(spark, rows), block=block).collect()
        sets = {}
        for _, t in rows:
            for _, w in paragraphs.split((t or "").encode()):
                sets[paragraphs.signed(b" ".join(w))] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        nodes = sorted(sets)
        labels = np.arange(len(nodes))
        pairs = [(i, j) for i in range(len(nodes)) for j in range(i)
                 if len(sets[nodes[i]] & sets[nodes[j]]) >= 0.8 * len(sets[nodes[i]] | sets[nodes[j]]) - 1e-9]
        labels = simhash.hook(labels, *np.array(pairs).T)
        want = {n: nodes[labels[k]] for k, n in enumerate(nodes)}
        assert {r.node for r in found} == set(nodes)
        assert all(r["class"] == want[r.node] for r in found)


@pytest.mark.parametrize("centres", [0, 2])
def test_crowded_paragraph_buckets_lose_no_link_and_copy_little(spark, centres):
    rng = np.random.default_rng(12)
    base = rng.choice(10**6, 60, replace=False)
    family = [np.unique(np.append(np.delete(base, k % 60), 2 * 10**6 + k)) for k in range(120)]  # edits of one paragraph
    chain = [np.arange(4 * 10**6 + 2 * k, 4 * 10**6 + 2 * k + 40) for k in range(50)]  # only neighbours are similar
    sets = family + chain + [rng.choice(10**6, 30, replace=False) for _ in range(30)]
    sets = [np.sort(s) for s in sets]
    met = [(n, bucket, len(sets)) for bucket in (1, 2) for n in range(len(sets))] + [(0, 3, 2), (199, 3, 2)]
    frames = (
        spark.createDataFrame(met, "node long, bucket long, n long"),
        spark.createDataFrame([(n, s.tolist()) for n, s in enumerate(sets)], "node long, codes array<long>"),
    )
    found = {r.node: r.component for r in components(paragraphs.linked(*frames, block=16, centres=centres), "t").collect()}
    label = np.arange(len(sets))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)
             if (b := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - b) - 1e-9]
    label = simhash.hook(label, *np.array(pairs).T)
    assert [found.get(i, i) for i in range(len(sets))] == label.tolist()
    assert len(set(label[:120])) == 1 == len(set(label[120:170]))
    i, j = paragraphs.cross_pairs(sets, sets, 0.8)
    assert set(zip(i[i < j].tolist(), j[i < j].tolist())) == set(pairs)


def test_a_crowded_bucket_of_one_class_has_no_guests(spark, monkeypatch):
    base = np.arange(100)
    sets = [np.append(base, 1000 + k) for k in range(90)]
    frames = (
        spark.createDataFrame([(n, 1, 90) for n in range(90)], "node long, bucket long, n long"),
        spark.createDataFrame([(n, s.tolist()) for n, s in enumerate(sets)], "node long, codes array<long>"),
    )
    seen = []
    plain = paragraphs.visited
    monkeypatch.setattr(paragraphs, "visited", lambda rows, *rest: seen.append(rows.count()) or plain(rows, *rest))
    found = components(paragraphs.linked(*frames, block=10), "t")
    assert found.select("component").distinct().count() == 1 and found.count() == 90 and seen == [0]


def test_paragraph_removal_keeps_the_first(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, "a b\n" + text), (1, text + "\nrest of one"), (2, text.upper()), (4, None), (5, "")]
    got = {r.id: r for r in paragraphs.remove_paragraphs(frame(spark, rows)).collect()}
    assert got[1].text == rows[1][1] and got[3].text == "a b" and got[2].text == "" and got[4].text is None
    assert (got[2].n_removed, got[3].n_removed, got[5].n_paragraphs) == (1, 1, 0)
    bands, length = paragraphs.tune()
    assert 1 - (1 - 0.8**length) ** bands >= paragraphs.RECALL


def without_earlier_runs(rows, span):
    """Documents of one line each: their text without the words of runs that a document with a smaller id holds."""
    first = {}
    for i, t in sorted(rows):
        w = t.lower().split()
        for s in range(len(w) - span + 1):
            first.setdefault(tuple(w[s : s + span]), i)
    out = {}
    for i, t in rows:
        w = t.lower().split()
        gone = {s + k for s in range(len(w) - span + 1) if first[tuple(w[s : s + span])] < i for k in range(span)}
        out[i] = " ".join(x for k, x in enumerate(t.split()) if k not in gone)
    return out


def test_passages_inside_paragraphs_are_cut(spark):
    rng = random.Random(11)
    passage, edge, short = words(rng, 55), words(rng, 50), words(rng, 49)
    own = lambda n: words(rng, n, 10**6)
    rows = [(1, f"{own(300)} {passage} {own(200)}"), (2, f"{own(400)} {passage.upper()} {own(30)}"), (3, f"{own(90)} {short} {own(60)} {edge}"),
            (4, f"{edge} {own(70)}"), (5, f"{own(80)} {short} {own(60)}"), (6, f"{own(150)} {edge}"), (7, f"{own(40)} {passage} {own(9)} {edge} {own(500)}"),
            (8, " ".join([own(1)] * 200)), (9, own(49))]
    got = {r.id: r for r in paragraphs.remove_paragraphs(frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == without_earlier_runs(rows, 50)
    assert {i for i, r in got.items() if r.n_removed} == {2, 4, 6, 7} and got[7].n_removed == 1 and got[4].text == rows[3][1][len(edge) + 1 :]


def test_passages_of_null_ids_copies_and_whole_lines(spark):
    rng = random.Random(12)
    passage = words(rng, 60)
    rows = [(2, f"{words(rng, 300)} {passage}"), (None, f"first line\n  {passage}\t\nlast line"), (3, f"{words(rng, 200)}  {passage}  tail\u00e9"),
            (3, f"{passage} {words(rng, 200)}"), (4, None), (5, "")]
    rows += [(6, rows[0][1])]
    got = sorted((r.id or 99, r.text, r.n_removed) for r in paragraphs.remove_paragraphs(frame(spark, rows)).collect() if r.text)
    # 6: a copy of document 2's paragraph goes whole, as before.
    assert got == sorted([(2, rows[0][1], 0), (3, rows[2][1].replace(passage + "  ", ""), 1), (3, rows[3][1][len(passage) + 1 :], 1), (99, "first line\nlast line", 1)])


def test_passages_across_line_breaks_are_cut_and_short_lines_stay(spark):
    rng = random.Random(13)
    passage, line = words(rng, 60).split(), words(rng, 12)
    own = lambda n: words(rng, n, 10**6)
    wrapped = lambda *cuts: "\n".join(" ".join(passage[a:z]) for a, z in zip((0, *cuts), (*cuts, 60)))
    rows = [(1, f"{own(40)} {wrapped(35)} {own(9)}\n{line}"), (2, f"{own(70)}\n{own(3)} {wrapped(20, 40)} x\n\n{line}"), (3, f"{line}\n{own(80)}"),
            (4, f"{wrapped()}\n{line}"), (5, f"{own(30)}\n{line}\n{own(10)}")]
    rows += [(6, rows[0][1]), (7, rows[4][1]), (8, line), (9, line)]  # copies: of 61 words or more, of 52, of a short line
    got = {r.id: r for r in paragraphs.remove_paragraphs(frame(spark, rows), min_words=50).collect()}
    two = rows[1][1].split("\n")
    want = {i: t for i, t in rows} | {2: "\n".join([two[0], " ".join(two[1].split()[:3]) + " ", "x", "", line]), 4: line, 6: "", 7: ""}
    assert {i: r.text.replace(" \n", "\n") for i, r in got.items()} == {i: t.replace(" \n", "\n") for i, t in want.items()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {2: 3, 4: 1, 6: 3, 7: 3}


def plain_removal(rows, span=50):
    rows = sorted(((i if i is not None else bwt.NO_ID, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    first, out = {}, []
    for i, x in rows:
        for s in range(len(x) - span + 1):
            first.setdefault(x[s : s + span], i)
    for i, x in rows:
        gone = bytearray(len(x))
        for s in range(len(x) - span + 1):
            if first[x[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("frequent,hot", [(64, 5000), (1, 2)])
def test_repeated_bytes_equal_brute_force(spark, corpus, frequent, hot):
    cut = bwt.remove_repeats(frame(spark, corpus), frequent=frequent, hot_above=hot)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in cut.collect())
    assert got == plain_removal(corpus)


def test_merged_transforms_equal_sorted_suffixes():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 99, rng.integers(5, 40)).astype(np.uint8)) for _ in range(12)]
    shards, ends = [], []
    for part in (texts[:5], texts[5:6], texts[6:]):
        flat = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8) + np.uint8(1)
        stop = np.cumsum([len(t) + 1 for t in part]) - 1
        shards.append(flat)
        ends.append(np.repeat(stop, [len(t) + 1 for t in part]))
    interval, _ = bwt.merge(shards, ends, span=6)
    suffixes = [t[i:] + b"$" for t in texts for i in range(len(t) + 1)]
    for a in range(len(suffixes)):
        for b in range(a):
            same = min(len(suffixes[a]), len(suffixes[b])) > 6 and suffixes[a][:6] == suffixes[b][:6]
            assert same == (interval[a] == interval[b] >= 0)


@pytest.mark.parametrize("op", [
    lambda d: simhash.near_duplicates(d), lambda d: line_dedup.drop_lines(d), lambda d: paragraphs.remove_paragraphs(d),
    lambda d: bwt.remove_repeats(d),
])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def dropped(spark, rows):
    return {r.id: r.n_dropped for r in line_dedup.drop_lines(frame(spark, rows)).collect()}


def test_long_lines_of_two_documents_recur(spark):
    passage = " ".join("pass" + "abcdefghij"[k % 10] * (k // 10 + 1) for k in range(60))
    rows = [(1, passage), (2, "own\n" + passage), (3, "a few short words"), (4, "a few short words")]
    assert dropped(spark, rows) == {1: 0, 2: 1, 3: 0, 4: 0}


@pytest.mark.parametrize("kinds", [2, 3, 10])
def test_templates_with_two_fields_of_recurring_words(spark, kinds):
    name = lambda k, s: s + "abcdefghij"[k] * 3
    rows = [(i * kinds + j, f"user access granted to {name(i, 'u')} from site {name(j, 's')} at the front door today")
            for i in range(kinds) for j in range(kinds)]
    assert dropped(spark, rows) == {r[0]: int(r[0] > 0) for r in rows}


def test_templates_in_a_crowded_leaf(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=6))
    one = [f"user access granted to {word()} from site {word()} at the front door today" for _ in range(9)]
    two = [f"user access granted in {word()} by order {word()} of the big boss alone" for _ in range(9)]
    prose = [" ".join(["user access granted", *(word() for _ in range(10))]) for _ in range(200)]
    got = dropped(spark, list(enumerate(one + two + prose)))
    assert sorted(i for i in got if not got[i]) == [0, 9, *range(18, 218)]


def test_rows_of_numbers_and_code_stay(spark):
    rng = random.Random(8)
    table_of = lambda: "\n".join(" ".join(str(rng.randrange(10**6)) for _ in range(4)) for _ in range(5))
    rows = [(i, f"def f{i}(x):\n{{\n  {'abcdefgh'[i]}x = 1;\n}}\n{'abcdefgh'[i] * 3} {i}\n---\n" + table_of()) for i in range(8)]
    rows += [(i, f"word{i} alpha\nkey {i} value {i}") for i in range(20, 26)]
    got = {r.id: r for r in line_dedup.drop_lines(frame(spark, rows)).collect()}
    assert all(got[i].text == t and got[i].n_dropped == 0 for i, t in rows)
    # The same row of numbers is an exact copy like any other line; a template needs most of its words fixed.
    same = [(i, "11 22 33 44 55 66 77 a8\nTotal of all visits: " + str(i)) for i in range(4)]
    assert dropped(spark, same) == {0: 0, 1: 2, 2: 2, 3: 2}


def test_documents_travel_packed_by_block():
    """Every document reaches its block once, null texts as empty ones, in fewer bytes than it has; parts of bounded size."""
    import pyarrow as pa

    ids = [*range(400), 7, bwt.NO_ID]
    texts = [None if i % 50 == 0 else f"doc {i} " + "the same words again and again " * (i % 40) for i in range(400)] + ["again 7", "no id"]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + 90], pa.int64()), pa.array(texts[a : a + 90], pa.string())], names=["id", "text"]) for a in range(0, 402, 90)]
    got, size = [], 0
    for out in bwt._packed(5)(iter([*batches, batches[0].slice(0, 0)])):
        for block, kind, head, data in zip(*(c.to_pylist() for c in out.columns)):
            size += len(head) + len(data)
            found = list(bwt._unpacked(head, data))
            assert kind == 2 and {block} == set(bwt.blocks_of(np.array([i for i, _ in found]), 5).tolist())
            got += found
    assert sorted(got) == sorted((i, (t or "").encode()) for i, t in zip(ids, texts))
    assert 4 * size < sum(len(t or "") for t in texts)
