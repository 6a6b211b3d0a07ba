"""MinHash near-duplicates against brute force, the sequential test against its posterior, and edge tables."""

import random
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from issuelens.llm import minhash, queries  # noqa: F401
from issuelens.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, node string, component string, id long, n string, key string"  # clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "c", 7, "n", "k") for i, t in rows], SCHEMA)


def words(rng, n, kinds=3000):
    return ["w%d" % rng.randrange(kinds) for _ in range(n)]


def edited(rng, text, edits):
    w = list(text)
    for at in rng.sample(range(len(w)), edits):
        w[at] = "e%d" % rng.randrange(10**9)
    return w


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 160))) for i in range(60)]
    for i in range(60, 130):  # from near copies to slightly too different ones
        base = rows[rng.randrange(60)][1]
        rows.append((i, edited(rng, base, min(len(base), rng.randrange(1, 5)))))
    star = words(rng, 150)
    rows += [(200 + i, edited(rng, star, 2)) for i in range(60)]  # linked to the base only
    rows += [(500, star), (501, star), (502, star)]
    chain = words(rng, 150)
    for i in range(40):  # each linked to the next, ends far apart
        rows.append((600 + i, chain))
        chain = edited(rng, chain, 1)
    out = [(i, " ".join(w)) for i, w in rows]
    out += [(700, ""), (701, None), (702, " \n\t"), (703, "A b C"), (704, "a B c"), (705, "a b c d"), (706, "É a b c d"), (707, "é a b c d"),
            (708, "one two three four five"), (709, "One two three four\x0bFIVE"), (709, "another text of the same id"), (None, " ".join(star)),
            (None, "text without an id seen twice"), (None, "text without an id seen twice"), (None, None),
            (-5, " ".join(edited(rng, star, 1))), (710, " ".join(words(rng, 30_000))), (711, "same same same " * 50), (712, "same " * 400)]
    return out


def shingles(text):
    w = bytes(text or "", "utf8").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(sets[i]), least.get(root(i)), key == least.get(root(i))) for i, (key, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("limits", [{}, {"members": 7, "centres": 2}, {"members": 3, "centres": 1}, {"volume": 700}])
def test_classes_equal_brute_force(spark, corpus, limits):
    found = minhash.near_duplicates(frame(spark, corpus), keep=["node", "id"], **limits)
    assert found.columns == ["id", "n_shingles", "component", "kept", "node", "id"]
    got = [tuple(r) for r in found.collect()]
    assert all(r[4:] == ("x", 7) for r in got)
    assert sorted((r[:4] for r in got), key=str) == plain(corpus)


def test_query(spark, corpus, tmp_path):
    frame(spark, corpus).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_minhash_near_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(corpus)


def test_bounds_are_those_of_the_posterior():
    bounds = minhash.least_matches(64, 32, 0.85, 1e-6)

    def tail(h, m):  # P(s >= 17/20) for s ~ Beta(m + 1, h - m + 1), by exact integration of the density
        t, total = Fraction(17, 20), Fraction(0)
        for k in range(h - m + 1):  # (1 - s)^(h - m) expanded
            total += (-1) ** k * comb(h - m, k) * (1 - t ** (m + k + 1)) / (m + k + 1)
        return float(total * (h + 1) * comb(h, m))

    for h, m in zip((32, 64), bounds):
        assert tail(h, m) >= 1e-6 > tail(h, m - 1)


def test_pairs_at_the_threshold_are_found():
    """Recall of bands and pruning for pairs of similarity 0.85 to 0.86; pairs of 0.6 are nearly always pruned."""
    rng = np.random.default_rng(5)
    verifier, lost, passed = minhash.Verifier(), 0, 0
    for n, common, near in [(200, 184, True)] * 300 + [(200, 150, False)] * 300:
        pool = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
        sets = [np.sort(pool[:n]), np.sort(pool[n - common :])]
        values = minhash.signatures(*minhash.flat(sets))
        keys, low = minhash.band_keys(values), values.astype(np.uint16)
        alive = len(verifier.survivors(keys, low, np.array([1]), keys[0], low[0]))
        if near:
            assert verifier.linked(*sets)
            lost += not alive
        else:
            assert not verifier.linked(*sets)
            passed += alive
    assert lost == 0 and passed < 15


def test_empty_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    only = minhash.near_duplicates(frame(spark, [(1, None), (2, ""), (None, " ")])).collect()
    assert sorted(map(tuple, only), key=str) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
