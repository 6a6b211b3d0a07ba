"""Periodic runs against brute force, whole and appended in pieces, and edge tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import queries, runs
from issuelens.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, runs string, best string, id long, n_words long"  # extra columns with clashing names


def plain_runs(words, min_length=6, min_exponent=4):
    """Every maximal stretch of every period; of equal stretches the smallest period stays."""
    n, found = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k - i + q >= max(2 * q, min_length, min_exponent * q):
                found.setdefault((i, k + q), q)
            i = k
    return sorted((s, e, q) for (s, e), q in found.items())


def texts(rng, count):
    for _ in range(count):
        n = rng.randrange(0, 90)
        kinds = rng.choice([1, 2, 3, 20])
        w = [str(rng.randrange(kinds)) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(2, 9)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        yield [x.encode() for x in w]


def thue_morse(n):
    return [b"ab"[bin(i).count("1") % 2 : bin(i).count("1") % 2 + 1] for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return [c.encode() for c in b[:n]]


@pytest.mark.parametrize("piece", [1 << 18, 64, 7, 1])
@pytest.mark.parametrize("limits", [(6, 4), (2, 2)])
def test_runs_equal_brute_force(piece, limits):
    rng = random.Random(piece)
    many = list(texts(rng, 150 if piece > 1 else 30)) + [thue_morse(300), fibonacci(300), [b"a"] * 200, [b"a", b"b"] * 90 + [b"c"] + [b"a", b"b"] * 80]
    got = runs.text_runs(many, *limits, piece=piece)
    for words, found in zip(many, got):
        assert [tuple(r) for r in found.tolist()] == plain_runs(words, *limits)


def test_appending_word_by_word_equals_appending_all():
    rng = random.Random(4)
    for words in texts(rng, 40):
        codes = np.array([int(w) for w in words], np.int64)
        one, all_ = runs.Catchers(), runs.Catchers()
        for c in codes:
            one.append(np.array([c]))
        all_.append(codes)
        assert one.runs(2, 2).tolist() == all_.runs(2, 2).tolist() == [list(r) for r in plain_runs(words, 2, 2)]


def test_modular_products():
    rng = np.random.default_rng(1)
    m = 2**61 - 1
    a = np.append(rng.integers(0, m, 500, dtype=np.uint64), [0, 1, m - 1]).astype(np.uint64)
    b = np.append(rng.integers(0, m, 500, dtype=np.uint64), [m - 1, m - 1, m - 1]).astype(np.uint64)
    assert runs.mul_mod(a, b).tolist() == [int(x) * int(y) % m for x, y in zip(a, b)]
    assert runs.sums_mod(a, 5).tolist() == [(5 + sum(int(x) for x in a[: i + 1])) % m for i in range(len(a))]


def test_long_repetitive_texts():
    block = [b"x"] * 1000 + [b"y"]
    words = block * 60 + [b"q"] + [b"a"] * 200_000
    got = runs.text_runs([words], piece=50_000)[0].tolist()
    # Every stretch of x's, the whole of the blocks (and the x's of a sixty-first stretch are missing), the a's.
    assert [0, 60 * 1001, 1001] in got and [60 * 1001 + 1, len(words), 1] in got and len(got) == 62


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    best = None
    for s, e, q in found:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines.encode()), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, b" ".join(w).decode()) for i, w in enumerate(texts(rng, 160))]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "é " * 40), (204, "same\x0bsame\x0csame\rsame\tsame\nsame"), (205, "x y " * 9),
             (206, "a b " * 3000), (207, rows[3][1]), (208, "one two three four")]
    spark.createDataFrame([(i, t, "r", "b", 7, 3) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        if i == 206:  # too long for the brute force; its crc32 is no multiple of ten
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 6000, 2, 3_000_000)
            continue
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == plain_row(i, t), i
    assert sum(1 for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0) > 5


def test_rows_are_judged_alone(spark):
    rows = [(None, "a a a a a a a"), (1, "a a a a a a a"), (1, "a a a a a a a"), (1, "b c"), (2, None)]
    found = runs.periodic_runs(spark.createDataFrame([(i, t, "r", "b", 7, 3) for i, t in rows], SCHEMA), keep=["runs", "id"])
    assert found.columns == ["id", "n_words", "runs", "best", "text", "runs", "id"]
    got = found.toDF("key", "n", "runs", "best", "text", "kept_runs", "kept_id").orderBy(F.col("key").asc_nulls_first(), "n").collect()
    assert [(r.key, r.n, r.text, r.kept_runs, r.kept_id) for r in got] == [
        (None, 7, "a", "r", 7), (1, 2, "b c", "r", 7), (1, 7, "a", "r", 7), (1, 7, "a", "r", 7), (2, 0, "", "r", 7)]
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
