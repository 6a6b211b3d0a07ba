"""Line templates against a plain version that holds all lines and left-out positions as tuples."""

import itertools
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from issuelens.llm import line_dedup

SCHEMA = "doc_id long, text string, line string, first long, id long"  # extra columns with clashing names
LAST = float("inf")


def tokens_of(line):
    t = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
    if len(t) < 2 or not re.search(r"[A-Za-z\x80-\U0010ffff]", line):
        return None
    numbers = [bool(re.search("[0-9]", w)) for w in t]
    fixed = numbers.count(False)
    return tuple("<*>" if n else w for w, n in zip(t, numbers)) if fixed >= 2 and 2 * fixed > len(t) else t


def position_sets(n, uneven):
    """The sets of positions that a template of ``n`` tokens may leave out: three blocks of ten, or the most varied positions."""
    most = int(n * Fraction(3, 10))
    size = -(-(n - 3) // 10)
    blocks = [range(a, min(a + size, n)) for a in range(3, n, size)]
    for chosen in itertools.combinations(blocks, min(3, most // size, len(blocks))):
        yield frozenset(itertools.chain(*chosen))
    for k in range(1, min(most, len(uneven)) + 1):
        yield frozenset(uneven[:k])


def plain(rows, min_docs=3):
    """(id, text, dropped lines) of every row."""
    holders, leaves = defaultdict(set), defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if t := tokens_of(line):
                holders[t].add(LAST if i is None else i)
                if len(t) >= 6:
                    leaves[len(t), t[:3]].add(t)
    first = {}
    for (n, _), members in leaves.items():
        kinds = [len(set(column)) for column in zip(*members)]
        uneven = sorted((p for p in range(n) if kinds[p] > 1), key=lambda p: (-kinds[p], p))
        sets = list(position_sets(n, uneven))
        found = defaultdict(set)
        for t in members:
            for out in sets:
                found[out, tuple(w for p, w in enumerate(t) if p not in out)].add(t)
        for same in found.values():
            docs = set().union(*(holders[t] for t in same))
            if len(docs) >= min_docs:
                for t in same:
                    first[t] = min(first.get(t, LAST), *docs)
    for t, docs in holders.items():
        long = sum(w != "<*>" for w in t) >= 6
        if t not in first and len(docs) >= (min(2, min_docs) if long else min_docs):
            first[t] = min(docs)
    out = []
    for i, text in rows:
        parts = [] if text is None else text.split("\n")
        at = LAST if i is None else i
        kept = [p for p in parts if not ((t := tokens_of(p)) in first and at > first[t])]
        out.append((i, None if text is None else "\n".join(kept), len(parts) - len(kept)))
    return out


def random_rows(seed):
    """Templates with fields of words and numbers, lines that differ in a few places, and lines of their own."""
    rng = random.Random(seed)
    word = lambda kinds=60: "".join(rng.choices("abcdef", k=3)) if rng.random() < 0.5 else "w" + "xyz"[rng.randrange(kinds) % 3] * 3
    bases = [[word() for _ in range(rng.choice([2, 4, 6, 7, 9, 13, 24, 41]))] for _ in range(14)]
    for b in bases[7:]:  # crowded leaves
        b[:3] = ["one", "common", "head"][: len(b[:3])]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                line[rng.randrange(len(line))] = str(rng.randrange(99)) if rng.random() < 0.3 else word()
            parts.append(rng.choice([" ", "\t", "  "]).join(line))
        rows.append((i, "\n".join(parts)))
    # Repeated ids with other and with equal texts, rows without an id, null, empty and blank texts, letters beyond ASCII.
    rows += [(3, rows[5][1]), (7, rows[7][1]), (None, rows[9][1]), (None, rows[10][1]), (200, None), (201, ""), (202, " \n\t\n"),
             (203, "é ü ö é ü ö é"), (204, "é ü ö é ü ö é"), (205, "1 2 3\n}\nend"), (206, "1 2 3\n}\nend")]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_dropped_lines_equal_plain_version(spark, seed):
    rows = random_rows(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, t, "l", 5, 6) for i, t in rows], SCHEMA).repartition(5)
    got = line_dedup.drop_lines(df, keep=["line", "first"])
    assert {(r.line, r.first) for r in got.collect()} == {("l", 5)}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    expected = sorted(plain(rows), key=key)
    assert sorted(((r.id, r.text, r.n_dropped) for r in got.collect()), key=key) == expected
    assert sum(n for _, _, n in expected) > 40


def test_a_line_whose_neighbours_have_larger_templates_is_found(spark):
    """The first four lines share most with each other, the last one shares with two of them only."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxy"][:23]
    def line(*changes):
        return " ".join("other" if p in changes else w for p, w in enumerate(words))
    rows = [(0, line(4, 5)), (1, line(5, 6)), (2, line(4, 6)), (3, line(4, 9)), (4, line(4, 9, 12)), (5, line(9, 12, 14))]
    df = spark.createDataFrame([(i, t, "l", 5, 6) for i, t in rows], SCHEMA)
    got = {r.id: r.n_dropped for r in line_dedup.drop_lines(df).collect()}
    assert got == {i: n for i, _, n in plain(rows)} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}
