"""Commit log: unfinished parts, kills between steps, races, repeated batches, resume; newest rows per key."""

import random

import pytest
from pyspark.sql import functions as F

from issuelens.operators import collect as CO
from issuelens.operators.commit_log import CommitLog, Conflict, collect_run, remaining


class Kill(RuntimeError):
    pass


def rows(spark, lo, hi):
    return spark.range(lo, hi).toDF("n")


def numbers(df):
    return sorted(r.n for r in df.collect())


def test_unfinished_parts_are_ignored(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        log.read()
    assert log.read(schema="n long").count() == 0
    log.write(rows(spark, 0, 3))
    # Killed at each step of a write: the part's files, the part itself, the draft of the manifest, the rename.
    for name in ("stage", "commit", "_rename"):
        with monkeypatch.context() as m:
            m.setattr(CommitLog, name, lambda *a, **k: (_ for _ in ()).throw(Kill()))
            with pytest.raises(Kill):
                log.write(rows(spark, 100, 105))
        assert numbers(log.read()) == [0, 1, 2] and log.versions() == [1]
    broken = tmp_path / "t" / "parts" / "half" / "_temporary"
    broken.mkdir(parents=True)
    assert numbers(log.read()) == [0, 1, 2]
    assert log.write(rows(spark, 3, 5)) == 2 and numbers(log.read()) == [0, 1, 2, 3, 4]
    assert numbers(log.read(1)) == [0, 1, 2]


def test_batches_are_written_once_and_races_lose_nothing(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path / "t"))
    assert log.write(rows(spark, 0, 3), batch="a") == 1
    assert log.write(rows(spark, 0, 3), batch="a") is None
    # Another writer takes version 2 between our look at the log and our rename.
    other, real = CommitLog(spark, str(tmp_path / "t")), CommitLog._rename
    raced = []

    def rename(self, source, target):
        if not raced:
            raced.append(1)
            other.write(rows(spark, 50, 52), batch="other")
        real(self, source, target)

    monkeypatch.setattr(CommitLog, "_rename", rename)
    assert log.write(rows(spark, 3, 5), batch="b") == 3
    monkeypatch.undo()
    assert numbers(log.read()) == [0, 1, 2, 3, 4, 50, 51]
    assert log.compact() == 4 and len(log.manifest()["parts"]) == 1 and numbers(log.read()) == [0, 1, 2, 3, 4, 50, 51]
    assert log.write(rows(spark, 0, 3), batch="a") is None  # a compaction forgets no batch
    with pytest.raises(Conflict):
        log.commit([], parent=2)
    assert log.write(rows(spark, 7, 8), replace=True) == 5 and numbers(log.read()) == [7]


def test_resume_collects_exactly_what_was_lost(spark, tmp_path, monkeypatch):
    data = spark.createDataFrame([(f"r{i % 10}", i) for i in range(100)], "repo string, n long")
    configured = spark.createDataFrame([(f"r{i}",) for i in range(12)], "repo string")  # r10 and r11 have no issues
    asked = []

    def fetch(repos):
        asked.append({r.repo for r in repos.collect()})
        return data.join(repos, "repo", "left_semi")

    log = CommitLog(spark, str(tmp_path / "t"))
    real, left = CommitLog.commit, [2]

    def commit(self, *args, **kwargs):
        if not left[0]:
            raise Kill
        left[0] -= 1
        return real(self, *args, **kwargs)

    monkeypatch.setattr(CommitLog, "commit", commit)
    with pytest.raises(Kill):
        collect_run(log, "one", configured, fetch, waves=4)
    monkeypatch.undo()
    done = {r.repo: r.n for r in log.completed("one").collect()}
    assert 0 < len(done) < 10 and set(done.values()) == {10}
    lost = {r.repo for r in remaining(log, "one", configured).collect()}
    assert lost == {f"r{i}" for i in range(12)} - set(done)
    asked.clear()
    got = collect_run(log, "one", configured, fetch, waves=4)
    assert set().union(*asked) == lost and sum(map(len, asked)) == len(lost)
    assert numbers(got) == list(range(100))
    assert numbers(collect_run(log, "one", configured, fetch, waves=4)) == list(range(100))  # nothing is left to do
    assert {r.repo for r in remaining(log, "one", configured).collect()} == {"r10", "r11"}
    log.compact()
    assert {r.repo for r in remaining(log, "one", configured).collect()} == {"r10", "r11"}
    assert collect_run(log, "two", configured, fetch, waves=2).count() == 200  # another run collects anew


@pytest.mark.parametrize("n", [1, 3, 8, 1000])
def test_newest_per_key_equals_sorting(spark, n):
    rng = random.Random(n)
    data = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, "2024-01-0%d" % rng.randrange(1, 9)]), rng.randrange(5), "b%d" % rng.randrange(2))
            for _ in range(200)]
    df = spark.createDataFrame(data, "repo string, created_at string, number long, body string")
    got = CO.newest_per_key(df, ["repo"], ["created_at", "number"], n, salts=3).collect()
    key = lambda r: (r[1] is not None, r[1] or "", r[2])
    for repo in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == repo), key=key, reverse=True)[:n]
        kept = sorted((tuple(r) for r in got if r.repo == repo), key=key, reverse=True)
        assert list(map(key, kept)) == list(map(key, mine))
        pool = [r for r in data if r[0] == repo]
        for r in set(kept):
            assert kept.count(r) <= pool.count(r)


def test_no_body_in_the_windows_of_the_cap(spark):
    df = spark.createDataFrame([("r", "t", 1, "b", False, "open", 0)], "repo string, created_at string, number long, body string, _is_pr boolean, state string, comments long")
    plan = CO.collect_issues(df, max_per_repo=5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line or "WindowGroupLimit" in line]
    assert windows and not any("body" in line for line in windows)
    assert df.where("false").transform(lambda d: CO.collect_issues(d)).agg(F.count("*")).first()[0] == 0
