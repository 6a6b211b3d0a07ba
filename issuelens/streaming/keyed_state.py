"""State per key, advanced batch by batch, equal to one computation over everything.

``KeyedState`` keeps three narrow tables under one commit log, a part of each per batch:

* ``events``  the rows taken in,
* ``states``  what the state says after each row, with the version that wrote it,
* ``carry``   per key the marks from which later rows go on, with the version that wrote them.

A batch reads the carry rows of its own keys and goes on from them: nothing that landed before is computed again.  Running
aggregates are range-sliced, so a key with a third of all rows is spread over tasks.  If a batch brings a row that lies
before its key's last one, that key alone is computed anew from its rows, and its older states no longer count.  A
batch is one commit: a replayed one changes nothing, one that died leaves nothing behind.

A subclass names the key, the place (order) of a row, the schemas, and says how marks are taken from rows (``marks``: one row per
key with ``first`` and ``last`` places), merged with earlier ones (``merged``) and turned into states (``states``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.operators.commit_log import CommitLog


class KeyedState:
    key: list[str]
    place: list[str]
    schemas: dict[str, str]  # of events, states (ending with version) and carry (key, last, marks, since, version)
    mark_names: list[str]

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, CommitLog(spark, root)

    # ------------------------------------------------------------------ said by the subclass
    def marks(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merged(self, name: str, new: Column, old: Column) -> Column:
        raise NotImplementedError

    def states(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        raise NotImplementedError

    # ------------------------------------------------------------------ tables
    def _same(self, left: str, right: str) -> Column:
        both = F.lit(True)
        for c in self.key:
            both = both & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        return both

    def table(self, kind: str, parts: list[str] | None = None) -> DataFrame:
        parts = self.log.manifest()["parts"] if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).parquet(*[f"{self.log.root}/{p}/{kind}" for p in parts])

    def _write(self, part: str, kind: str, rows: DataFrame) -> DataFrame:
        path = f"{self.log.root}/{part}/{kind}"
        rows.write.parquet(path)
        return self.spark.read.schema(self.schemas[kind]).parquet(path)

    def latest(self, carry: DataFrame) -> DataFrame:
        """The newest carry row of each key."""
        rest = [c for c in carry.columns if c not in self.key]
        return carry.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "version").alias("_c")).select(*self.key, "_c.*")

    # ------------------------------------------------------------------ work
    def advance(self, batch: DataFrame, name: str) -> int | None:
        """Take in the rows of a batch; None if it was taken in before."""
        if self.log.has_batch(name):
            return None
        base = self.log.manifest()
        version, part = base["version"] + 1, f"parts/{uuid.uuid4().hex}"
        given = self.spark.createDataFrame([], self.schemas["events"]).schema
        fresh = self._write(part, "events", batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in given]))
        mine = self.marks(fresh)
        keys = fresh.select(*self.key).distinct()
        known = self.table("carry", base["parts"]).alias("k").join(keys.alias("f"), self._same("k", "f"), "left_semi")
        carry = self.latest(known)
        # A row at or before its key's last one: the key is computed anew.
        late = mine.alias("m").join(carry.alias("c"), self._same("m", "c")).where(F.col("m.first") <= F.col("c.last"))
        late = late.select(*[F.col(f"m.{c}") for c in self.key])
        path = f"{self.log.root}/{part}/late"
        late.write.parquet(path)
        late = self.spark.read.schema(late.schema).parquet(path)
        again = late.limit(1).count() > 0
        rows, seed = fresh, carry
        if again:
            whole = self.table("events", [*base["parts"], part]).alias("e").join(late.alias("l"), self._same("e", "l"), "left_semi")
            rows = fresh.alias("e").join(late.alias("l"), self._same("e", "l"), "left_anti").unionByName(whole)
            seed = carry.alias("e").join(late.alias("l"), self._same("e", "l"), "left_anti")
        self._write(part, "states", self.states(rows, seed).withColumn("version", F.lit(version).cast("bigint")))
        after = (self.marks(rows) if again else mine).drop("first").alias("m").join(seed.alias("c"), self._same("m", "c"), "left")
        after = after.join(late.withColumn("_late", F.lit(True)).alias("l"), self._same("m", "l"), "left")
        since = F.when(F.col("l._late"), F.lit(version)).otherwise(F.coalesce("c.since", F.lit(0))).cast("bigint")
        self._write(part, "carry", after.select(
            *[F.col(f"m.{c}") for c in self.key], F.greatest("m.last", "c.last").alias("last"),
            *[self.merged(x, F.col(f"m.{x}"), F.col(f"c.{x}")).alias(x) for x in self.mark_names],
            since.alias("since"), F.lit(version).cast("bigint").alias("version")))
        return self.log.commit([part], batch=name, parent=base["version"])

    def _counting(self, parts: list[str]) -> DataFrame:
        anew = self.latest(self.table("carry", parts)).where("since > 0").select(*self.key, "since")
        held = self.table("states", parts).alias("s").join(anew.alias("a"), self._same("s", "a"), "left")
        return held.where("a.since IS NULL OR s.version >= a.since").select("s.*")

    def read(self) -> DataFrame:
        """The state after every row taken in."""
        return self._counting(self.log.manifest()["parts"]).drop("version")

    def now(self) -> DataFrame:
        """The newest carry row of every key."""
        return self.latest(self.table("carry"))

    def compact(self) -> int:
        """One part of each table: all rows, the states that count, the newest carry rows."""
        base, part = self.log.manifest(), f"parts/{uuid.uuid4().hex}"
        self._write(part, "events", self.table("events", base["parts"]))
        self._write(part, "states", self._counting(base["parts"]))
        self._write(part, "carry", self.latest(self.table("carry", base["parts"])))
        return self.log.commit([part], replace=True, parent=base["version"])
