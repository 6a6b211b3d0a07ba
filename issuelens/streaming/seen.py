"""Memory of delivered ids over a horizon the caller names.

``SeenDeliveries`` keeps every id of the last ``horizon`` in a table of buckets (by hash of the id) under a commit log, one part per
batch, and beside each part a Bloom filter: a few bits per id, packed by bucket of bits into 4 kB bitmaps.  A batch is
first held against the filters; only ids that all bits call seen are looked up, and only in their buckets' files.  So an
ordinary batch of new ids reads no old id, and a redelivery is recognised exactly, a day or a month later.

A batch is recorded by one commit together with its verdicts' basis: asked again for the same batch, the memory answers as
before.  ``compact`` drops what is older than the horizon and adds the parts up, so the state on disk is bounded by the ids of one
horizon.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.operators.commit_log import CommitLog

BUCKETS = 64
HASHES = 3
BITS_PER_ID = 16  # with three hashes about one new id in 200 is looked up for nothing
PAGE = 32_768  # bits in a bitmap
IDS = "delivery_id bigint, ts timestamp, batch string, bucket int"
FILTER = "bits bigint, page bigint, map binary"
PARTS = 16


def _places(bits: Column) -> Column:
    """The bits an id sets in a filter of ``bits`` bits."""
    return F.array(*[F.pmod(F.xxhash64("delivery_id", F.lit(k)), bits) for k in range(HASHES)])


class SeenDeliveries:
    def __init__(self, spark: SparkSession, root: str, horizon: str = "30 days", buckets: int = BUCKETS, parts: int = PARTS):
        self.spark, self.log = spark, CommitLog(spark, root)
        self.horizon, self.buckets, self.parts = F.expr(f"INTERVAL {horizon}"), buckets, parts

    def _paths(self, kind: str) -> list[str]:
        return [f"{self.log.root}/{p}/{kind}" for p in self.log.manifest()["parts"]]

    def ids(self) -> DataFrame:
        """Everything remembered."""
        found = [self.spark.read.schema(IDS).parquet(p) for p in self._paths("ids")]
        out = self.spark.createDataFrame([], IDS)
        for f in found:
            out = out.unionByName(f)
        return out

    def _record(self, ids: DataFrame) -> str:
        """Write a part: the ids by bucket, and their filter."""
        part = f"parts/{uuid.uuid4().hex}"
        path = f"{self.log.root}/{part}"
        bucket = F.pmod(F.xxhash64("delivery_id"), F.lit(self.buckets)).cast("int")
        ids.select("delivery_id", "ts", "batch", bucket.alias("bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/ids")
        written = self.spark.read.schema(IDS).parquet(f"{path}/ids")
        bits = max(1, -(-written.count() * BITS_PER_ID // PAGE)) * PAGE
        at = written.select(F.explode(_places(F.lit(bits))).alias("at"))
        maps = at.groupBy(F.expr(f"at div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(at % {PAGE})").alias("map"))
        maps.select(F.lit(bits).cast("bigint").alias("bits"), "page", "map").write.parquet(f"{path}/filter")
        return part

    def _maybe(self, batch: DataFrame, path: str) -> DataFrame:
        """The ids of the batch that a part's filter calls seen."""
        maps = self.spark.read.schema(FILTER).parquet(path)
        first = maps.agg(F.max("bits")).first()[0]
        if first is None:
            return batch.select("delivery_id").where(F.lit(False))
        at = batch.select("delivery_id", F.explode(_places(F.lit(first))).alias("at")).withColumn("page", F.expr(f"at div {PAGE}"))
        byte = F.conv(F.hex(F.expr(f"substring(map, cast(at % {PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hit = F.expr("cast(at % 8 as int)")
        tested = at.join(maps.select("page", "map"), "page", "left").withColumn("byte", F.coalesce(byte, F.lit(0)))
        on = tested.withColumn("on", F.call_function("shiftright", F.col("byte"), hit).bitwiseAND(F.lit(1)))
        return on.groupBy("delivery_id").agg(F.min("on").alias("all")).where("all = 1").select("delivery_id")

    def fresh(self, batch: DataFrame, name: str) -> DataFrame:
        """One row (delivery_id, ts) for each id of the batch (delivery_id, ts) that was not delivered within the horizon before.

        The ids are recorded under the batch's name; a second call with that name gives the same rows.  A null id says nothing
        about its delivery: it is neither recorded nor returned.
        """
        ids = batch.where(F.col("delivery_id").isNotNull()).groupBy("delivery_id").agg(F.min(F.col("ts").cast("timestamp")).alias("ts"))
        path = f"{self.log.root}/scratch/{uuid.uuid4().hex}"
        ids.write.parquet(path)
        ids = self.spark.read.schema("delivery_id bigint, ts timestamp").parquet(path)
        if self.log.has_batch(name):
            return ids.join(self.ids().where(F.col("batch") == name).select("delivery_id"), "delivery_id", "left_semi")
        bucket = F.pmod(F.xxhash64("delivery_id"), F.lit(self.buckets)).cast("int")
        seen = None
        for maps, where in zip(self._paths("filter"), self._paths("ids")):
            maybe = ids.join(self._maybe(ids, maps), "delivery_id", "left_semi").withColumn("bucket", bucket)
            old = self.spark.read.schema(IDS).parquet(where).select("delivery_id", "bucket", F.col("ts").alias("before"))
            # The few looked-up ids prune the old table to their buckets' folders.
            known = old.join(maybe, ["bucket", "delivery_id"]).where(F.col("before") >= F.col("ts") - self.horizon).select("delivery_id")
            seen = known if seen is None else seen.unionByName(known)
        new = ids if seen is None else ids.join(seen.distinct(), "delivery_id", "left_anti")
        part = self._record(new.withColumn("batch", F.lit(name)))
        self.log.commit([part], batch=name)
        if len(self.log.manifest()["parts"]) > self.parts:
            self.compact()
        return ids.join(self.ids().where(F.col("batch") == name).select("delivery_id"), "delivery_id", "left_semi")

    def compact(self) -> int:
        """One part with the ids of the last horizon (counted back from the newest)."""
        base = self.log.manifest()["version"]
        every = self.ids()
        newest = every.agg(F.max("ts")).first()[0]
        part = self._record(every.where(F.col("ts") >= F.lit(newest) - self.horizon))
        return self.log.commit([part], replace=True, parent=base)
