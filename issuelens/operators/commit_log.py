"""Tables made of immutable parts and a log of commits.

``CommitLog(spark, root)`` keeps parts under ``root/parts`` and one small manifest per version under ``root/commits``.  A writer
first writes its parts in full and then adds the manifest that names them: the file is written beside the log and
renamed to the next version's name, which fails if another writer took it.  A manifest therefore exists whole or not at all.
Readers take the newest manifest and the parts it lists, so parts of a job that died, or is still writing, are never
read, and earlier versions stay readable.

A commit may bear the name of its batch: a batch that is committed already is not written again, so a repeated job adds
nothing twice.  It may also carry completion records: a part with the keys (repositories) whose rows it holds.  As rows
and records appear with one manifest, "written" and "marked as done" cannot come apart (see ``collect_run``).

Every manifest lists all parts of its version, one line each; ``compact`` replaces them by one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet", schema=None, options: dict | None = None):
        self.spark, self.root, self.fmt, self.schema, self.options = spark, root.rstrip("/"), fmt, schema, options or {}

    # ------------------------------------------------------------------ files
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")  # noqa: SLF001

    def _fs(self):
        return self._path("commits").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _rename(self, source: str, target: str) -> None:
        """Rename that fails if the target exists."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway  # noqa: SLF001
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(source).toUri(), conf)
        context.rename(self._path(source), self._path(target), gateway.new_array(kind, 0))

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (default: the newest); an empty one where nothing is committed."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version:
            return {"version": 0, "parts": [], "records": [], "batch": None}
        stream = self._fs().open(self._path(f"commits/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
        finally:
            stream.close()

    # ------------------------------------------------------------------ writing
    def stage(self, df: DataFrame, records: bool = False) -> str:
        """Write a part; nobody reads it before a commit names it."""
        name = f"parts/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        if records:
            df.write.parquet(path)
        else:
            df.write.options(**self.options).format(self.fmt).save(path)
        return name

    def commit(self, parts: Iterable[str], replace: bool = False, batch: str | None = None, records: Iterable[str] = (),
               parent: int | None = None) -> int:
        """Add a version with these parts (``replace``: with no others).  ``parent``: fail unless it is the newest version."""
        base = self.manifest()
        if parent is not None and parent != base["version"]:
            raise Conflict(f"version {base['version']} is newer than {parent}")
        version = base["version"] + 1
        body = {
            "version": version, "batch": batch,
            "parts": [*([] if replace else base["parts"]), *parts],
            "records": [*([] if replace else base["records"]), *records],
        }
        draft = f"drafts/{uuid.uuid4().hex}"
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        out = fs.create(self._path(draft))
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        target = f"commits/{version:012d}.json"
        try:
            self._rename(draft, target)
        except Exception as e:
            if fs.exists(self._path(target)):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise
        return version

    def has_batch(self, batch: str) -> bool:
        if not self.versions():
            return False
        return self.spark.read.schema("batch string").json(f"{self.root}/commits").where(F.col("batch") == batch).limit(1).count() > 0

    def write(self, df: DataFrame, batch: str | None = None, replace: bool = False, retries: int = 20) -> int | None:
        """Stage and commit; None if the batch is there already.  A lost race for a version is tried again on the next one."""
        if batch is not None and self.has_batch(batch):
            return None
        part = self.stage(df)
        for _ in range(retries):
            if batch is not None and self.has_batch(batch):
                return None  # a second run of the same batch was faster; our part stays unnamed
            try:
                return self.commit([part], replace, batch)
            except Conflict:
                continue
        raise Conflict(f"{retries} versions were lost to other writers")

    def compact(self) -> int:
        """One part instead of many, unless somebody commits meanwhile."""
        base = self.manifest()
        records = [self.stage(self._records(base), records=True)] if base["records"] else []
        return self.commit([self.stage(self.read(base["version"]))], True, records=records, parent=base["version"])

    # ------------------------------------------------------------------ reading
    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version (default: the newest)."""
        parts = self.manifest(version)["parts"]
        schema = schema or self.schema
        if not parts:
            if schema is None:
                raise FileNotFoundError(f"{self.root}: nothing is committed and no schema is given")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.options(**self.options).format(self.fmt)
        return (reader.schema(schema) if schema else reader).load([f"{self.root}/{p}" for p in parts])

    def _records(self, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in manifest["records"]])

    def completed(self, run: str) -> DataFrame:
        """Rows (repo, n): what ``run`` has committed."""
        base = self.manifest()
        if not base["records"]:
            return self.spark.createDataFrame([], "repo string, n bigint")
        return self._records(base).where(F.col("run") == run).groupBy("repo").agg(F.sum("n").alias("n"))


def remaining(log: CommitLog, run: str, configured: DataFrame) -> DataFrame:
    """Configured repositories (column ``repo``) that the run has not committed; as in the reference, one without rows stays open."""
    return configured.join(log.completed(run), "repo", "left_anti")


def collect_run(log: CommitLog, run: str, configured: DataFrame, fetch: Callable[[DataFrame], DataFrame], waves: int = 8) -> DataFrame:
    """Collect every configured repository that ``run`` has not committed yet, wave by wave, and return the log's rows.

    ``fetch`` takes a table of repositories and returns their rows (with a column ``repo``).  A wave's rows and its completion
    records become visible with one manifest: after a crash anywhere, the same call collects exactly what was lost.
    Waves are fixed by hash of the repository; more waves lose less, fewer cost less.
    """
    for wave in range(waves):
        mine = configured.where(F.pmod(F.xxhash64("repo"), F.lit(waves)) == wave)
        todo = remaining(log, run, mine)
        part = log.stage(fetch(todo))
        written = log.spark.read.format(log.fmt).options(**log.options)
        written = (written.schema(log.schema) if log.schema else written).load(f"{log.root}/{part}")
        done = written.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).select("repo", "n", F.lit(run).alias("run"))
        records = log.stage(done, records=True)
        if log.spark.read.parquet(f"{log.root}/{records}").limit(1).count():
            log.commit([part], records=[records])
    return log.read()
