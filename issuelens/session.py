"""Spark session and shared-folder helpers.

Everything that touches storage (checkpoints, scratch tables, stream
checkpoints) lives under the shared folder the cluster names in
``spark.checkpoint.dir``.  We only pick our own folder when the session
has none (local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job on a large cluster wants; local runs override the sizes.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Keyed stream state (label state, dedup, windows) off-heap with
    # incremental checkpoints: state grows with the number of issues.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Broadcast only what is known to be small; explicit hints are used
    # for the fixed-size dimensions, everything else is planned by AQE.
    "spark.sql.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "issuelens", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # A machine-local folder only where one machine does all the work.
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="issuelens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``issuelens`` importable on executors (``--py-files`` done programmatically).

    Needed by the Python functions Spark runs on workers (the keyed label
    state); done once per SparkContext.  The zip is handed to Spark, which
    distributes it to every executor.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import issuelens

    pkg_dir = os.path.dirname(os.path.abspath(issuelens.__file__))
    out_dir = tempfile.mkdtemp(prefix="issuelens-pyfiles-")  # driver-side build artefact only
    zpath = os.path.join(out_dir, "issuelens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> str:
    """Everything a job needs before running: shared folder and the package on executors."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def shared_root(spark: SparkSession) -> str:
    """Root of the shared folder (the configured checkpoint dir itself)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    ckpt = ensure_checkpoint_dir(spark)
    return os.path.dirname(ckpt.rstrip("/"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the shared folder."""
    return f"{shared_root(spark)}/issuelens-scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """Spread CPU-heavy per-row text work over all cores.

    Only when a scan yields fewer partitions than the cluster has cores (a
    few large row groups); at scale the scan already has thousands of splits
    and this is a no-op, so no shuffle is added there.  Call on scans only.
    ``rows_a_task`` bounds the rows of a task where a narrow row of the table
    becomes a wide one: bytes on disk then say nothing about the work.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows_a_task:
        wanted = max(wanted, -(-df.count() // rows_a_task))  # from the files' footers: no column is read
    if df.rdd.getNumPartitions() < wanted:
        # Cheap filters may still be pushed below the repartition (less to
        # shuffle); operators whose filters carry expensive expressions place
        # an observation point above their projection (see observe_rows).
        return df.repartition(wanted)
    return df


def observe_rows(df: DataFrame, name: str) -> DataFrame:
    """Observation point: counts rows (a metric) and fixes the plan boundary.

    Catalyst pushes filters through projections by re-inlining their
    expressions; it does not push them through an observation.  Placed after
    an expensive projection, a later filter on its outputs reads the computed
    columns instead of evaluating the expressions a second time.
    """
    from pyspark.sql import functions as F

    return df.observe(f"{name}_{uuid.uuid4().hex[:12]}", F.count(F.lit(1)).alias("rows"))
