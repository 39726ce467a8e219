"""Session construction and the shared scratch location.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by
whoever runs the cluster). Only in local mode, with nothing configured (tests), is a
temp folder made, and removed at exit; anywhere else that is an error.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from hashlib import sha256
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # PySpark 4 captures a Python call site (extra JVM round trips) for every
    # Column call; plans here are built from hundreds of Column calls.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Runtime SQL settings for a large cluster (all settable on a running session).
# Shuffle partitions start high and AQE coalesces them to the advisory size;
# skewed join and rebalance partitions are split; streaming state lives in
# RocksDB; Arrow batches to the responder stay small so a slow model call
# holds little memory.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions": "true",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Static settings: pass at submit time (``--conf``) or to ``build_session(extra=...)``.
SCALE_STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def tune_for_scale(spark: SparkSession, total_cores: int) -> SparkSession:
    """Apply ``SCALE_CONF`` and size shuffle partitions to the cluster
    (3 per core; AQE merges them down when stages are small)."""
    for k, v in SCALE_CONF.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(200, 3 * total_cores)))
    ensure_checkpoint_dir(spark)
    return spark


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "traitgrid", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return ship_package(spark)


#: Spark removes the shuffle files of a query at its end (else when the driver happens to collect its garbage).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def configured(spark: SparkSession, conf: dict[str, str]):
    """The session's settings are ``conf`` meanwhile, and as before after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the workers this package, so that functions sent to them can import
    it wherever the driver was started. The driver zips its own source files and
    Spark hands the archive out; done once per application."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: artifacts are added by the client that owns the session
        return spark
    root = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not root.is_dir():
        return spark
    files = sorted(p for p in root.rglob("*.py"))
    mark = sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    path = os.path.join(tempfile.mkdtemp(prefix="traitgrid-ship-"), f"{root.name}-{mark}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder; create a local one only
    when none is configured (tests, single machine)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; use the session setting
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return path
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="traitgrid-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (falls back to the shuffle partition setting)."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared checkpoint folder. It is removed, with all that intermediate
    steps have written to it, when the driver ends."""
    base = ensure_checkpoint_dir(spark)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's owner removes what is left
        return base
    if sc.applicationId not in _scratch:
        path = os.path.join(base, f"traitgrid-{sc.applicationId}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _scratch[sc.applicationId] = path
    return _scratch[sc.applicationId]


def shared_path(spark: SparkSession, name: str, under: str | None = None) -> str:
    """A fresh sub-folder of the application's folder in the shared checkpoint folder, or of one of its folders."""
    return os.path.join(under or scratch_folder(spark), f"{name}-{uuid.uuid4().hex[:12]}")
