"""Session helpers: local session for tests/bench, shared folder for durable intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "quillscope") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by executor Python workers (once per application).

    Pandas/Arrow UDFs and ``mapInPandas`` functions of this package are pickled by
    reference, so workers import ``quillscope``. The package is zipped on the driver and
    handed to ``SparkContext.addPyFile``, which distributes it with the application; no
    executor needs the source tree or a particular working directory.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg_dir)
    zip_path = os.path.join(tempfile.mkdtemp(prefix="quillscope-pyfiles-"), "quillscope.zip")
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, base))
    sc.addPyFile(zip_path)
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (a static setting of the cluster).

    Falls back to a directory already given to ``SparkContext.setCheckpointDir``; only
    when neither exists and the master is local (tests) is a scratch folder created and
    registered. A cluster without a shared folder is an error: a machine-local folder
    would not survive the loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (cluster checkpoints)")
        root = tempfile.mkdtemp(prefix="quillscope-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for one written table."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application wrote with ``scratch_path``, through the file system
    that holds them. For the end of a job: results that still read them must be consumed first.
    (Checkpoints of ``cut`` go with ``spark.cleaner.referenceTracking.cleanCheckpoints``.)"""
    n = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (eager).

    Used before iterative or many-branch work on a derived table: later plans start
    from the written data (small plans, no re-analysis of the upstream pipeline) and a
    lost executor does not force recomputation of the upstream text processing.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
