"""Spark session defaults and shared-storage helpers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stormgrid") -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster the master and most settings come from spark-submit; here we
    only fill in what is unset.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster sets it; only when it is unset and the master is local (tests) do we
    pick a folder ourselves. Elsewhere a machine-local folder would lose data.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.environ.get("STORMGRID_CHECKPOINT_DIR") or "/tmp/stormgrid-checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def ship_package(spark: SparkSession) -> None:
    """Make ``stormgrid`` importable in Python workers (once per SparkContext).

    Grouped numpy work (the GEV fit) runs in executor-side Python processes,
    which import this package by name. The package is zipped on the driver and
    distributed with ``addPyFile`` -- what ``--py-files`` does at submit time.
    """
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_stormgrid_shipped", False):
        return
    import stormgrid

    pkg_dir = os.path.dirname(os.path.abspath(stormgrid.__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="stormgrid-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._stormgrid_shipped = True
