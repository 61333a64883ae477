"""Session construction and cluster-level settings.

On a cluster the session is created by the platform; ``get_spark`` only fills
in settings that are unset, so a cluster's own choices (shuffle partitions,
checkpoint folder) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings this library relies on.  AQE re-plans joins at runtime from real
# sizes (broadcast only when the measured side is small), coalesces small
# shuffle partitions and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
    # remove checkpoint files of the distributed ranking once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "orderlens") -> SparkSession:
    """The active session, or a new one; library defaults fill only settings that
    neither the platform (spark-defaults, submit options) nor the caller set."""
    from pyspark import SparkConf

    existing = SparkSession.getActiveSession()
    if existing is None:
        present = SparkConf()  # loads spark-defaults / submit-time settings
        builder = SparkSession.builder.appName(app_name)
        if master and not present.contains("spark.master"):
            builder = builder.master(master)
        wanted = dict(DEFAULTS)
        wanted["spark.driver.memory"] = os.environ.get("ORDERLENS_DRIVER_MEMORY", "16g")
        if shuffle_partitions:
            wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
        for k, v in wanted.items():
            if not present.contains(k):
                builder = builder.config(k, v)
        spark = builder.getOrCreate()
    else:
        spark = existing
        for k, v in DEFAULTS.items():
            if spark.conf.get(k, None) is None:
                try:
                    spark.conf.set(k, v)
                except Exception:  # static settings of a running session stay as they are
                    pass
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (a cluster names a shared folder
    there).  Only when it is unset -- local runs and tests -- a fresh scratch
    folder is created and registered.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="orderlens-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``orderlens`` importable in the Python workers (needed by operators that
    run Python per group, such as the stateful audit stream): the package is zipped
    once per SparkContext and distributed with ``addPyFile``, as ``--py-files`` would."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="orderlens-pkg-")
    archive = shutil.make_archive(os.path.join(stage, "orderlens"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(archive)
    _SHIPPED.add(key)
