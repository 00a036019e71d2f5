"""Session helpers.

The library never creates a session on its own inside operators; callers pass
DataFrames.  ``local_session`` is for tests and the bench, ``checkpoint_dir``
reads the shared checkpoint folder the cluster configured.
"""

from __future__ import annotations

import tempfile

from pyspark.errors import PySparkAttributeError, PySparkNotImplementedError
from pyspark.sql import SparkSession

# Settings that matter for every job in the library.  AQE re-plans joins at
# runtime (broadcast by measured size, skew split, partition coalescing).
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cohortlab") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the configured checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only local runs (tests, bench) fall back to a fresh temp folder.
    """
    try:
        sc = spark.sparkContext
    except (PySparkAttributeError, PySparkNotImplementedError):         # a remote session has the setting or none
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share") from None
        return current
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="cohortlab-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_SHIPPED: set[str] = set()
_ZIP: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make ``cohortlab`` importable on the executors' Python workers.

    Pandas UDFs and ``mapInPandas`` functions refer to library functions by
    module; a zip of the package is added with ``addPyFile`` once per
    application (what a cluster deployment does with ``--py-files``).
    """
    import os
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except (PySparkAttributeError, PySparkNotImplementedError):         # remote sessions ship code differently
        return
    if app in _SHIPPED:
        return
    if not _ZIP:
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="cohortlab-pkg-"), "cohortlab.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        _ZIP.append(out)
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(app)
