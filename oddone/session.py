"""Session helpers: build a session for local runs and resolve the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints (drawn stimuli, draw stages, scored batches) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "oddone", shuffle_partitions: int | None = None,
              extra_conf: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local runs and tests)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if checkpoint_dir(spark) or (_context(spark) is not None and _is_local(_context(spark))):
        ensure_checkpoint_dir(spark)  # without one, the first operator that needs it raises
    ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None under Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return None


def _is_local(sc) -> bool:
    """One JVM on this machine (``local-cluster`` is not: its executors are processes of their own)."""
    return sc.master == "local" or sc.master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names (``spark.checkpoint.dir``), if any."""
    sc = _context(spark)
    d = sc.getCheckpointDir() if sc is not None else None
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Use the configured checkpoint folder; a local master without one (tests) gets a temporary folder.

    On a cluster that names none this raises: a folder on the driver's disk is not seen by the executors."""
    sc = _context(spark)
    d = checkpoint_dir(spark)
    if sc is None:
        return d
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not _is_local(sc):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="oddone-ckpt-")
    sc.setCheckpointDir(d)
    return d


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``oddone`` importable in Python workers (``addPyFile`` of a zip of the package),
    once per SparkContext; needed by the pandas-based steps on any cluster."""
    import os
    import zipfile

    sc = _context(spark)
    key = sc.applicationId if sc is not None else id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="oddone-pkg-"), "oddone.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)
