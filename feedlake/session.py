"""Session construction and the shared scratch location.

On a cluster the session arrives configured; ``checkpoint_root`` only
*reads* ``spark.checkpoint.dir``. Only a local master may do without it (tests,
local runs): it gets a private temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # delete reliable-checkpoint files once their frames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Parquet scans split at 128 MB; at 100 TB this gives ~800k scan tasks,
    # which AQE then coalesces after the first exchange.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


# Suggested settings for ~100 TB on ~1000 executors (not applied automatically;
# a cluster session arrives configured). Shuffle partitions sized for ~200 MB
# per partition after AQE coalescing, skew splitting on for joins and
# rebalances, broadcast only under a fixed size bound.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "feedlake", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOT: dict[int, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, stores and stream checkpoints.

    Uses ``spark.checkpoint.dir`` when the cluster names one; only when it is
    unset (local tests) a private temporary folder is created once per
    context and registered with ``setCheckpointDir``.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(root)  # DataFrame.checkpoint() writes under it
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(sc._jsc)
    if key not in _LOCAL_ROOT:
        _LOCAL_ROOT[key] = tempfile.mkdtemp(prefix="feedlake-ckpt-")
        sc.setCheckpointDir(_LOCAL_ROOT[key])
    return _LOCAL_ROOT[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
