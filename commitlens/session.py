"""Session construction and shared scratch locations.

Scratch data (streaming checkpoints, written intermediate tables) always lives
under the folder the cluster names in ``spark.checkpoint.dir`` (or that
``SparkContext.setCheckpointDir`` set).  Only a local master may do without one;
then a folder under /tmp is created and registered.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale; all of them are plain Spark SQL confs.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming dedup / window state lives in RocksDB (disk-backed), not on the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "commitlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
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


def recommended_conf(input_bytes: int, executors: int, cores_per_executor: int,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Cluster sizing from the input volume (a starting point; AQE refines it).

    * shuffle partitions: about one per ``target_partition_bytes`` of input, at
      least 3 waves of the cluster's cores, so that one reduce task sorts and
      spills a bounded amount; AQE then coalesces small ones and splits skewed
      ones (``advisoryPartitionSizeInBytes``);
    * scan splits of 256 MiB keep map tasks in the same size class;
    * skew: a partition 5x the median and above 512 MiB is split.

    Example: 100 TB on 1000 executors x 8 cores -> about 370k shuffle partitions.
    """
    cores = executors * cores_per_executor
    parts = max(3 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    With a local master and none set, a temporary one is created.  On a
    cluster a machine-local folder would lose data, so it must be set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="commitlens-ckpt-", dir="/tmp")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the checkpoint folder."""
    return f"{checkpoint_root(spark)}/commitlens/{name}-{uuid.uuid4().hex[:12]}"
