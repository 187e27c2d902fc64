"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Settings the library depends on for correct and scalable plans.
#  - AQE re-plans joins (broadcast vs sort-merge) from runtime sizes, splits skewed
#    join partitions and coalesces small shuffle partitions.
#  - UTC session time zone keeps year() stable across clusters.
#  - The Spark UI stays off: no server is opened by our jobs.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # delete checkpoint files once the checkpointed DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # keep the driver's status store small in long sessions (no UI reads it)
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "200",
    "spark.ui.retainedStages": "200",
    "spark.ui.retainedTasks": "10000",
}

_LOCAL_SCRATCH: dict[str, str] = {}      # application id -> scratch folder of a local session


def build_session(master: str | None = None, app_name: str = "parcelspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables: ``spark.checkpoint.dir``.

    A session that leaves it unset gets one private scratch folder for its whole life, but only
    on a local master, where one machine runs everything. Off local mode an unset folder is an
    error: executors on other machines could not read a folder of this one.
    """
    target = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if target is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="parcelspark-ckpt-")
        target = _LOCAL_SCRATCH[context.applicationId]
    context.setCheckpointDir(target)
    return target


def stored(df, label: str):
    """Write ``df`` as Parquet to a folder of its own under the checkpoint folder and reread it.

    Like ``materialize``, for tables that later passes read in part: columns and rows are pruned.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_together(tables: dict) -> dict:
    """``stored`` for independent tables (label -> function that makes the DataFrame), side by side: their
    jobs share the cluster instead of waiting for one another's last tasks and plans."""
    with ThreadPoolExecutor(max_workers=max(1, len(tables))) as pool:
        running = {label: pool.submit(lambda make=make, label=label: stored(make(), label)) for label, make in tables.items()}
        return {label: job.result() for label, job in running.items()}


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and continue from the written copy.

    Used where one input feeds several passes (group sizes, counts, medians): the upstream joins
    run once instead of once per pass, and a lost executor re-reads the files instead of
    recomputing the lineage. Prune columns before calling: nothing is pruned through a checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: float, total_cores: int, *, target_partition_bytes: int = 256 << 20) -> dict:
    """Partitioning settings for a given input volume and cluster size.

    Shuffle partitions are sized so one partition holds about ``target_partition_bytes`` of the
    input (never fewer than 3 waves of tasks over all cores); AQE then coalesces small ones and
    splits skewed ones against the same advisory size. Scan splits use the same target, so a task
    reads about one partition's worth. At 100 TB on 1,000 executors x 8 cores this gives about
    400,000 shuffle partitions of 256 MB.
    """
    partitions = max(3 * total_cores, int(input_bytes // target_partition_bytes) + 1)
    size = str(target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(target_partition_bytes // 8),
    }
