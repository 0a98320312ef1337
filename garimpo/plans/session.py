"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions, turns small sides into broadcasts once
# their real size is known and splits skewed join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    # The JVM leaves methods beyond 8,000 bytes of code uncompiled. Operators whose fused
    # code would be larger, like the wide lead rows, run unfused and compiled instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Label sets per company are tiny: aggregate them in memory well beyond the default
    # of 128 companies per task before falling back to a sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def build_session(
    app_name: str = "garimpo",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Session with the settings above.

    On a cluster leave ``master`` to spark-submit and set ``shuffle_partitions`` to a
    few times the number of cores: adaptive execution only ever merges partitions.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS, **extra)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may do without: it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="garimpo-"))
    return context.getCheckpointDir().rstrip("/")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/garimpo/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read it back even if executors are lost."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()
