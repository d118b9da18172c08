"""Session construction shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitting environment supplies its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rostrum")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def widened(df: DataFrame) -> DataFrame:
    """Dealt out to all cores if it has fewer partitions than there are cores: texts in one row group are one task otherwise.

    Large tables have more partitions than that and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of our own only in local mode without a name."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="rostrum-checkpoint-")
        sc.setCheckpointDir(named)
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``df`` has it (Spark doesn't tell cases apart)."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name
