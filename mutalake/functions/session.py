"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's; one is made only on one machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mutalake-")
        context.setCheckpointDir(folder)
    return folder


#: Rows of a task that sorts and groups them.
ROWS = 500_000


def tasks_for(stored: DataFrame) -> int | None:
    """Tasks of about ROWS rows each; null where the session's number of them will do. The rows are counted, so it's for stored tables."""
    tasks = -(-stored.count() // ROWS)
    return tasks if tasks > int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by its keys in so many tasks; as it is for null, so that its joins and groups take the session's number."""
    return df.repartition(tasks, *keys) if tasks else df


def release(df: DataFrame) -> None:
    """Delete the shuffle files of a plan whose result has been written."""
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, its lineage cut and its shuffle files deleted."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint(eager=True)
    release(df)
    return done


def discard(spark: SparkSession, at: str) -> None:
    """Delete an intermediate table, if the session still lives."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
