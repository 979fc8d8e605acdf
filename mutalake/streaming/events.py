"""Run events as a stream: JSON lines with one wide schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mutalake.operators.outcomes import STATUSES
from mutalake.operators.rank import with_place

EVENT_SCHEMA = "event string, run_id string, total int, jobs int, completed int, id string, status string, duration_ms long, exit_code int, operator string, file string, line int, column int, finished_at long, killed int, survived int, timeout int, error int"


#: How long after a mutant's first event another one of it may come; older keys leave the state.
REPEATS_WITHIN = "2 days"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The events of a folder, with the time at which their file was written as ingested_at."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return raw.select("*", F.col("_metadata.file_modification_time").alias("ingested_at"))


def finished(events: DataFrame) -> DataFrame:
    """One row a finished mutant of a run; a stream drops repeats that come within REPEATS_WITHIN and keeps no older state."""
    done = events.where("event = 'mutant_finished'")
    if events.isStreaming:
        return done.withWatermark("ingested_at", REPEATS_WITHIN).dropDuplicatesWithinWatermark(["run_id", "id"])
    return done.dropDuplicates(["run_id", "id"])


def status_counts(events: DataFrame) -> DataFrame:
    """Running counts by status; the same rows as the batch aggregate over the same events."""
    return finished(events).where(F.col("status").isin(*STATUSES)).groupBy("status").agg(F.count("*").alias("n"))


def count_available(spark: SparkSession, folder: str, name: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes all files there are, keeps its counts in a memory table and ends."""
    counts = status_counts(read_events(spark, folder))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Copy a stream of events to JSON lines, exactly once."""
    return events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_run(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Number the finished mutants of a run as they come, in the order in which their probes ended, and count them by status.

    Each batch of new events is written to out/batch=…, with completed going on from the batches before;
    a batch that runs again, as after a lost driver, replaces itself. Takes all events there are and ends; started again it goes on.
    """

    def number(batch: DataFrame, k: int) -> None:
        session = batch.sparkSession
        here = finished_batches(session, out)
        before = 0 if here is None else here.where(F.col("batch") < k).count()
        rows = batch
        if here is not None:
            known = here.where(F.col("batch") < k).select(F.col("run_id").alias("known_run"), F.col("id").alias("known_id"))
            rows = batch.join(known, F.col("run_id").eqNullSafe(F.col("known_run")) & (F.col("id") == F.col("known_id")), "left_anti")
        placed = with_place(rows.dropDuplicates(["run_id", "id"]), [F.asc("finished_at"), F.asc("id")], "completed")
        placed.withColumn("completed", F.col("completed") + before).write.mode("overwrite").json(f"{out}/batch={k}")

    done = read_events(spark, folder).where("event = 'mutant_finished'").drop("completed", "ingested_at")
    return done.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished_batches(spark: SparkSession, out: str) -> DataFrame | None:
    """What follow_run has written; None before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{EVENT_SCHEMA.replace('completed int', 'completed long')}, batch long").json(out)
