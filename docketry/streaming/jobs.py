"""Structured Streaming forms: incremental runs, notifications once each, windowed counts."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists, new_folder

log = logging.getLogger(__name__)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of parquet files, or one file, as a stream with the files' own schema."""
    schema = spark.read.parquet(path).schema
    if path.endswith(".parquet") and not _is_folder(spark, path):
        parent, name = path.rsplit("/", 1)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(parent)
    return spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def surviving(step: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A step whose failure is logged and ends its micro-batch, not the query."""

    def run(batch: DataFrame, no: int) -> None:
        try:
            step(batch, no)
        except Exception:
            log.exception("micro-batch %d failed", no)

    return run


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], name: str = "run", checkpoint: str | None = None) -> None:
    """One pass over what is there: each micro-batch goes through ``step``."""
    mark = checkpoint or new_folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()


def run_loop(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, minutes: float = 60):
    """The same again and again, surviving failed batches; returns the running query, ``stop()`` ends it."""
    return stream.writeStream.foreachBatch(surviving(step)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(minutes * 60)} seconds").start()


def once_each(keys: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """A step that appends the rows whose keys the table at ``path`` does not hold yet.

    What was told is kept in the table and not as state of the stream, and a batch that is run again
    finds its own rows and adds none.
    """

    def step(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        if exists(batch.sparkSession, f"{path}/_SUCCESS"):
            new = new.join(batch.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        new.write.mode("append").parquet(path)

    return step


def notifications_once(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, event_type): each assessed or acted-on entity told once, whatever is delivered again."""
    events = read_stream(spark, path).where("event_type in ('risk.assessed', 'action.created') and entity_id is not null").select("entity_id", "event_type")
    out = new_folder(spark, "told")
    run_available(events, once_each(["entity_id", "event_type"], out), "told-mark")
    return spark.read.schema(events.schema).parquet(out)


def windowed_counts(events: DataFrame, ts: str = "created_at", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and type; those later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"))
