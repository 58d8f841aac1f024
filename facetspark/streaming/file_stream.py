"""The stateless batch chain as a file stream.

``readStream`` over a folder of input files -> the same DataFrame transforms
-> an append-mode file sink with a checkpoint. A restart resumes from the
checkpoint and the file sink's log gives exactly-once output files; the
reference's append-as-you-go file has neither. Nothing stateful is needed, so
no watermark: each micro-batch is independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def once_by(stream: DataFrame, key: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The rows of ids not seen before, across micro-batches and restarts: a replayed file adds none.

    The ids are in the state store, which the checkpoint keeps. Without ``event_time`` they stay for
    good. With it an id is kept until the watermark (the greatest event time less ``delay``) passes
    its first row; rows older than the watermark are late and are dropped, seen or not, so ``delay`` must
    cover how late a new record may come. Of rows of one id in a batch any one is kept. A null id is one id.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    if delay is None:
        raise ValueError("a watermark needs a delay")
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def run_stream(spark: SparkSession, source_dir: str, schema: StructType, transform: Callable[[DataFrame], DataFrame],
               sink_dir: str, checkpoint_dir: str, fmt: str = "parquet", sink_format: str = "json",
               glob: str | None = None, max_files_per_trigger: int | None = None,
               timeout_s: float | None = None) -> None:
    """Process every file available now, then stop (``trigger(availableNow=True)``)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = transform(reader.load(source_dir))
    q = (stream.writeStream.format(sink_format).outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    finished = q.awaitTermination(timeout_s) if timeout_s else q.awaitTermination()
    if finished is False:
        q.stop()
        raise TimeoutError("stream did not finish in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
