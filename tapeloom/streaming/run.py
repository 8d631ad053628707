"""Start streaming queries into durable tables.

Sink and checkpoint lie in the shared folder (``spark.checkpoint.dir``), so a query restarts after a lost
executor or driver where it stopped. The state functions see one key's rows of one micro-batch at a time;
``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` on the source bound them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import fresh_folder


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet folder: at a fixed interval, or once over all available input."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all available input and return its table."""
    spark = stream.sparkSession
    path = fresh_folder(spark, label)
    start(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str) -> None:
    """Run ``write`` for every micro-batch of all available input, in order, beside a checkpoint at ``path``."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an update stream over all available input and return the newest row per key.

    Each micro-batch overwrites its own folder, so a replayed batch does not double its rows.
    """
    spark = stream.sparkSession
    path = fresh_folder(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")
