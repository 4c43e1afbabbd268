"""Running a stream over files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import new_folder


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New parquet files of a folder, a bounded number in each micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, write it beside the stream's checkpoint, and read it back.

    Both lie in the shared folder of the session, so any executor can take over.
    """
    spark = stream.sparkSession
    base = new_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
