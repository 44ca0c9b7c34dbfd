"""Structured Streaming over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import ensure_checkpoint_dir


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A folder or file of Parquet log lines as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    if next(iter(spark.read.parquet(path).inputFiles()), "").endswith(f"/{name}"):  # one file
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, time: str, kind: str, value: str, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Counts and sums by kind in tumbling windows; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def first_by_key(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once, as far as repeats arrive within ``late``; state older than that is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and gives what it wrote, from a table in the shared
    checkpoint folder: rows as they come in append mode, the last result in complete mode."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{spark.sparkContext.applicationId}-{id(stream)}"
    w = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
    if mode == "append":
        w.format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
