"""Incremental runs: resume by what a sink holds, and running statistics over a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def pending(items: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Items that aren't done yet."""
    return items if done is None else items.join(done.select(key).distinct(), key, "left_anti")


def resume_append(items: DataFrame, path: str, key: str, schema: StructType) -> DataFrame:
    """Appends the items whose key the sink doesn't hold, and returns the sink. Runs again add nothing."""
    spark = items.sparkSession
    held = spark.read.schema(schema).parquet(path) if _exists(spark, path) else None
    pending(items, held, key).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def run_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes df unless the path has a result already, which then stays; with force it is replaced."""
    if force or not _exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def done_by_marker(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """(instance): the folders that hold a marker file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("instance")).distinct()


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 10, kind: str = "parquet") -> DataFrame:
    """Files as a stream, so many for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def running_stats(stream: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Statistics that each micro-batch brings up to date."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def windowed_stats(stream: DataFrame, stamp: str, by: list[str], value: Column, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Statistics of event-time windows; rows later than the watermark are left out, and closed windows leave the state."""
    window = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return stream.withWatermark(stamp, late).groupBy(window, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def distinct_stream(stream: DataFrame, keys: list[str], stamp: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Processes what there is and stops. In complete mode each micro-batch replaces the result at path."""
    if mode == "append":
        query: StreamingQuery = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path)
    else:
        query = (
            df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
        )
    query.awaitTermination()


def cached(items: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a cache by content key."""
    return items.join(cache, key), items.join(cache.select(key), key, "left_anti")
