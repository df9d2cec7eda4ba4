"""Deliveries as a stream: keyed state and counts of late records, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deliveries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def late_counts(stream: DataFrame, at: str, loaded: str, key: str, delay: str = "90 days", window: str = "30 days") -> DataFrame:
    """window, key, n, n_late of records per window of loading; late ones were loaded a day after `at` or more."""
    late = F.col(loaded) > F.col(at) + F.expr("interval 1 day")
    return stream.withWatermark(loaded, delay).groupBy(F.window(loaded, window), key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(late, 1)).alias("n_late"))


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str, *order: str) -> StreamingQuery:
    """Keep the last delivered row of each key in a Parquet table, batch by batch.

    A batch writes a new version of the table beside the old ones; the greatest complete version is
    the table. A batch starts from the greatest complete version before its own, so one that is repeated
    after a failure gives the same rows, and a missing number loses none. Versions that the one before
    has replaced are removed when a new one is complete.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(hadoop(path))] if fs.exists(hadoop(path)) else []
        numbers = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and int(n[1:]) < number and fs.exists(hadoop(f"{path}/{n}/_SUCCESS")))
        both = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{numbers[-1]}")) if numbers else batch
        body = F.struct(*[F.col(c) for c in batch.columns])
        both.groupBy(F.col(key).alias("_k")).agg(F.max_by(body, F.struct(*order)).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/v{number}")
        for old in numbers[:-1]:
            fs.delete(hadoop(f"{path}/v{old}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run an operator on all that arrived since the last run."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
