"""Records from streams: the same operators over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import lifecycle
from ..shared import table


def upserts(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, now: str) -> StreamingQuery:
    """Writes each micro-batch into a store as an upsert. read gives the store's present snapshot, write replaces it by a new one; a batch that
    is repeated after a failure changes nothing, as its rows have the same ids."""

    def each(batch: DataFrame, _: int) -> None:
        rows = lifecycle.normalised(batch, now)
        write(lifecycle.upsert(read(), rows.select(*read().columns)))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucketed_upserts(stream: DataFrame, path: str, checkpoint: str, now: str, buckets: int = 256) -> StreamingQuery:
    """Writes each micro-batch as an upsert into a store of Parquet below path, in one folder for each bucket of documents: only buckets that the batch touches are read and
    written anew. seq must grow with arrival; a record's id belongs to one document. A batch that is repeated after a failure changes nothing."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = table(lifecycle.normalised(batch, now).withColumn("bucket", bucket), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        try:
            old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
            old.limit(1).count()
        except AnalysisException:  # nothing written yet
            old = new.limit(0)
        after = table(lifecycle.upsert(old.select(*new.columns), new), "buckets")  # read before its folders are written
        after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(spark_or_stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, key, n, total) of distinct events (event_id, value): late ones are waited for, then left out."""
    seen = spark_or_stream.withWatermark(time, late).dropDuplicates(["event_id", time])
    return seen.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def file_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
