"""New granules as a stream: the same stateless corrections and cell statistics, a batch at a time.

An addition for continuous arrival of files. Sessions of a track and binned means are Spark's own
windows with a watermark; late rows beyond it are dropped by Spark and counted in its metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def granules(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def binned_means(df: DataFrame, ts: str, value: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and count in tumbling or sliding windows of event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, late).groupBy(*by, w.alias("window")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def track_sessions(df: DataFrame, ts: str, track: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Begin, end and rows of track segments without a gap in time."""
    return df.withWatermark(ts, late).groupBy(track, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"))


def append_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that has arrived and stop; a rerun goes on where this ended."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
