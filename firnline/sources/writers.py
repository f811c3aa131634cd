"""Writers: Parquet by tile, formatted text, statistics, and stages that skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_columns(df: DataFrame, new: dict) -> DataFrame:
    """Columns added or replaced by name."""
    return df.withColumns(new)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def by_tile(df: DataFrame, path: str, tile: list[str], mode: str = "overwrite") -> None:
    """One folder a tile; rows of a tile come together in few files."""
    df.repartition(*tile).write.mode(mode).partitionBy(*tile).parquet(path)


def formatted(df: DataFrame, digits: int = 6) -> DataFrame:
    """One text column of fixed-point numbers separated by spaces."""
    parts = [F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in df.columns]
    return df.select(F.concat_ws(" ", *parts).alias("value"))


def text(df: DataFrame, path: str, digits: int = 6) -> None:
    formatted(df, digits).write.mode("overwrite").text(path)


def statistics(df: DataFrame, value: str) -> DataFrame:
    """mean, std, min, max, rmse and n of a column."""
    v = F.col(value)
    return df.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sqrt(F.avg(v * v)).alias("rmse"), F.count(v).alias("n"))


def unless_done(df: DataFrame, path: str) -> bool:
    """Write a stage's result if its path has none yet; whether it was written."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if marker.getFileSystem(conf).exists(marker):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
