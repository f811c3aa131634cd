"""Helpers that the operators of this subpackage share.

Shared rules: columns other than those named in a call are ignored (or carried along where the
docstring says so); a null text is an empty text; a working column never replaces one of the
caller's, because `fresh` picks a name that the frame does not have.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: A key with one HEAVY-th of the rows, and with LEAST_HEAVY rows, is joined by broadcast.
HEAVY, LEAST_HEAVY = 1000, 100
#: Rows in a partition of a small table, and such with texts or sets of shingles.
PART_ROWS, PART_TEXTS = 20_000, 1_000


def fresh(df: DataFrame, base: str) -> str:
    """A column name starting with `base` that `df` does not have (in any letter case)."""
    have = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in have:
        k += 1
        name = f"{base}_{k}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of the session; a temporary one only where all tasks run on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="firnline-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the shared checkpoint folder, lineage ended."""
    _shared_folder(df)
    return df.checkpoint()


def packed(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """`df`, of about `rows` rows at most, in no more partitions than have `each` of them: a small table makes few tasks and files."""
    return df.coalesce(max(1, math.ceil(rows / each)))


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once, written as Parquet in the shared checkpoint folder and read back."""
    path = f"{_shared_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what `stored` wrote for `df`; nothing may read it any more."""
    folder = df.inputFiles()[0].rpartition("/")[0]
    if "/stored-" in folder:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_frequent(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of `rows` with `table`, which has each `key` once; both have been cut.

    The rows of frequent keys stay where they lie and `table` comes to them: at most HEAVY keys can be
    frequent, so what is broadcast has that bound. All other rows meet their keys by shuffle.
    """
    n = rows.count()
    least = max(LEAST_HEAVY, n / HEAVY)
    frequent = [r[0] for r in packed(rows.groupBy(key).count(), n).where((F.col("count") >= least) & F.col(key).isNotNull()).select(key).collect()]
    if not frequent:
        return rows.join(table, key)
    of = F.broadcast(table.sparkSession.createDataFrame([(k,) for k in frequent], rows.select(key).schema))
    few = F.broadcast(table.join(of, key, "left_semi"))
    return rows.join(of, key, "left_anti").join(table.join(of, key, "left_anti"), key).unionByName(rows.join(few, key))
