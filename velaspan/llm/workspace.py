"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only where that is unset and all runs in this process, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="velaspan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path that no other call uses."""
    return f"{root(spark)}/velaspan/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps, and retries after a lost executor, start there."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing which is still to run reads; others are left alone."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            dropped(df.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`fresh`, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch. Each task holds a few copies of one, in the executor's JVM and in its Python worker.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the memory that long texts take between Spark and Python, for this session's later queries."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the data folder, with the session's Arrow batches bounded."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def hidden(docs: DataFrame, *roles: str) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` under names that no step uses, those names in order, and the name of each role's column.

    Operators that carry all columns along work on these, so that a column of
    the input may have any name; ``toDF`` with the old names ends it.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, {r: names[docs.columns.index(r)] for r in roles}
