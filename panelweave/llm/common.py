"""Helpers shared by the text operators.

Internal columns start with ``_pw_``; tables that come in must not use that prefix.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed values of the contracts: white space, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="panelweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors.

    ``by`` names columns that become folders.  The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a table from ``stage`` as soon as nothing reads it any more."""
    spark = df.sparkSession
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/panelweave-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` does it wherever no other capital occurs."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~text.rlike("[\\p{javaUpperCase}\\p{javaTitleCase}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of a text, split at white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def small_join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", most: int = 8 << 20) -> DataFrame:
    """Join with a broadcast of ``right`` if its files are known to hold at most ``most`` bytes, else as Spark plans it.

    ``right`` should come from ``stage``, so that Spark knows the size of its files.
    """
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= most else right, on, how)
