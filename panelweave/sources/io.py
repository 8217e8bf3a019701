"""Reading and writing tables, raw frames and canonical datasets."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again when an executor is lost.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def canonical_scan(spark: SparkSession, path: str) -> DataFrame:
    """All files of a dataset, columns united by name."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def read_partition(spark: SparkSession, path: str, column: str, value: object) -> DataFrame:
    """One partition of a canonical dataset; the filter prunes directories."""
    return spark.read.parquet(path).filter(F.col(column) == F.lit(value))


def write_sorted(df: DataFrame, path: str, by: list[str], partitions: int | None = None) -> None:
    """Range-partitioned, sorted files: narrow min/max statistics per row group."""
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_raw(df: DataFrame, path: str, provider: str, dataset: str, run_id: str, source: str,
              as_text: bool = False) -> None:
    """Append a raw frame with its lineage; ``as_text`` stores mixed-type columns as strings."""
    out = df.select([F.col(c).cast("string").alias(c) for c in df.columns]) if as_text else df
    (out.withColumns({"_source": F.lit(source), "run_id": F.lit(run_id)})
        .write.mode("append").partitionBy("run_id").parquet(f"{path}/raw/{provider}/{dataset}"))


def write_canonical(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a dataset (or only the partitions present); an empty frame never replaces data."""
    if df.isEmpty():
        raise ValueError(f"refusing to overwrite {path} with an empty frame")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def stamp_lineage(df: DataFrame, source: str, run_id: str, schema_version: int = 1) -> DataFrame:
    return df.withColumns({"source": F.lit(source), "run_id": F.lit(run_id),
                           "schema_version": F.lit(schema_version)})


def inventory(datasets: dict[str, DataFrame], dates: dict[str, str]) -> DataFrame:
    """Rows, date bounds and a content version per dataset, in one aggregation each.

    The version is an order-free hash (sum of row hashes), so it needs no sort
    and no collection of file names.
    """
    out = None
    for name, df in datasets.items():
        part = df.agg(F.count("*").alias("rows"), F.to_date(F.min(dates[name])).alias("min_date"),
                      F.to_date(F.max(dates[name])).alias("max_date"),
                      F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("version"))
        part = part.select(F.lit(name).alias("dataset"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out


def file_inventory(spark: SparkSession, path: str, date_column: str) -> DataFrame:
    """Rows, bytes and date bounds of every file of a dataset."""
    rows = canonical_scan(spark, path)
    return rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(
        F.count("*").alias("rows"), F.min(date_column).alias("min_date"), F.max(date_column).alias("max_date"))


def dataset_summary(files: DataFrame, dataset: str) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"),
                     F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date")).withColumn(
        "dataset", F.lit(dataset))


def ingestion_runs(spark: SparkSession, manifests: str, checkpoints: DataFrame) -> DataFrame:
    """Run manifests (one JSON document per file) plus started runs that left none."""
    runs = spark.read.option("multiLine", True).json(manifests)
    aborted = checkpoints.select("run_id").distinct().join(runs, "run_id", "left_anti").withColumn(
        "status", F.lit("aborted_no_manifest"))
    return runs.unionByName(aborted, allowMissingColumns=True)


def quarantine(df: DataFrame, bad_keys: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to publish, rows kept aside): a partition with a blocking issue is withheld as a whole."""
    bad = bad_keys.select(*keys).distinct()
    return df.join(bad, keys, "left_anti"), df.join(bad, keys, "left_semi")
