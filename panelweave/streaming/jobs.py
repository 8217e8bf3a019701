"""Structured Streaming jobs over trade and event files.

Results go to files, never through the driver: each micro-batch overwrites its
own ``batch_id`` folder, so a batch that runs again after a failure leaves one
copy, and readers take the newest row of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.io import shared_folder
from . import monitors


def file_stream(spark: SparkSession, directory: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream with the table's own schema: a folder of part files, or a single file."""
    path = f"{directory}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    return reader.parquet(path)


def span(rows: DataFrame, ts: str) -> str:
    """A watermark delay that covers a whole table: files in no order then lose no row."""
    days = rows.agg(F.datediff(F.max(ts), F.min(ts))).first()[0] or 0
    return f"{days + 1} days"


def event_files(rows: DataFrame, name: str, files: int | None) -> str:
    """A folder with ``rows`` dealt over ``files`` files in no order of time, as a feed may leave them; as they are made, without a number."""
    folder = shared_folder(rows.sparkSession, name)
    (rows.repartition(files) if files else rows).write.parquet(folder)
    return folder


def files_read(spark: SparkSession, folder: str, schema: StructType, files: int | None) -> DataFrame:
    """What :func:`event_files` wrote as a stream: a file at a time, or all that there is at once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(folder)


def run_available(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Process everything that is there and return the written rows with their batch id."""
    return _run(stream, mode, name, lambda batch, batch_id, folder: batch)


def run_touched(stream: DataFrame, keys: list[str], name: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a batch operator per key to all rows of the key so far, whenever a micro-batch touches the key.

    Rows may come in any order and in any number of batches: a batch is added to a log, the keys it touches are worked
    out again from the log, and the newest result of a key is returned.
    """
    def work(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        if batch_id == 0:  # every row so far is of a touched key, and no older result stands; null keys are equal to none
            batch.write.mode("overwrite").parquet(f"{folder}/log/batch_id=0")
            first = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/log/batch_id=0")
            return operator(first.dropna(subset=keys)).withColumn("_found", F.lit(True))
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch_id={batch_id}")
        log = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/log")
        touched = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/log/batch_id={batch_id}").select(*keys).distinct()
        # a touched key is written even when nothing comes of it now, so that an older result does not stand
        return touched.join(operator(log.join(touched, keys, "left_semi")).withColumn("_found", F.lit(True)), keys, "left")

    written = _run(stream, "append", name, work)
    if written.filter("batch_id > 0").isEmpty():
        return written.filter("_found").drop("batch_id", "_found")
    last = written.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return written.filter("_found").join(last, [*keys, "batch_id"], "left_semi").drop("batch_id", "_found")


def _run(stream: DataFrame, mode: str, name: str, work: Callable[[DataFrame, int, str], DataFrame]) -> DataFrame:
    spark = stream.sparkSession
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id, folder).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of every key an update-mode stream wrote."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def trades_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events as trades; re-read rows are dropped by their sequence number.

    ``late`` is how far behind the newest trade a row may come: a session for a live feed, whose state then holds a
    session.  Rows that come later are dropped; for files in no order it must cover their whole span.
    """
    side = F.when(F.col("event_type").isin("purchase", "click"), "B").when(F.col("event_type") == "error", "S").otherwise("N")
    rows = events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"),
                         F.concat(F.lit("g"), (F.col("user_id") % 5).cast("string")).alias("group_id"), F.col("user_id").cast("string").alias("symbol"),
                         F.col("value").alias("amount"), side.alias("side"))
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "day", "seq"])
    return rows.dropDuplicates(["symbol", "day", "seq"])


def cumulative_stream(trades: DataFrame, big: float) -> DataFrame:
    """Totals per group and minute, kept in state by day."""
    return trades.groupBy("group_id", "day", monitors.minute_label(F.col("ts")).alias("minute"), F.window("ts", "1 day")).agg(
        *[c.alias(n) for n, c in monitors.measures(big).items()]).drop("window")


def sliding_stream(trades: DataFrame, big: float) -> DataFrame:
    """Net of large trades over sliding half hours."""
    m = monitors.measures(big)
    return trades.groupBy("group_id", F.window("ts", "30 minutes", "10 minutes").alias("w")).agg(
        (m["big_buy"] - m["big_sell"]).alias("big_net"), F.count("*").alias("trades")).select(
        "group_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "big_net", "trades")


def alert_stream(trades: DataFrame, least: float) -> DataFrame:
    """The first large trade per (group, side, day) raises the only alert of that day."""
    keys = ["group_id", "side", "day"]
    large = trades.filter((F.col("amount") >= least) & (F.col("side") != "N"))
    return large.dropDuplicatesWithinWatermark(keys) if large.isStreaming else large.dropDuplicates(keys)
