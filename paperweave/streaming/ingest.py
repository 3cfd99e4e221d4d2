"""Documents that keep arriving: bounded micro-batches, latest-per-key tables, idempotent graph updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.compact import swap_directory
from ..schemas import RAW_DOC


def read_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of cached documents from Parquet files that arrive below ``path``."""
    return spark.readStream.schema(RAW_DOC).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Per (endpoint, key) the document fetched last, of the table and a batch; late arrivals never replace newer ones."""
    rows = batch if current is None else current.select(*batch.columns).unionByName(batch)
    key = [F.coalesce("endpoint", F.lit("")).alias("_e"), F.coalesce(F.lower("key_id"), F.lit("")).alias("_k")]
    cols = batch.columns
    best = rows.select(*key, F.struct(*cols).alias("_r"), F.struct("fetched_at", "raw_id").alias("_o")).groupBy("_e", "_k").agg(F.max_by("_r", "_o").alias("_r"))
    return best.select("_r.*")


def upsert_documents(table: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps ``table`` at the newest document per key.

    Each version is written beside the table and swapped in, so a batch that is run again changes nothing.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(table)
        there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        nxt = newest(spark.read.schema(RAW_DOC).parquet(table) if there else None, batch)
        staged = f"{table.rstrip('/')}.batch-{number}"
        nxt.write.mode("overwrite").parquet(staged)
        swap_directory(spark, staged, table)

    return run


def ingest(stream: DataFrame, table: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run the stream until its present input is used up, keeping ``table`` current; ``on_batch`` gets each batch too."""
    keep = upsert_documents(table)

    def run(batch: DataFrame, number: int) -> None:
        keep(batch, number)
        if on_batch is not None:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, window: str = "1 day", late: str = "60 days") -> DataFrame:
    """Documents and bytes per window of fetch time and endpoint; what comes later than ``late`` is no longer counted."""
    return stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window).alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_bytes").cast("bigint")).alias("n_bytes")
    ).select(F.col("w.start").alias("from"), "endpoint", "n_docs", "n_bytes")
