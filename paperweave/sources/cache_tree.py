"""The document cache as a file tree: reading millions of small files, and writing through to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cache_path

#: The entity folder of a path begins with the endpoint's name, then two hyphens and the fields asked for.
_PLACE = r"([^/]+?)--[^/]*/(.+)\.json$"


def read_cache_tree(spark: SparkSession, root: str) -> DataFrame:
    """One row per file ``<root>/**/<entity>--<fields>/<key>.json``: ``endpoint``, ``key_id``, ``path``, ``n_bytes``,
    ``fetched_at`` (the file's time) and ``body``.

    Keys with a folder in them are put together again with a colon. Small files are packed into tasks by size
    (``spark.sql.files.openCostInBytes``); files of other shapes are left out; an empty tree gives no rows.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    files = files.select(F.col("value").alias("body"), path.alias("path"), F.col("_metadata.file_size").cast("int").alias("n_bytes"), F.col("_metadata.file_modification_time").alias("fetched_at"))
    return files.where(F.col("path").rlike(_PLACE)).select(
        F.regexp_extract("path", _PLACE, 1).alias("endpoint"), F.replace(F.regexp_extract("path", _PLACE, 2), F.lit("/"), F.lit(":")).alias("key_id"), "path", "n_bytes", "fetched_at", "body"
    )


def append_documents(docs: DataFrame, path: str) -> None:
    """Write-through: append documents, one folder per endpoint, clustered so that an append makes few files."""
    docs.repartition("endpoint", F.pmod(F.xxhash64("key_id"), F.lit(8))).sortWithinPartitions("endpoint", "key_id").write.mode("append").partitionBy("endpoint").parquet(path)


def with_cache_path(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``docs`` with the place each document would have in the tree; ``fields``: the field list of each endpoint."""
    lists = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    return docs.withColumn("path", F.concat(F.col("endpoint"), F.lit("--"), F.replace(lists[F.col("endpoint")], F.lit(","), F.lit("-")), F.lit("/"), cache_path(F.lower("key_id"))))
