"""Many tiny documents to few well-sized files, none lost and none held twice."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop_path, scratch
from .skew import attach_first


def _row_hash(tie: str) -> Column:
    return F.xxhash64(tie, "endpoint", "key_id", "body")


def document_groups(raw_doc: DataFrame, tie: str = "raw_id") -> DataFrame:
    """``tie``, ``doc``, ``n_bytes``, ``h``: a 256-bit hash of endpoint, key without letter case, length and body of each
    document, its size and the hash of its row.

    The fields are joined with their lengths, so that no two different triples meet in one text. Null keys count as one
    key of their own; rows with a null body hold no document and get a null ``doc``.
    """
    def part(c: Column) -> Column:
        return F.concat(F.coalesce(F.octet_length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))

    whole = F.concat(part(F.coalesce("endpoint", F.lit(""))), part(F.lower("key_id")), part(F.col("body")))
    size = (F.coalesce(F.octet_length("body"), F.lit(0)) + 64).cast("bigint")
    return raw_doc.select(tie, F.when(F.col("body").isNotNull(), F.unhex(F.sha2(whole, 256))).alias("doc"), size.alias("n_bytes"), _row_hash(tie).alias("h"))


def repeated_documents(raw_doc: DataFrame) -> DataFrame:
    """``raw_id``, ``keep_id``: each row that holds the same document as a row of smaller raw_id, and the smallest one.

    Only hashes and ids are shuffled, never bodies; a document copied into a third of all rows is handled apart.
    Rows with a null body, and the first row of each document, are not in it. An empty table gives no rows.
    """
    groups = cut(document_groups(raw_doc))
    return _repeats(groups, "raw_id")


def _repeats(groups: DataFrame, tie: str) -> DataFrame:
    return attach_first(groups.select(tie, "doc"), "doc", tie, "keep_id").where(F.col(tie) > F.col("keep_id")).select(tie, "keep_id")


@dataclass(frozen=True)
class Compacted:
    """What a consolidation did; ``files`` has a row per file written, ``left_out`` one per row that isn't in them."""

    path: str
    rows_in: int
    rows_repeated: int
    rows_out: int
    target_bytes: int
    files: DataFrame
    left_out: DataFrame


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def swap_directory(spark: SparkSession, staged: str, final: str) -> None:
    """Put ``staged`` in the place of ``final``: the old one is set aside first and deleted only when the new is there."""
    fs, new = _fs(spark, staged)
    _, old = _fs(spark, final)
    _, aside = _fs(spark, final.rstrip("/") + ".old")
    if fs.exists(aside):
        if not fs.exists(old):  # a swap broke off between its two renames
            fs.rename(aside, old)
        else:
            fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"can't set {final} aside")
    if old.getParent() is not None:
        fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"can't move {staged} to {final}")
    fs.delete(aside, True)


def consolidate(
    raw_doc: DataFrame,
    path: str | None = None,
    cluster_by: tuple[str, ...] = ("endpoint", "key_id"),
    tie: str = "raw_id",
    target_bytes: int = 128 << 20,
    packing: float = 0.25,
) -> Compacted:
    """Write the documents of ``raw_doc``, each once, as few sorted files of about ``target_bytes``, then swap them in.

    The rows are range-partitioned by ``cluster_by`` and ``tie`` with boundaries sampled from the data (the tie-breaker
    lets a key that holds a third of all rows spread over many files) into total bytes x ``packing`` / ``target_bytes``
    files; ``packing`` is the ratio of a Parquet file to its bodies. Written to a staging folder beside ``path`` (by
    default a new one in the shared folder); rows and the sum of the row hashes are read back and must equal what went
    in less the repeated documents, or nothing is swapped and the staging folder is deleted. ``raw_doc`` may be read
    from ``path`` itself. Rows with a null body are kept. All columns are kept.
    """
    spark = raw_doc.sparkSession
    path = path or scratch(spark, "documents")
    groups = cut(document_groups(raw_doc, tie))  # the one pass over the bodies before they are written
    gone = cut(_repeats(groups, tie).select(tie))
    total = F.sum(F.col("h").cast("decimal(38,0)")).alias("h")
    size = groups.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(tie).alias("d")).first()
    if size["n"] != size["d"]:
        raise ValueError(f"{tie} isn't unique")
    want = groups.join(gone, tie, "left_anti").agg(F.count(F.lit(1)).alias("n"), total, F.sum("n_bytes").alias("b")).first()
    n_gone = gone.count()
    parts = max(1, math.ceil((want["b"] or 0) * packing / target_bytes))
    staged = path.rstrip("/") + ".staged"
    drop_path(spark, staged)
    keep = raw_doc.join(gone, tie, "left_anti")
    keep.repartitionByRange(parts, *cluster_by, tie).sortWithinPartitions(*cluster_by, tie).write.option("compression", "zstd").parquet(staged)
    got = spark.read.parquet(staged).select(_row_hash(tie).alias("h")).agg(F.count(F.lit(1)).alias("n"), total).first()
    if (want["n"], want["h"]) != (got["n"], got["h"]) or want["n"] != size["n"] - n_gone:
        drop_path(spark, staged)
        raise ValueError(f"consolidation doesn't add up: {want} to write, {got} written, {size['n']} less {n_gone} expected")
    swap_directory(spark, staged, path)
    held = spark.read.parquet(path)
    files = held.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("n_bytes")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.struct(*cluster_by, tie)).alias("first"), F.max(F.struct(*cluster_by, tie)).alias("last")
    )
    left_out = groups.select(tie).join(held.select(tie), tie, "left_anti")
    return Compacted(path, size["n"], n_gone, got["n"], target_bytes, files, left_out)
