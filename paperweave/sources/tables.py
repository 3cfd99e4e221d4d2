"""Readers of the stored tables; every reader reads only the columns that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = (
    "raw_doc paper_detail publication author_profile person citation_obs paper_feed seed_paper documents "
    "given_name_form mix_target region nation customer supplier part orders lineitem events embeddings"
).split()


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` below ``root`` (a Parquet file or folder), with ``columns`` only if any are given."""
    df = ship(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def views(spark: SparkSession, root: str, *names: str) -> None:
    """Register tables as temporary views, for SQL."""
    for n in names or TABLES:
        table(spark, root, n).createOrReplaceTempView(n)
