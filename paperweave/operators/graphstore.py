"""Upserts of the property graph: publication, person, cite and write tables, version by version.

Plain Parquet has no row-level merge, so each function takes the current table and a batch and gives the next version.
All are idempotent: the same batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import doi_norm, falsy, pub_date, title_hash

#: Columns of a publication that a batch overwrites even with nulls, and those it overwrites with true values only.
ALWAYS, GUARDED = ("title", "year"), ("doi", "abstract", "dblp_key", "paper_id", "date")


def publication_batch(papers: DataFrame, seq: Column) -> DataFrame:
    """Papers as a batch: ``title_hash``, the publication's columns, ``seq``. A null title has no hash and is left out."""
    return papers.select(
        title_hash(F.col("title")).alias("title_hash"), "title", "year", falsy(doi_norm(F.col("doi_raw"))).alias("doi"), falsy(F.col("abstract")).alias("abstract"),
        falsy(F.col("dblp_key")).alias("dblp_key"), falsy(F.col("paper_id")).alias("paper_id"), pub_date(F.col("pub_date_raw")).alias("date"), seq.alias("seq"),
    ).where(F.col("title_hash").isNotNull())


def merge_publications(current: DataFrame | None, batch: DataFrame, preserve_nulls: bool = False) -> DataFrame:
    """The next version of the publication table, one row per title hash.

    Of several batch rows with one hash the greatest ``seq`` writes last: title and year as they are there, null too
    (unless ``preserve_nulls``), every other column its last true value. One aggregate does the batch and the current
    table together, so nothing is joined; a hash that a third of all rows share (the empty one) is combined map-side.
    """
    cols = [*ALWAYS, *GUARDED]
    rows = batch.select("title_hash", *cols, F.struct(F.lit(1).alias("new"), F.col("seq").alias("s")).alias("seq"))
    if current is not None:
        low = batch.schema["seq"].dataType
        rows = rows.unionByName(current.select("title_hash", *cols, F.struct(F.lit(0).alias("new"), F.lit(None).cast(low).alias("s")).alias("seq")))
    def guarded(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c)

    always = [guarded(c) if preserve_nulls else F.max_by(c, F.struct("seq", F.col(c))).alias(c) for c in ALWAYS]
    return rows.groupBy("title_hash").agg(*always, *(guarded(c) for c in GUARDED))


def merge_cites(current: DataFrame | None, edges: DataFrame, hashes: DataFrame, publication: DataFrame) -> DataFrame:
    """The next version of the cite table (``src_title_hash``, ``dst_title_hash``).

    ``edges``: citing_id, cited_id; ``hashes``: paper_id, title_hash, one row per paper. An edge one of whose ends has no
    publication is left out. Papers that share a hash can make self-loops; they stay.
    """
    h = hashes.where(F.col("title_hash").isNotNull()).join(publication.select("title_hash"), "title_hash", "left_semi")
    src = h.select(F.col("paper_id").alias("citing_id"), F.col("title_hash").alias("src_title_hash"))
    dst = h.select(F.col("paper_id").alias("cited_id"), F.col("title_hash").alias("dst_title_hash"))
    new = edges.select("citing_id", "cited_id").distinct().join(src, "citing_id").join(dst, "cited_id").select("src_title_hash", "dst_title_hash")
    return (new if current is None else new.unionByName(current.select(*new.columns))).distinct()


def neighbours_to_write(expanded: DataFrame, reference_obs: DataFrame, cite: DataFrame | None, hashes: DataFrame, skip_existing: bool = True) -> DataFrame:
    """References of expanded papers the stored graph doesn't link yet: ``citing_id``, ``cited_id``. They aren't filtered.

    With ``skip_existing`` pairs whose hashes are linked in ``cite`` (citing to cited) are left out.
    """
    refs = reference_obs.select("citing_id", "cited_id").distinct().join(expanded.select(F.col("paper_id").alias("citing_id")), "citing_id", "left_semi")
    if not skip_existing or cite is None:
        return refs
    a = hashes.select(F.col("paper_id").alias("citing_id"), F.col("title_hash").alias("src_title_hash"))
    b = hashes.select(F.col("paper_id").alias("cited_id"), F.col("title_hash").alias("dst_title_hash"))
    return refs.join(a, "citing_id", "left").join(b, "cited_id", "left").join(cite, ["src_title_hash", "dst_title_hash"], "left_anti").select("citing_id", "cited_id")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """The edges turned round, for stores that were filled that way."""
    return edges.select(F.col("cited_id").alias("citing_id"), F.col("citing_id").alias("cited_id")).distinct()


def collisions(papers: DataFrame) -> DataFrame:
    """``title_hash``, ``n_papers`` of the hashes that several paper ids share, the empty one among them."""
    return papers.select("paper_id", title_hash(F.col("title")).alias("title_hash")).where("title_hash is not null").distinct().groupBy("title_hash").agg(F.count(F.lit(1)).alias("n_papers")).where("n_papers > 1")
