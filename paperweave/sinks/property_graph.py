"""The property graph as four versioned tables, updated one crawl level at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authors as A
from ..operators import graphstore as G
from ..operators.compact import swap_directory
from ..session import cut

SCHEMAS = {
    "publication": "title_hash string, title string, year int, doi string, abstract string, dblp_key string, paper_id string, date date",
    "person": "element_id string, author_id string, dblp_pid string, name string, homepage string",
    "cite": "src_title_hash string, dst_title_hash string",
    "write": "element_id string, title_hash string",
}


class GraphSink(Protocol):
    """What a crawl hands its levels to: the level, the papers expanded in it, the edges proved first in it."""

    def write_level(self, level: int, expanded: DataFrame, edges: DataFrame) -> None: ...


class PropertyGraph:
    """A sink that upserts publications, citations, persons and authorship below ``path``.

    ``papers``: records by paper_id (title, year, pub_date_raw, abstract, dblp_key, doi_raw); ``reference_obs``: the
    unfiltered references, written for every expanded paper unless None; ``observed``: authors of papers (``authors_of``),
    reconciled unless None; ``match`` can replace the rule by which stored persons are matched. Each table's next version
    is written beside it and swapped in, so a level that broke off can be written again and changes nothing twice.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        papers: DataFrame,
        reference_obs: DataFrame | None = None,
        observed: DataFrame | None = None,
        skip_existing: bool = True,
        reverse: bool = False,
        match: Callable[[DataFrame, DataFrame], DataFrame] = A.match_authors,
    ) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.papers, self.reference_obs, self.observed = papers, reference_obs, observed
        self.skip_existing, self.reverse, self.match = skip_existing, reverse, match

    def table(self, name: str) -> DataFrame:
        """The present version of a table; empty if there is none yet."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], SCHEMAS[name])

    def _put(self, name: str, df: DataFrame) -> None:
        staged = f"{self.path}/.{name}.next"
        df.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.mode("overwrite").parquet(staged)
        swap_directory(self.spark, staged, f"{self.path}/{name}")

    def write_level(self, level: int, expanded: DataFrame, edges: DataFrame) -> None:
        """Publications of the expanded papers, of their references and of edge ends; then citations; then authors.

        ``seq`` of a merge is the level, then the paper id: of records with one title hash the later level writes last.
        """
        ids = expanded.select("paper_id")
        new = edges.select("citing_id", "cited_id")
        if self.reference_obs is not None:
            hashes = G.publication_batch(self.papers, F.lit(0)).select("paper_id", "title_hash")
            more = G.neighbours_to_write(ids, self.reference_obs, self.table("cite"), hashes, self.skip_existing)
            new = new.unionByName(more).distinct()
        new = cut(new)
        touched = ids.unionByName(new.select(F.explode(F.array("citing_id", "cited_id")).alias("paper_id"))).distinct()
        batch = cut(G.publication_batch(self.papers.join(touched, "paper_id", "left_semi"), F.struct(F.lit(level).alias("level"), "paper_id")))
        hashes = batch.select("paper_id", "title_hash")
        self._put("publication", G.merge_publications(self.table("publication"), batch))
        pubs = self.table("publication").select("title_hash")
        both = new.unionByName(G.reverse_edges(new)) if self.reverse else new
        self._put("cite", G.merge_cites(self.table("cite"), both, hashes, pubs))
        if self.observed is not None:
            seen = cut(self.observed.join(ids, "paper_id", "left_semi"))
            mine = hashes.join(ids, "paper_id", "left_semi")
            person, write = self.table("person"), self.table("write")
            actions = cut(self.match(seen, A.correlated_persons(mine, seen, person, write)))
            people, wrote = A.apply_author_actions(person, write, actions, mine)
            people, wrote = cut(people), cut(wrote)
            self._put("person", people)
            self._put("write", wrote)
