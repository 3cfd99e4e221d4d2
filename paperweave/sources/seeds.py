"""Where a crawl begins: stored publications and persons, given ids, authors' papers."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import doi_alias, falsy, lower_id
from ..operators.predicates import stored_predicate


def seed_papers(publication: DataFrame) -> DataFrame:
    """``id`` of each stored publication: its paper id, else ``DOI:`` and its DOI; those with neither are left out."""
    return publication.select(F.coalesce(falsy(F.col("paper_id")), falsy(doi_alias(falsy(F.col("doi"))))).alias("id")).where(F.col("id").isNotNull())


def seed_papers_keywords(publication: DataFrame, since: int = 2000, *rules: str, normalize: bool = True) -> DataFrame:
    """The same for publications of known year since ``since`` whose title hash matches the rules."""
    return seed_papers(publication.where(stored_predicate(F.col("year"), F.col("title_hash"), since, list(rules), normalize)))


def seed_authors(person: DataFrame) -> DataFrame:
    """``author_id`` of each stored person that has one."""
    return person.select(falsy(F.col("author_id")).alias("author_id")).where(F.col("author_id").isNotNull())


def seeds_from_authors(authors: DataFrame, author_paper: DataFrame) -> DataFrame:
    """``id`` of the papers of the given authors."""
    return author_paper.join(authors.select("author_id").distinct(), "author_id", "left_semi").select(F.col("paper_id").alias("id"))


def seed_union(*seeds: DataFrame) -> DataFrame:
    """``id``: all seeds once, lower case; null and empty ids are left out."""
    out = seeds[0].select(lower_id(F.col("id")).alias("id"))
    for s in seeds[1:]:
        out = out.unionByName(s.select(lower_id(F.col("id")).alias("id")))
    return out.where("id is not null").distinct()


def resolve_aliases(seeds: DataFrame, papers: DataFrame) -> DataFrame:
    """``id``: seeds written as ``DOI:...`` become the id of the paper with that DOI; others stay, unknown DOIs too."""
    from ..functions.scalars import doi_norm

    by_doi = papers.where("doi_raw <> ''").select(F.concat(F.lit("doi:"), F.lower(doi_norm(F.col("doi_raw")))).alias("id"), "paper_id").groupBy("id").agg(F.min("paper_id").alias("paper_id"))
    return seeds.select(F.lower("id").alias("id")).join(by_doi, "id", "left").select(F.coalesce("paper_id", "id").alias("id")).distinct()


def parse_seeds(values: Iterable[str] | None) -> list[str]:
    """Ids given on a command line: each value is an id or a JSON list of ids. Nothing is evaluated."""
    out: list[str] = []
    for v in values or []:
        try:
            got = json.loads(v)
        except ValueError:
            got = v
        out += [str(x) for x in got] if isinstance(got, list) else [v]
    return out


def called_seeds(spark: SparkSession, name: str, column: str = "id") -> DataFrame:
    """Seeds from a function named ``module:function``: it gets the session and returns a DataFrame with ``column`` or ids.

    The module is imported and the function called; nothing is evaluated.
    """
    module, _, function = name.partition(":")
    got = getattr(importlib.import_module(module), function)(spark)
    return got.select(F.col(column).cast("string").alias(column)) if isinstance(got, DataFrame) else spark.createDataFrame([(str(v),) for v in got], f"{column} string")


def literal_seeds(spark: SparkSession, values: Iterable[str] | None, column: str = "id") -> DataFrame:
    return spark.createDataFrame([(v,) for v in parse_seeds(values)], f"{column} string")
