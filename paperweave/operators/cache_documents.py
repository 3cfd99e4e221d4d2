"""Flat tables of the crawler's cached documents: papers, authors, their names and external ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shred import FlatTable, shred

_AUTHOR = {"author_id": ("authorId",), "name": ("name",), "homepage": ("homepage",)}
_PAPER = {k: (v,) for k, v in {"paper_id": "paperId", "title": "title", "abstract": "abstract", "year": "year", "publication_date": "publicationDate"}.items()}


def _people(prefix: str, at: tuple[str, ...], parent: str | None) -> list[FlatTable]:
    return [
        FlatTable(f"{prefix}.author", at, _AUTHOR, needs=("author_id",), parent=parent),
        FlatTable(f"{prefix}.dblp_name", (*at, "externalIds", "DBLP", "[]"), {"value": ()}, needs=("value",), parent=f"{prefix}.author", lone=True),
    ]


def _papers(prefix: str, kind: str, at: tuple[str, ...], below: tuple[str, ...]) -> list[FlatTable]:
    me = f"{prefix}.{kind}"
    return [
        FlatTable(me, at, {k: below + v for k, v in _PAPER.items()}, needs=("paper_id",)),
        FlatTable(f"{prefix}.external", at, {}, parent=me, open_map=(*below, "externalIds")),
        *_people(prefix, (*at, *below, "authors", "[]"), me),
    ]


#: The flat tables of each endpoint; a table is named endpoint.kind, parents come before children.
DOCUMENT_TABLES: list[FlatTable] = [
    *_papers("paper", "paper", (), ()),
    *_papers("references", "cited", ("data", "[]"), ("citedPaper",)),
    *_papers("citations", "citing", ("data", "[]"), ("citingPaper",)),
    *_people("authors", ("data", "[]"), None),
    FlatTable("author_papers.authored", ("data", "[]"), {"paper_id": ("paperId",), "title": ("title",)}, needs=("paper_id",)),
]


def flat_documents(raw_doc: DataFrame) -> DataFrame:
    """All flat rows of the cached documents: ``raw_id``, ``endpoint``, ``kind``, ``data_pos``, ``author_pos``,
    ``name_pos`` (-1: the level isn't on the path), ``columns`` (map of the row's scalars as written).

    A null, empty or invalid body, a document without ``data`` and an unknown endpoint give no rows. Papers and authors
    without id give none, nor do their children. Repeated raw rows give repeated flat rows.
    """
    flat = shred(raw_doc.where(F.col("body").isNotNull()), "raw_id", "body", DOCUMENT_TABLES, route="endpoint")
    name = F.split("table_name", r"\.")
    at = lambda i: F.coalesce(F.try_element_at("ordinals", F.lit(i)), F.lit(-1))
    # documents of these endpoints have the data level before that of the authors; in the others authors come first
    listed = F.col("endpoint").isin("references", "citations", "author_papers")
    return flat.select("raw_id", name[0].alias("endpoint"), name[1].alias("kind"), "ordinals", "columns").select(
        "raw_id",
        "endpoint",
        "kind",
        F.when(listed, at(1)).otherwise(F.lit(-1)).alias("data_pos"),
        F.when(listed, at(2)).otherwise(at(1)).alias("author_pos"),
        F.when(listed, at(3)).otherwise(at(2)).alias("name_pos"),
        "columns",
    )


def document_children(raw_doc: DataFrame) -> DataFrame:
    """Every child of every valid document with its place: ``raw_id``, ``child_kind``, the positions, ``child_value``."""
    c = F.col("columns")
    flat = flat_documents(raw_doc).where("kind <> 'paper'")
    value = (
        F.when(F.col("kind").isin("cited", "citing", "authored"), c["paper_id"])
        .when(F.col("kind") == "author", c["author_id"])
        .when(F.col("kind") == "external", F.concat_ws(":", c["key"], c["value"]))
        .otherwise(c["value"])
    )
    return flat.select("raw_id", F.col("kind").alias("child_kind"), "data_pos", "author_pos", "name_pos", value.alias("child_value"))


def flat_papers(raw_doc: DataFrame) -> DataFrame:
    """One row per paper of any document: its place, and its scalars; ``year`` is null where it isn't a number."""
    c = F.col("columns")
    return flat_documents(raw_doc).where(F.col("kind").isin("paper", "cited", "citing", "authored")).select(
        "raw_id", "endpoint", "kind", "data_pos", c["paper_id"].alias("paper_id"), c["title"].alias("title"), F.expr("try_cast(columns['year'] as int)").alias("year"), c["publication_date"].alias("publication_date")
    )


def flat_authors(raw_doc: DataFrame) -> DataFrame:
    """One row per author of any paper, or of the authors endpoint: its place (the parent's key is raw_id, data_pos)."""
    c = F.col("columns")
    return flat_documents(raw_doc).where("kind = 'author'").select(
        "raw_id", "endpoint", "data_pos", "author_pos", c["author_id"].alias("author_id"), c["name"].alias("name"), c["homepage"].alias("homepage")
    )
