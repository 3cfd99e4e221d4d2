"""Endpoint tables from the document cache: validated, fresh, latest, flattened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import falsy, lower_id
from ..operators.predicates import fresh
from ..schemas import ENDPOINTS, REQUIRED


def usable(raw_doc: DataFrame, endpoint: str, valid: Column | None = None) -> DataFrame:
    """Documents of one endpoint whose body is an object with the endpoint's key (its value may be null).

    The body comes parsed in ``doc``; what isn't JSON, or not an object, or lacks the key, is left out. ``valid``: a test
    of the raw row in place of the key test.
    """
    part = raw_doc.where(F.col("endpoint") == endpoint)
    ok = F.array_contains(F.json_object_keys("body"), REQUIRED[endpoint]) if valid is None else valid
    return part.where(ok).withColumn("doc", F.from_json("body", ENDPOINTS[endpoint]))


def usable_any(raw_doc: DataFrame) -> DataFrame:
    """The documents of all endpoints that ``usable`` takes, in one pass and not parsed; unknown endpoints have none."""
    key = F.create_map(*[F.lit(x) for kv in REQUIRED.items() for x in kv])[F.col("endpoint")]
    return raw_doc.where(F.array_contains(F.json_object_keys("body"), key))


def latest(raw_doc: DataFrame, endpoint: str, now: Column | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """Per key the last usable document, if it is still fresh: ``key_id`` (lower case), ``raw_id``, ``fetched_at``, ``doc``.

    Ties in time go to the greater raw_id. Without ``now`` nothing expires. A body travels with its row: where the
    cache is consolidated (``operators.compact``) there is one per key to move.
    """
    docs = usable(raw_doc, endpoint).where(F.col("key_id").isNotNull())
    if now is not None:
        docs = docs.where(fresh(F.col("fetched_at"), F.col("endpoint"), now, ttl))
    key = F.lower("key_id").alias("key_id")
    last = docs.select(key, "raw_id", "fetched_at", "doc").groupBy("key_id").agg(F.max_by(F.struct("raw_id", "fetched_at", "doc"), F.struct("fetched_at", "raw_id")).alias("x"))
    return last.select("key_id", "x.*")


def author_names(dblp: Column) -> Column:
    """The list of DBLP names from its JSON text; a lone name is a list of one, nothing is an empty list."""
    return F.when(F.startswith(F.ltrim(dblp), F.lit("[")), F.filter(F.from_json(dblp, "array<string>"), lambda n: falsy(n).isNotNull())).when(
        falsy(dblp).isNotNull(), F.array(dblp)
    ).otherwise(F.array().cast("array<string>"))


def _paper(p: Column) -> list[Column]:
    return [
        lower_id(p["paperId"]).alias("paper_id"), p["title"].alias("title"), p["year"].alias("year"), p["publicationDate"].alias("pub_date_raw"),
        p["abstract"].alias("abstract"), p["externalIds"]["DBLP"].alias("dblp_key"), p["externalIds"]["DOI"].alias("doi_raw"), p["authors"].alias("authors"),
    ]


def paper_detail(raw_doc: DataFrame, now: Column | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """One row per paper asked for whose document names that very paper; others stay unresolved."""
    d = latest(raw_doc, "paper", now, ttl)
    return d.where(F.lower("doc.paperId") == F.col("key_id")).select(*_paper(F.col("doc")))


def _neighbours(raw_doc: DataFrame, endpoint: str, field: str, now: Column | None, ttl: dict[str, int] | None) -> DataFrame:
    """Rows of a list endpoint, neighbour by neighbour, those without id left out."""
    rows = latest(raw_doc, endpoint, now, ttl).select("key_id", F.posexplode("doc.data").alias("pos", "item"))
    return rows.select(F.col("key_id").alias("asked_id"), "pos", *_paper(F.col("item")[field])).where(F.col("paper_id").isNotNull())


def reference_obs(raw_doc: DataFrame, now: Column | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """``citing_id``, ``cited_id`` and the cited paper's record."""
    n = _neighbours(raw_doc, "references", "citedPaper", now, ttl)
    return n.select(F.col("asked_id").alias("citing_id"), F.col("paper_id").alias("cited_id"), *[c for c in n.columns if c not in ("asked_id", "paper_id")])


def citation_obs(raw_doc: DataFrame, now: Column | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """``citing_id``, ``cited_id`` and the citing paper's record."""
    n = _neighbours(raw_doc, "citations", "citingPaper", now, ttl)
    return n.select(F.col("paper_id").alias("citing_id"), F.col("asked_id").alias("cited_id"), *[c for c in n.columns if c not in ("asked_id", "paper_id")])


def paper_author(raw_doc: DataFrame, now: Column | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """Authors listed for a paper by the authors endpoint: ``paper_id``, ``pos``, ``author_id``, ``name``, ``homepage``, ``dblp_name``."""
    rows = latest(raw_doc, "authors", now, ttl).select("key_id", F.posexplode("doc.data").alias("pos", "a"))
    return rows.select(F.col("key_id").alias("paper_id"), "pos", falsy(F.col("a.authorId")).alias("author_id"), "a.name", "a.homepage", author_names(F.col("a.externalIds.DBLP")).alias("dblp_name")).where(
        F.col("author_id").isNotNull()
    )


def author_paper(raw_doc: DataFrame, now: Column | None = None, page_cap: int | None = None, ttl: dict[str, int] | None = None) -> DataFrame:
    """``author_id``, ``paper_id``: the papers of an author; ``page_cap`` keeps the first so many of each document."""
    d = latest(raw_doc, "author_papers", now, ttl)
    data = F.slice("doc.data", 1, page_cap) if page_cap else F.col("doc.data")
    return d.select(F.col("key_id").alias("author_id"), F.explode(data).alias("p")).select("author_id", lower_id(F.col("p.paperId")).alias("paper_id")).where(F.col("paper_id").isNotNull()).distinct()
