"""Documents through the cache: what is there and fresh is used, the rest is fetched and written through."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import options
from ..operators.crawl import CitationSource
from ..operators.predicates import fresh
from ..schemas import RAW_DOC
from ..session import cut
from . import documents, rest
from .cache_tree import append_documents


def stale_ids(ids: DataFrame, cache: DataFrame, endpoint: str, now: Column, ttl: dict[str, int] | None = None) -> DataFrame:
    """``id``: those of ``ids`` without a usable document of the endpoint that is still fresh. Null ids are left out."""
    good = documents.usable(cache, endpoint).where(fresh(F.col("fetched_at"), F.col("endpoint"), now, ttl)).select(F.lower("key_id").alias("id"))
    return ids.select(F.lower("id").alias("id")).where("id <> ''").distinct().join(good, "id", "left_anti")


def through_cache(ids: DataFrame, cache: DataFrame, endpoint: str, now: Column, base: str, ttl: dict[str, int] | None = None, **request) -> DataFrame:
    """Newly fetched documents for the ids that need one: ``endpoint``, ``key_id``, ``path``, ``fetched_at``, ``body``.

    Append them with ``append_documents``; failed fetches are left out, so they are asked for again. ``request``: see
    ``request_documents``. The ids stay in their tasks.
    """
    need = stale_ids(ids, cache, endpoint, now, ttl)
    return rest.request_documents(need, endpoint, base, **request).where(F.col("body").isNotNull())


def unusable(cache: DataFrame) -> DataFrame:
    """The documents no reader takes (not JSON, not an object, without the endpoint's key), to be deleted or looked into.

    They never hide an older usable document and are asked for again like absent ones.
    """
    return cache.join(documents.usable_any(cache).select("raw_id"), "raw_id", "left_anti")


@dataclass
class CachedApi:
    """A crawl's source that fetches what it is asked for: the API behind a cache (a Parquet table below ``path``).

    ``now``: the time by which documents have expired (the present by default); ``ttl``: days per endpoint, with the
    environment's overrides by default. ``concurrency``, ``sleep``, ``timeout`` and ``headers`` come from the environment where they
    aren't given. Each endpoint's documents of a level are fetched in one go and written through before they are read.
    """

    spark: SparkSession
    path: str
    base: str
    now: Column | None = None
    ttl: dict[str, int] | None = None
    fields: dict[str, str] = field(default_factory=dict)
    concurrency: int | None = None
    sleep: float | None = None
    timeout: float | None = None
    headers: dict[str, str] | None = None
    page_cap: int | None = None

    def __post_init__(self) -> None:
        self.now = F.current_timestamp() if self.now is None else self.now
        self.ttl = options.ttl_days() if self.ttl is None else self.ttl
        pick = lambda given, env, default: given if given is not None else env if env is not None else default
        self.request = {
            "concurrency": pick(self.concurrency, options.env_int("HTTP_CONCURRENCY"), 8), "sleep": pick(self.sleep, options.env_float("HTTP_SLEEP"), 0.0),
            "timeout": pick(self.timeout, options.env_float("HTTP_TIMEOUT"), 30.0), "headers": options.env_headers() if self.headers is None else self.headers,
        }

    def cache(self) -> DataFrame:
        """All cached documents, with an id made from place and time; empty if there are none."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], RAW_DOC)
        docs = self.spark.read.schema(f"{rest.DOCUMENT}").parquet(self.path)
        return docs.withColumn("raw_id", F.xxhash64("endpoint", "key_id", "fetched_at", "body"))

    def ask(self, ids: DataFrame, *endpoints: str) -> DataFrame:
        """The cached documents of ``ids`` (``id``) at the endpoints, after fetching those that are absent, bad or stale."""
        for e in endpoints:
            new = cut(through_cache(ids, self.cache(), e, self.now, self.base, self.ttl, fields=self.fields.get(e, ""), **self.request))
            if new.limit(1).count():
                append_documents(new, self.path)
        want = ids.select(F.lower("id").alias("_id")).distinct()
        return self.cache().where(F.col("endpoint").isin(*endpoints)).join(want, F.lower("key_id") == F.col("_id"), "left_semi")

    def details(self, ids: DataFrame) -> DataFrame:
        return documents.paper_detail(self.ask(ids, "paper"), self.now, self.ttl)

    def observations(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The references and citations of the papers ``ids``."""
        raw = cut(self.ask(ids, "references", "citations"))
        return documents.reference_obs(raw, self.now, self.ttl), documents.citation_obs(raw, self.now, self.ttl)

    def authors(self, ids: DataFrame) -> DataFrame:
        return documents.paper_author(self.ask(ids, "authors"), self.now, self.ttl)

    def author_papers(self, author_ids: DataFrame) -> DataFrame:
        return documents.author_paper(self.ask(author_ids.select(F.col("author_id").alias("id")), "author_papers"), self.now, self.page_cap, self.ttl)

    def source(self) -> CitationSource:
        """What the cache holds by now, as tables."""
        raw = self.cache()
        args = (raw, self.now)
        return CitationSource(documents.paper_detail(*args, self.ttl), documents.reference_obs(*args, self.ttl), documents.citation_obs(*args, self.ttl), documents.author_paper(raw, self.now, self.page_cap, self.ttl))
