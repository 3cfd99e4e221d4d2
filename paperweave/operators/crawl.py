"""Level-by-level expansion of a citation graph from seeds, as set-at-a-time joins.

Observations are filtered once and turned into a table of steps (from a paper to a neighbour, with the edge the step
proves). A level joins its frontier with the steps, unites the new edges, and keeps the neighbours not discovered yet.
Each level is written to the shared folder, so lineage doesn't grow and a lost executor costs a task; the driver sees
one count per level.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lower_id
from ..session import cut

_LOG = logging.getLogger(__name__)

#: A frontier of at most so many ids is broadcast (about 16 MB); a larger one meets the steps by shuffle.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class CitationSource:
    """What a crawl reads; every table has lower-case ids, and observation tables the neighbour's year and title.

    ``detail``: paper_id, year, title and more; ``reference_obs`` and ``citation_obs``: citing_id, cited_id, year, title
    of the cited, of the citing paper. ``author_paper``: author_id, paper_id, if authors can be seeds.
    """

    detail: DataFrame
    reference_obs: DataFrame
    citation_obs: DataFrame
    author_paper: DataFrame | None = None


class LiveSource(Protocol):
    """A source that is asked level by level and may fetch what it is asked for; ``ids`` have one column ``id``."""

    def details(self, ids: DataFrame) -> DataFrame: ...

    def observations(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]: ...

    def author_papers(self, author_ids: DataFrame) -> DataFrame: ...

    def source(self) -> CitationSource: ...


@dataclass
class CrawlResult:
    """``discovered``: paper_id, depth, expanded; ``edges``: citing_id, cited_id, level at which it was proved first;
    ``stats``: one (round, expanded, news) per round."""

    discovered: DataFrame
    edges: DataFrame
    stats: list[tuple[int, int, int]] = field(default_factory=list)

    def nodes(self) -> DataFrame:
        """``paper_id`` of the papers of the JSON sink: expanded ones and all ends of edges."""
        ends = self.edges.select(F.explode(F.array("citing_id", "cited_id")).alias("paper_id"))
        return self.discovered.where("expanded").select("paper_id").unionByName(ends).distinct()

    def stats_frame(self) -> DataFrame:
        return self.discovered.sparkSession.createDataFrame(self.stats, "round int, expanded bigint, news bigint")


def steps(source: CitationSource, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """``src``, ``nbr``, ``citing_id``, ``cited_id``: each step an expansion can take, once.

    ``keep(year, title)`` is the crawl filter; it is applied to the neighbour's record, before anything is shuffled.
    Rows with a null id are left out.
    """
    def side(obs: DataFrame, src: str, nbr: str) -> DataFrame:
        ok = obs.where(keep(F.col("year"), F.col("title")))
        return ok.select(lower_id(F.col(src)).alias("src"), lower_id(F.col(nbr)).alias("nbr"), lower_id(F.col("citing_id")).alias("citing_id"), lower_id(F.col("cited_id")).alias("cited_id"))

    both = side(source.reference_obs, "citing_id", "cited_id").unionByName(side(source.citation_obs, "cited_id", "citing_id"))
    return both.where("src is not null and nbr is not null").distinct()


def expand(frontier: DataFrame, step: DataFrame, n_frontier: int) -> DataFrame:
    """The steps that begin in the ``frontier`` (``paper_id``, ``n_frontier`` unique ids)."""
    ids = frontier.select(F.col("paper_id").alias("src"))
    return step.join(F.broadcast(ids) if n_frontier <= BROADCAST_IDS else ids, "src", "left_semi")


def crawl(
    source: CitationSource | LiveSource,
    seeds: DataFrame,
    keep: Callable[[Column, Column], Column],
    limit: int = -1,
    author_seeds: DataFrame | None = None,
    write: Callable[[Column, Column], Column] | None = None,
    on_level: Callable[[int, DataFrame, DataFrame], None] | None = None,
) -> CrawlResult:
    """Crawl from ``seeds`` (``id``) and the papers of ``author_seeds`` (``author_id``).

    Seeds are not filtered; those without a record in ``detail`` are claimed but never expanded, even if they are
    discovered later. The first round expands the seeds and what they find; each further round one level; ``limit`` L >= 0
    allows L + 1 rounds, a negative one any number; a round without news is the last. ``write`` filters what counts as
    news, so it can end a crawl early. ``on_level`` gets each level's number, expanded papers and new edges (a sink).
    A live source is asked for the seeds' records and each level's observations as it comes. Each level is logged.
    Empty seeds give an empty result. Self-loops and cycles are kept and end the crawl properly.
    """
    from ..sources.seeds import seed_union, seeds_from_authors

    spark = seeds.sparkSession
    live = None if isinstance(source, CitationSource) else source
    by_author = None if author_seeds is None else live.author_papers(author_seeds) if live else source.author_paper
    seeds = seed_union(seeds) if by_author is None else seed_union(seeds, seeds_from_authors(author_seeds, by_author))
    step = None if live else cut(steps(source, keep))
    claimed = cut(seeds.select(F.col("id").alias("paper_id")))
    detail = live.details(claimed.select(F.col("paper_id").alias("id"))) if live else source.detail
    frontier = cut(detail.select(lower_id(F.col("paper_id")).alias("paper_id")).join(claimed, "paper_id", "left_semi").distinct())
    failed = cut(claimed.join(frontier, "paper_id", "left_anti"))
    any_failed = failed.limit(1).count() > 0
    shown = None if live else _shown(source, write)
    # one part per level, written once; what is known or proved is their union
    known = [frontier.select("paper_id", F.lit(0).alias("depth"), F.lit(True).alias("expanded"))]
    edges = [spark.createDataFrame([], "citing_id string, cited_id string, level int")]
    stats: list[tuple[int, int, int]] = []
    level, rounds, round_news, round_expanded = 0, 0, 0, 0
    n = frontier.count()
    while True:
        if live:
            step = steps(CitationSource(detail, *live.observations(frontier.select(F.col("paper_id").alias("id")))), keep)
            shown = _shown(live.source(), write)
        taken = cut(expand(frontier, step, n).select("src", "nbr", "citing_id", "cited_id"))
        proved = taken.select("citing_id", "cited_id").distinct()
        if on_level is not None:
            proved = cut(proved.join(_union(edges), ["citing_id", "cited_id"], "left_anti"))
            on_level(level, frontier, proved)
        edges.append(proved.withColumn("level", F.lit(level)))
        found = cut(taken.select(F.col("nbr").alias("paper_id")).distinct().join(_union(known).select("paper_id"), "paper_id", "left_anti"))
        n_found = found.count()
        news = n_found
        if shown is not None:  # news count only with the papers that are written
            seen = taken.join(shown.select(F.col("paper_id").alias("src")), "src", "left_semi").select(F.col("nbr").alias("paper_id")).distinct()
            news = seen.join(found, "paper_id", "left_semi").count()
        _LOG.info("level %d: %d papers expanded, %d new", level, n, n_found)
        round_news += news
        round_expanded += n
        level += 1
        ends_round = level != 1
        if ends_round:
            rounds += 1
            stats.append((rounds, round_expanded, round_news))
        more = not ends_round or (round_news > 0 and (limit < 0 or rounds <= limit))
        # a seed that failed is discovered as a node but stays claimed
        frontier = cut(found.join(failed, "paper_id", "left_anti")) if any_failed else found
        known.append(frontier.select("paper_id", F.lit(level).alias("depth"), F.lit(more).alias("expanded")))
        if any_failed:
            known.append(found.join(failed, "paper_id", "left_semi").select("paper_id", F.lit(level).alias("depth"), F.lit(False).alias("expanded")))
        if not more:
            # an edge that both its ends proved belongs to the earlier level
            first = _union(edges) if on_level is not None else _union(edges).groupBy("citing_id", "cited_id").agg(F.min("level").alias("level"))
            return CrawlResult(_union(known), first, stats)
        if ends_round:
            round_news = round_expanded = 0
        n = frontier.count() if any_failed else n_found


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _shown(source: CitationSource, write: Callable[[Column, Column], Column] | None) -> DataFrame | None:
    """``paper_id`` of the papers an output filter lets through, by any record there is of them."""
    if write is None:
        return None
    ids = [(source.detail, "paper_id"), (source.reference_obs, "cited_id"), (source.citation_obs, "citing_id")]
    return cut(_union([t.where(write(F.col("year"), F.col("title"))).select(lower_id(F.col(k)).alias("paper_id")) for t, k in ids]).distinct())


def discovered_records(result: CrawlResult, source: CitationSource, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """One record per discovered paper: its detail, else the one of the observation made first.

    First means: at the least depth of the asking paper, references before citations, then the least asking id. Further
    columns that all the source's tables have come along.
    """
    more = [c for c in source.detail.columns if c not in ("paper_id", "year", "title", "depth", "expanded", "parent", "rank") and c in source.reference_obs.columns and c in source.citation_obs.columns]
    cols = ["year", "title", *more]
    d = source.detail.select(lower_id(F.col("paper_id")).alias("paper_id"), *cols).withColumn("rank", F.struct(F.lit(0).alias("kind"), F.lit(0).alias("depth"), F.lit(0).alias("side"), F.lit("").alias("parent")))
    depth = result.discovered.select(F.col("paper_id").alias("parent"), "depth")
    parts = [d]
    for k, (obs, src, nbr) in enumerate(((source.reference_obs, "citing_id", "cited_id"), (source.citation_obs, "cited_id", "citing_id"))):
        o = obs.where(keep(F.col("year"), F.col("title"))).select(lower_id(F.col(nbr)).alias("paper_id"), lower_id(F.col(src)).alias("parent"), *cols)
        o = o.join(depth, "parent").withColumn("rank", F.struct(F.lit(1).alias("kind"), "depth", F.lit(k).alias("side"), "parent"))
        parts.append(o.select("paper_id", *cols, "rank"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = every.groupBy("paper_id").agg(F.min_by(F.struct(*cols), F.struct("rank", *cols)).alias("r"))
    return result.discovered.join(best, "paper_id", "left").select("paper_id", "depth", "expanded", *(f"r.{c}" for c in cols))


def adjacency(edges: DataFrame) -> DataFrame:
    """``citing_id``, ``n_cited`` (distinct) of each citing paper."""
    return edges.select("citing_id", "cited_id").distinct().groupBy("citing_id").agg(F.count(F.lit(1)).alias("n_cited"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs of papers that cite each other, once: ``a`` < ``b``."""
    e = edges.where("citing_id <> cited_id").select(F.least("citing_id", "cited_id").alias("a"), F.greatest("citing_id", "cited_id").alias("b"), (F.col("citing_id") < F.col("cited_id")).alias("up"))
    return e.groupBy("a", "b").agg(F.min("up").alias("lo"), F.max("up").alias("hi")).where("lo <> hi").select("a", "b")


def news_by_paper(result: CrawlResult, step: DataFrame) -> DataFrame:
    """``paper_id``, ``news``: how many papers each expanded one brought in, 0 for none.

    A paper found by several of one level counts for the least of their ids, so the figures don't depend on any order.
    """
    depth = result.discovered.select("paper_id", "depth")
    found = depth.where("depth > 0").select(F.col("paper_id").alias("nbr"), (F.col("depth") - 1).alias("from_depth"))
    parents = result.discovered.where("expanded").select(F.col("paper_id").alias("src"), F.col("depth").alias("from_depth"))
    by = step.select("src", "nbr").distinct().join(found, "nbr").join(parents, ["src", "from_depth"]).groupBy("nbr").agg(F.min("src").alias("src"))
    news = by.groupBy(F.col("src").alias("paper_id")).agg(F.count(F.lit(1)).alias("news"))
    return result.discovered.where("expanded").select("paper_id").join(news, "paper_id", "left").select("paper_id", F.coalesce("news", F.lit(0)).alias("news"))
