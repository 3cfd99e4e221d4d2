"""``python -m paperweave.cli``: a crawl over stored tables, written as a JSON graph or as property-graph tables."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.crawl import CitationSource, CrawlResult, crawl
from .operators.predicates import crawl_predicate
from .options import ttl_days
from .session import build_session, cut, shared_dir
from .sinks.graph_json import paper_nodes, write_json_graph, write_tables
from .sinks.property_graph import PropertyGraph
from .sources import documents
from .sources.fetch import CachedApi
from .sources.seeds import called_seeds, literal_seeds, seed_authors, seed_papers_keywords, seed_union


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperweave", description="Crawl a citation graph from cached documents.")
    p.add_argument("--documents", required=True, help="Parquet table of cached documents; with --base, what is fetched is added to it")
    p.add_argument("--base", help="fetch what isn't cached from the API at this URL")
    p.add_argument("--now", help="time by which documents have expired, ISO; without it nothing expires unless --base is given")
    p.add_argument("--page-cap", type=int, help="take the first so many papers of each author document only")
    p.add_argument("--fields", action="append", default=[], help="ENDPOINT=fields to ask the API for; repeat for each endpoint")
    p.add_argument("-y", "--year", type=int, default=2000, help="keep papers of this year or later, or of unknown year")
    p.add_argument("-l", "--limit", type=int, default=-1, help="rounds after the first; negative: until nothing is new")
    p.add_argument("-k", "--keyword", action="append", default=[], help="words a title must all have; repeat for alternatives")
    p.add_argument("-p", "--pid", action="append", default=[], help="paper id, or JSON list of ids, to begin with")
    p.add_argument("-a", "--aid", action="append", default=[], help="author id, or JSON list of ids, to begin with")
    p.add_argument("--pids-from", help="MODULE:FUNCTION that returns paper ids to begin with")
    p.add_argument("--aids-from", help="MODULE:FUNCTION that returns author ids to begin with")
    p.add_argument("--publications", help="stored publications; those that match year and keywords are seeds, too")
    p.add_argument("--persons", help="stored persons; their author ids are seeds, too")
    sub = p.add_subparsers(dest="sink", required=True)
    j = sub.add_parser("json", help="nodes and edges")
    j.add_argument("--dest", required=True)
    j.add_argument("--one-document", action="store_true", help="a single JSON document, for small graphs")
    g = sub.add_parser("graph", help="property-graph tables, upserted")
    g.add_argument("--dest", required=True)
    g.add_argument("--no-skip-existing", action="store_true", help="write references the store links already, too")
    return p


def run(args: argparse.Namespace) -> CrawlResult:
    spark = build_session()
    shared_dir(spark)
    now = F.lit(args.now).cast("timestamp") if args.now else None
    live = None
    if args.base:
        live = CachedApi(spark, args.documents, args.base, now, fields=dict(f.split("=", 1) for f in args.fields), page_cap=args.page_cap)
    seeds: DataFrame = literal_seeds(spark, args.pid)
    if args.publications:
        seeds = seed_union(seeds, seed_papers_keywords(spark.read.parquet(args.publications), args.year, *args.keyword))
    authors = literal_seeds(spark, args.aid, "author_id")
    if args.pids_from:
        seeds = seed_union(seeds, called_seeds(spark, args.pids_from))
    if args.aids_from:
        authors = authors.unionByName(called_seeds(spark, args.aids_from, "author_id"))
    if args.persons:
        authors = authors.unionByName(seed_authors(spark.read.parquet(args.persons)))
    keep = lambda y, t: crawl_predicate(y, t, args.year, args.keyword)
    got = None
    if live:  # fetch first, then write from what the cache holds
        got = crawl(live, seeds, keep, args.limit, authors)
        live.ask(got.discovered.where("expanded").select(F.col("paper_id").alias("id")), "authors")
        raw, now = live.cache(), live.now
    else:
        raw = spark.read.parquet(args.documents)
    ttl = ttl_days()
    detail = documents.paper_detail(raw, now, ttl)
    source = CitationSource(detail, documents.reference_obs(raw, now, ttl), documents.citation_obs(raw, now, ttl), documents.author_paper(raw, now, args.page_cap, ttl))
    cols = ["title", "year", "pub_date_raw", "abstract", "dblp_key", "doi_raw"]
    record = detail.select("paper_id", F.struct(F.lit(0).alias("k"), *cols).alias("r"))
    for obs, key in ((source.reference_obs, "cited_id"), (source.citation_obs, "citing_id")):
        record = record.unionByName(obs.select(F.col(key).alias("paper_id"), F.struct(F.lit(1).alias("k"), *cols).alias("r")))
    papers = record.groupBy("paper_id").agg(F.min("r").alias("r")).select("paper_id", *[f"r.{c}" for c in cols])
    observed = documents.paper_author(raw, now, ttl)
    sink = None
    if args.sink == "graph":
        sink = PropertyGraph(spark, args.dest, cut(papers), source.reference_obs, observed, skip_existing=not args.no_skip_existing)
    if got is None or sink:
        got = crawl(source, seeds, keep, args.limit, authors, on_level=sink.write_level if sink else None)
    if args.sink == "json":
        nodes = paper_nodes(papers.join(got.nodes(), "paper_id", "left_semi"), observed)
        (write_json_graph if args.one_document else write_tables)(nodes, got.edges.select("citing_id", "cited_id"), args.dest)
    return got


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    run(arguments().parse_args())
