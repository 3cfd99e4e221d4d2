"""Queries of the crawl's filters and failures, the sinks, the cache and the stream, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lower_id, to_float, to_int
from ..operators import authors as A
from ..operators import crawl as C
from ..operators import graphstore as G
from ..operators.predicates import crawl_predicate
from ..session import cut, scratch
from ..sinks.graph_json import json_lines, merge_nodes, paper_nodes
from ..sinks.property_graph import PropertyGraph
from ..sources import documents as D
from ..sources import seeds as S
from ..sources.cache_tree import append_documents, with_cache_path
from ..sources.fetch import stale_ids
from ..sources.tables import table
from ..streaming.ingest import ingest, read_documents
from . import citation_queries as Q

_ALL: dict[str, Q.Query] = {}
_SQL: dict[str, str] = {}
SHOWN_SINCE = 2015
#: The field list of each endpoint, as it stands in the cache tree's paths.
FIELDS = {"paper": "title,year", "references": "title,year,authors", "citations": "title,year,authors", "authors": "name,homepage", "author_papers": "title"}


def query(sql: str):
    def add(f: Q.Query) -> Q.Query:
        _ALL[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Q.Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- crawls: seeds that fail, papers that aren't written

_OBS, _STEP = Q._SQL_OBS, Q._SQL_STEP
_FAILING = f"""{_OBS}, {_STEP.replace('step as (', 'every as (', 1)}, record as (select lower(paper_id) as id from paper_detail where paper_id <> ''),
 asked as (select lower(paper_id) as id from seed_paper union select lower(paper_id) from paper_detail where paper_id <> '' and year = {Q.SINCE}),
 failed as (select id from asked where id not in (from record)), step as (select * from every where src not in (from failed))"""


@query(f"{Q._sql_walk(2, 'select id from asked where id in (from record)', _FAILING)} select paper_id, depth, depth <= 1 and paper_id not in (from failed) as expanded from level")
def bfs_failed_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The seed papers have no record, so they are claimed and never expanded, even where other seeds' papers lead to them."""
    detail = table(spark, root, "paper_detail", "paper_id", "title", "year").where("paper_id <> ''")
    refs, cits = Q._observations(spark, root)
    seeds = Q._seeds(spark, root).unionByName(detail.where(F.col("year") == Q.SINCE).select(F.col("paper_id").alias("id")))
    return C.crawl(C.CitationSource(detail, refs, cits), seeds, Q.keep_all, 0).discovered


@query(
    f"""{Q._sql_walk(3)}, record as (select lower(paper_id) as id, year from seed_paper union all select lower(paper_id), year from paper_detail
 union all select lower(cited_id), neighbour_year from citation_obs where endpoint = 'references' union all select lower(citing_id), neighbour_year from citation_obs where endpoint = 'citations'),
 shown as (select distinct id from record where year is null or year >= {SHOWN_SINCE}),
 news as (select a.depth as lvl, count(distinct b.paper_id) as n from step join level a on a.paper_id = src join level b on b.paper_id = nbr where b.depth = a.depth + 1 and a.paper_id in (from shown) group by 1)
 select 1 as round, (select count(*) from level where depth <= 1) as expanded, cast((select coalesce(sum(n), 0) from news where lvl <= 1) as bigint) as news
 union all select 2, (select count(*) from level where depth = 2), cast((select coalesce(sum(n), 0) from news where lvl = 2) as bigint)"""
)
def output_filter_stats(spark: SparkSession, root: str) -> DataFrame:
    """Rounds of a crawl whose output filter lets papers since 2015 through: only what these bring in counts as news."""
    return C.crawl(Q._source(spark, root), Q._seeds(spark, root), Q.keep_all, 1, write=lambda y, t: crawl_predicate(y, t, SHOWN_SINCE, None)).stats_frame()


# ---- the property graph after two levels

_TOUCHED = f"""{Q._SQL_EDGES}, {Q._SQL_LATEST}, touched as (select depth as level, paper_id from level where depth <= 1 union select level, citing_id from e union select level, cited_id from e),
 row as (select t.level, lower(p.paper_id) as pid, {Q._sql_hash()} as title_hash, p.title, p.year, nullif({Q._sql_doi('external_ids.doi')}, '') as doi, nullif(p.abstract, '') as abstract,
 nullif(external_ids.dblp, '') as dblp_key, lower(p.paper_id) as paper_id, {Q._SQL_DATE.format(c='publication_date')} as date from touched t join paper p on lower(p.paper_id) = t.paper_id where p.title is not null)"""
_BY = "level desc, pid desc"


def _graph(spark: SparkSession, root: str) -> PropertyGraph:
    """Two levels written; the first one twice, as if the sink had been stopped before it was told."""
    sink = PropertyGraph(spark, scratch(spark, "graph"), cut(Q._latest(spark, root)))

    def write(level: int, expanded: DataFrame, edges: DataFrame) -> None:
        for _ in range(1 if level else 2):
            sink.write_level(level, expanded, edges)

    C.crawl(Q._source(spark, root), Q._seeds(spark, root), Q.keep_all, 0, on_level=write)
    return sink


@query(
    f"""with recursive {_TOUCHED.removeprefix('with recursive ')} select title_hash, {', '.join(f"first({c} order by {_BY}) as {c}" for c in G.ALWAYS)},
 {', '.join(f"cast(first({c} order by {_BY}) filter ({c} is not null) as varchar) as {c}" for c in G.GUARDED)} from row group by 1"""
)
def graph_publications(spark: SparkSession, root: str) -> DataFrame:
    got = _graph(spark, root).table("publication")
    return got.select("title_hash", *G.ALWAYS, *(F.col(c).cast("string").alias(c) for c in G.GUARDED))


@query(f"with recursive {_TOUCHED.removeprefix('with recursive ')}, h as (select distinct pid, title_hash from row) select distinct a.title_hash as src_title_hash, b.title_hash as dst_title_hash from e join h a on a.pid = citing_id join h b on b.pid = cited_id")
def graph_cites(spark: SparkSession, root: str) -> DataFrame:
    return _graph(spark, root).table("cite")


@query(f"with {_OBS} select distinct cited_id as citing_id, citing_id as cited_id from obs")
def edges_reversed(spark: SparkSession, root: str) -> DataFrame:
    return G.reverse_edges(Q._observed_edges(spark, root))


# ---- JSON

@query(f"with {Q._SQL_OBSERVED} select paper_id, cast(row_number() over (partition by paper_id order by pos) - 1 as int) as pos, author_id, nullif(name, '') as name, nullif(array_to_string(dblp, '|'), '') as dblp from observed")
def paper_node_authors(spark: SparkSession, root: str) -> DataFrame:
    """The authors in the JSON sink's nodes, in their order, read back from their JSON."""
    nodes = paper_nodes(Q._latest(spark, root), Q._observed(spark, root))
    back = F.from_json("node", "authors array<struct<authorId:string,name:string,dblp_name:array<string>>>")
    each = nodes.select("paper_id", F.posexplode(back["authors"]).alias("pos", "a"))
    names = F.when(F.size("a.dblp_name") > 0, F.array_join("a.dblp_name", "|"))
    return each.select("paper_id", "pos", F.col("a.authorId").alias("author_id"), "a.name", F.nullif(names, F.lit("")).alias("dblp"))


@query(f"with {Q._SQL_OBSERVED} select paper_id, pos, author_id, nullif(name, '') as name, nullif(dblp[1], '') as dblp_pid from observed")
def author_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Authors as the JSON sink has them, read back from their JSON."""
    o = Q._observed(spark, root)
    text = F.to_json(A.author_json(F.col("author_id"), F.col("name"), F.get("dblp_name", F.lit(0))))
    return o.select("paper_id", "pos", F.from_json(text, "authorId string, name string, dblp_pid string").alias("a")).select("paper_id", "pos", F.col("a.authorId").alias("author_id"), "a.name", "a.dblp_pid")


@query(
    f"""{Q._SQL_EDGES}, {Q._SQL_LATEST}, known as (select citing_id, cited_id from e where citing_id in (select lower(paper_id) from paper) and cited_id in (select lower(paper_id) from paper))
 select 'edge' as kind, citing_id as a, cited_id as b from known
 union all select 'node', lower(paper_id), nullif({Q._sql_hash()}, '') from paper where lower(paper_id) in (select paper_id from level where depth <= 1 union select citing_id from e union select cited_id from e)"""
)
def json_graph_document(spark: SparkSession, root: str) -> DataFrame:
    """The crawl's graph as lines of one JSON document, read back: edges between papers on record, and nodes."""
    papers = Q._latest(spark, root)
    got = Q._crawled(spark, root, 0)
    ids = papers.select("paper_id")
    edges = got.edges.join(ids.withColumnRenamed("paper_id", "citing_id"), "citing_id", "left_semi").join(ids.withColumnRenamed("paper_id", "cited_id"), "cited_id", "left_semi")
    nodes = paper_nodes(papers.join(got.nodes(), "paper_id", "left_semi"), Q._observed(spark, root))
    lines = json_lines(nodes, edges.select("citing_id", "cited_id"))
    body = F.regexp_replace("line", "^, ", "")
    edge = F.from_json(body, "array<string>")
    node = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,struct<title_hash:string>>")
    a, b = F.when(F.col("part") == 3, edge[0]).otherwise(F.map_keys(node)[0]), F.when(F.col("part") == 3, edge[1]).otherwise(F.map_values(node)[0]["title_hash"])
    return lines.where("part in (1, 3)").select(F.when(F.col("part") == 3, "edge").otherwise("node").alias("kind"), a.alias("a"), b.alias("b"))


@query(Q._SQL["paper_node_projection"])
def nodes_merged(spark: SparkSession, root: str) -> DataFrame:
    """Nodes that knew the DBLP key and no more, merged with nodes that know all else, read back."""
    papers = Q._latest(spark, root)
    none = F.lit(None)
    old = paper_nodes(papers.withColumns({"year": none.cast("int"), **{c: none.cast("string") for c in ("title", "pub_date_raw", "abstract", "doi_raw")}}))
    new = paper_nodes(papers.withColumn("dblp_key", none.cast("string")))
    back = F.from_json("node", "dblp_key string, title string, title_hash string, year int, date string, doi string")
    return merge_nodes(old, new).select("paper_id", back.alias("n")).select("paper_id", "n.*")


# ---- the cache

@query(f"with {Q._SQL_USABLE} select distinct key_id as author_id, lower(item->>'$.paperId') as paper_id from items where endpoint = 'author_papers' and item->>'$.paperId' <> '' and pos < 2")
def author_papers_capped(spark: SparkSession, root: str) -> DataFrame:
    return D.author_paper(table(spark, root, "raw_doc"), page_cap=2)


@query("select raw_id from raw_doc where endpoint = 'paper' and length(body) > 200")
def usable_by_own_test(spark: SparkSession, root: str) -> DataFrame:
    return D.usable(table(spark, root, "raw_doc", "raw_id", "endpoint", "body"), "paper", F.length("body") > 200).select("raw_id")


_PLACES = " ".join(f"when '{k}' then '{v.replace(',', '-')}'" for k, v in FIELDS.items())


@query(f"select raw_id, endpoint || '--' || case endpoint {_PLACES} end || '/' || replace(lower(key_id), ':', '/') || '.json' as place from raw_doc")
def cache_tree_paths(spark: SparkSession, root: str) -> DataFrame:
    return with_cache_path(table(spark, root, "raw_doc", "raw_id", "endpoint", "key_id"), FIELDS).select("raw_id", F.col("path").alias("place"))


@query(
    f"""with {Q._SQL_USABLE} select distinct lower(paper_id) as id from paper_detail where paper_id <> ''
 and lower(paper_id) not in (select key_id from usable where endpoint = 'citations' and key_id is not null and timestamptz '{Q.NOW}+00' < fetched_at + interval 7 day)"""
)
def documents_to_fetch(spark: SparkSession, root: str) -> DataFrame:
    """The papers whose citations would be asked for: without a usable document that is still fresh."""
    ids = table(spark, root, "paper_detail", "paper_id").select(F.col("paper_id").alias("id"))
    return stale_ids(ids, table(spark, root, "raw_doc", "endpoint", "key_id", "fetched_at", "body"), "citations", F.lit(Q.NOW).cast("timestamp"))


@query("select endpoint, count(*) as n_docs, count(distinct lower(key_id)) as n_keys, cast(sum(octet_length(encode(body))) as bigint) as n_bytes from raw_doc where endpoint is not null group by 1")
def written_through(spark: SparkSession, root: str) -> DataFrame:
    """What the cache's table holds after all documents were appended to it."""
    path = scratch(spark, "cache")
    append_documents(table(spark, root, "raw_doc").where("endpoint is not null"), path)
    return spark.read.parquet(path).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(F.lower("key_id")).alias("n_keys"), F.sum(F.octet_length("body").cast("bigint")).alias("n_bytes"))


@query(
    """select raw_id from (select raw_id, row_number() over (partition by coalesce(endpoint, ''), coalesce(lower(key_id), '') order by fetched_at desc nulls last, raw_id desc) as n from raw_doc) where n = 1"""
)
def stream_latest_documents(spark: SparkSession, root: str) -> DataFrame:
    """The newest document per key after the table arrived as a stream of files."""
    inbox, kept = scratch(spark, "inbox"), scratch(spark, "newest")
    table(spark, root, "raw_doc").repartition(3, "raw_id").write.parquet(inbox)
    ingest(read_documents(spark, inbox, 1), kept, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(kept).select("raw_id")


# ---- seeds given by hand, casts

LITERAL = ["P1", '["a1", "B2"]', "[broken", "12"]


def three_ids(spark: SparkSession) -> list[str]:
    return ["called", "P1", "c3"]


@query("select unnest(['p1', 'a1', 'b2', '[broken', '12', 'called', 'c3']) as id union select lower(paper_id) from seed_paper")
def seeds_by_hand(spark: SparkSession, root: str) -> DataFrame:
    return S.seed_union(S.literal_seeds(spark, LITERAL), S.called_seeds(spark, f"{__name__}:three_ids"), Q._seeds(spark, root))


@query("select paper_id, publication_date, try_cast(publication_date as int) as as_int, try_cast(publication_date as double) as as_float from paper_detail")
def casts(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "paper_detail", "paper_id", "publication_date")
    return d.select("paper_id", "publication_date", to_int(F.col("publication_date")).alias("as_int"), to_float(F.col("publication_date")).alias("as_float"))


@query("select distinct lower(citing_id) as paper_id from citation_obs where citing_id <> ''")
def observed_papers(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "citation_obs", "citing_id").select(lower_id(F.col("citing_id")).alias("paper_id")).where("paper_id is not null").distinct()
