"""Queries of the citation-graph operators, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cache_path, doi_norm, lower_id, pub_date, title_hash
from ..operators import authors as A
from ..operators import crawl as C
from ..operators import graphstore as G
from ..operators.predicates import crawl_predicate, fresh, stored_predicate
from ..session import cut
from ..sinks.graph_json import paper_nodes
from ..sources import documents as D
from ..sources import seeds as S
from ..sources.tables import table

SINCE = 2000
RULES = ["graphs", "open repositories", "data streams"]
HASH_RULES = ["toolkit", "beyond methods"]
NOW = "2024-07-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- scalars

_HASH = "regexp_replace(lower({c}), '[^0-9a-z\\x{{4e00}}-\\x{{9fa5}}]', '', 'g')"


def _sql_hash(c: str = "title") -> str:
    return _HASH.format(c=c)


def _sql_doi(c: str = "doi") -> str:
    s = f"regexp_replace(regexp_replace({c}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"
    rest = f"regexp_replace(regexp_replace(regexp_replace({s}, '^[A-Za-z][A-Za-z0-9+.\\-]*:', ''), '^//[^/?#]*', ''), '[?#].*$', '', 's')"
    bare = f"case when lower(regexp_extract({s}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) in ('', 'ftp', 'http', 'https', 'hdl', 'sip', 'sips', 'tel') then regexp_replace({rest}, ';[^/]*$', '') else {rest} end"
    return f"regexp_replace({bare}, '^/+', '')"


_SQL_DATE = """case when regexp_full_match({c}, '[0-9]{{4}}') then try_cast({c} || '-01-01' as date)
 when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}') then try_cast({c} || '-01' as date)
 when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({c} as date)
 when regexp_matches({c}, '[0-9]{{4}}') then cast(try_strptime(trim({c}), ['%Y/%-m/%-d', '%Y%m%d', '%-m/%-d/%Y', '%-d.%-m.%Y', '%b %-d, %Y', '%B %-d, %Y', '%-d %b %Y', '%-d %B %Y', '%Y-%m-%dT%H:%M:%S']) as date) end"""


@query(f"select element_id, {_sql_hash()} as hash from publication")
def title_hashes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "publication", "element_id", "title").select("element_id", title_hash(F.col("title")).alias("hash"))


@query(f"select element_id, {_sql_doi()} as doi_n from publication")
def doi_norms(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "publication", "element_id", "doi").select("element_id", doi_norm(F.col("doi")).alias("doi_n"))


@query(f"select paper_id, publication_date, cast({_SQL_DATE.format(c='publication_date')} as varchar) as parsed from paper_detail")
def pub_date_parse(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "paper_detail", "paper_id", "publication_date").select("paper_id", "publication_date", pub_date(F.col("publication_date")).cast("string").alias("parsed"))


@query("select raw_id, replace(key_id, ':', '/') || '.json' as place from raw_doc")
def cache_paths(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_doc", "raw_id", "key_id").select("raw_id", cache_path(F.col("key_id")).alias("place"))


# ---- filters and seeds

_SQL_KW = "(contains(lower({t}), 'graphs') or (contains(lower({t}), 'open') and contains(lower({t}), 'repositories')) or (contains(lower({t}), 'data') and contains(lower({t}), 'streams')))"
_SQL_HKW = "(contains(title_hash, 'toolkit') or (contains(title_hash, 'beyond') and contains(title_hash, 'methods')))"


def keep_all(y: Column, t: Column) -> Column:
    return crawl_predicate(y, t, SINCE, None)


def keep_words(y: Column, t: Column) -> Column:
    return crawl_predicate(y, t, SINCE, RULES)


@query(f"select paper_id, title, year from paper_detail where (year is null or year >= {SINCE}) and coalesce({_SQL_KW.format(t='title')}, false)")
def filter_year_keyword(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "paper_detail", "paper_id", "title", "year").where(keep_words(F.col("year"), F.col("title")))


@query(f"select element_id, title_hash, year from publication where year >= {SINCE} and {_SQL_HKW}")
def filter_year_strict_hash_keyword(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "publication", "element_id", "title_hash", "year").where(stored_predicate(F.col("year"), F.col("title_hash"), SINCE, HASH_RULES))


_SQL_SEED = f"coalesce(nullif(paper_id, ''), 'DOI:' || {_sql_doi('nullif(doi, $$$$)')})"


@query(f"select {_SQL_SEED} as id from publication where {_SQL_SEED} is not null")
def seed_papers_scan(spark: SparkSession, root: str) -> DataFrame:
    return S.seed_papers(table(spark, root, "publication", "paper_id", "doi"))


@query("select author_id from person where author_id <> ''")
def seed_authors_scan(spark: SparkSession, root: str) -> DataFrame:
    return S.seed_authors(table(spark, root, "person", "author_id"))


@query(f"select {_SQL_SEED} as id from publication where {_SQL_SEED} is not null and year >= {SINCE} and {_SQL_HKW}")
def seed_papers_keywords(spark: SparkSession, root: str) -> DataFrame:
    return S.seed_papers_keywords(table(spark, root, "publication", "paper_id", "doi", "year", "title_hash"), SINCE, *HASH_RULES)


# ---- documents

_SQL_USABLE = """usable as (select raw_id, endpoint, lower(key_id) as key_id, fetched_at, cast(body as json) as j from raw_doc
 where case when json_valid(body) then json_type(body) = 'OBJECT' and list_contains(json_keys(body), case when endpoint = 'paper' then 'paperId' else 'data' end) else false end),
 latest as (select * from (select *, row_number() over (partition by endpoint, key_id order by fetched_at desc nulls last, raw_id desc) as n from usable where key_id is not null) where n = 1),
 items as (select endpoint, key_id, unnest(from_json(json_extract(j, '$.data'), '["json"]')) as item, generate_subscripts(from_json(json_extract(j, '$.data'), '["json"]'), 1) - 1 as pos
 from latest where endpoint <> 'paper' and json_type(j, '$.data') = 'ARRAY')"""


@query(f"with {_SQL_USABLE} select raw_id, endpoint from usable")
def usable_documents(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "raw_doc", "raw_id", "endpoint", "key_id", "fetched_at", "body")
    return D.usable_any(raw).select("raw_id", "endpoint")


@query(
    f"""with {_SQL_USABLE} select key_id as paper_id, j->>'$.title' as title, try_cast(j->>'$.year' as int) as year, j->>'$.publicationDate' as pub_date_raw,
 j->>'$.externalIds.DBLP' as dblp_key, j->>'$.externalIds.DOI' as doi_raw from latest where endpoint = 'paper' and lower(j->>'$.paperId') = key_id and key_id <> ''"""
)
def document_papers(spark: SparkSession, root: str) -> DataFrame:
    return D.paper_detail(table(spark, root, "raw_doc")).select("paper_id", "title", "year", "pub_date_raw", "dblp_key", "doi_raw")


def _sql_neighbours(endpoint: str, field: str, citing: str, cited: str) -> str:
    return f"""with {_SQL_USABLE} select {citing} as citing_id, {cited} as cited_id, pos, item->>'$.{field}.title' as title, try_cast(item->>'$.{field}.year' as int) as year
 from items where endpoint = '{endpoint}' and item->>'$.{field}.paperId' <> ''"""


@query(_sql_neighbours("references", "citedPaper", "key_id", "lower(item->>'$.citedPaper.paperId')"))
def document_references(spark: SparkSession, root: str) -> DataFrame:
    return D.reference_obs(table(spark, root, "raw_doc")).select("citing_id", "cited_id", "pos", "title", "year")


@query(_sql_neighbours("citations", "citingPaper", "lower(item->>'$.citingPaper.paperId')", "key_id"))
def document_citations(spark: SparkSession, root: str) -> DataFrame:
    return D.citation_obs(table(spark, root, "raw_doc")).select("citing_id", "cited_id", "pos", "title", "year")


@query(f"with {_SQL_USABLE} select key_id as paper_id, pos, item->>'$.authorId' as author_id, item->>'$.name' as name, item->>'$.homepage' as homepage from items where endpoint = 'authors' and item->>'$.authorId' <> ''")
def document_authors(spark: SparkSession, root: str) -> DataFrame:
    return D.paper_author(table(spark, root, "raw_doc")).select("paper_id", "pos", "author_id", "name", "homepage")


@query(f"with {_SQL_USABLE} select distinct key_id as author_id, lower(item->>'$.paperId') as paper_id from items where endpoint = 'author_papers' and item->>'$.paperId' <> ''")
def document_author_papers(spark: SparkSession, root: str) -> DataFrame:
    return D.author_paper(table(spark, root, "raw_doc"))


@query(f"select raw_id from raw_doc where endpoint not in ('citations', 'author_papers') or timestamptz '{NOW}+00' < fetched_at + interval 7 day")
def ttl_fresh_docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_doc", "raw_id", "endpoint", "fetched_at").where(fresh(F.col("fetched_at"), F.col("endpoint"), F.lit(NOW).cast("timestamp"))).select("raw_id")


_SQL_AUTHOR_SEEDS = f"""with {_SQL_USABLE} select distinct lower(item->>'$.paperId') as id from items where endpoint = 'author_papers' and item->>'$.paperId' <> ''
 and key_id in (select author_id from person)"""


def _author_seeds(spark: SparkSession, root: str) -> DataFrame:
    return S.seeds_from_authors(S.seed_authors(table(spark, root, "person", "author_id")), D.author_paper(table(spark, root, "raw_doc")))


@query(_SQL_AUTHOR_SEEDS)
def seeds_from_author(spark: SparkSession, root: str) -> DataFrame:
    return _author_seeds(spark, root).distinct()


@query(f"select id from ({_SQL_AUTHOR_SEEDS}) union select lower(paper_id) from seed_paper union select lower({_SQL_SEED}) from publication where {_SQL_SEED} is not null")
def seed_union_distinct(spark: SparkSession, root: str) -> DataFrame:
    own = table(spark, root, "seed_paper", "paper_id").select(F.col("paper_id").alias("id"))
    return S.seed_union(own, _author_seeds(spark, root), S.seed_papers(table(spark, root, "publication", "paper_id", "doi")))


# ---- neighbours and crawls over the observed citations

_SQL_OBS = f"""obs as (select endpoint, lower(citing_id) as citing_id, lower(cited_id) as cited_id, neighbour_year as year from citation_obs
 where citing_id <> '' and cited_id <> '' and (neighbour_year is null or neighbour_year >= {SINCE}))"""
_SQL_STEP = "step as (select citing_id as src, cited_id as nbr, citing_id, cited_id from obs where endpoint = 'references' union select cited_id, citing_id, citing_id, cited_id from obs where endpoint = 'citations')"


def _observations(spark: SparkSession, root: str, titles: bool = False) -> tuple[DataFrame, DataFrame]:
    obs = table(spark, root, "citation_obs", "endpoint", "citing_id", "cited_id", "neighbour_year").withColumnRenamed("neighbour_year", "year")
    refs, cits = obs.where("endpoint = 'references'").drop("endpoint"), obs.where("endpoint = 'citations'").drop("endpoint")
    if not titles:
        none = F.lit(None).cast("string")
        return refs.withColumn("title", none), cits.withColumn("title", none)
    known = _latest(spark, root).select("paper_id", "title")
    return tuple(o.withColumn("paper_id", lower_id(F.col(k))).join(known, "paper_id", "left").drop("paper_id") for o, k in ((refs, "cited_id"), (cits, "citing_id")))


def _source(spark: SparkSession, root: str, titles: bool = False) -> C.CitationSource:
    seeds = table(spark, root, "seed_paper", "paper_id", "title", "year")
    refs, cits = _observations(spark, root, titles)
    return C.CitationSource(seeds.unionByName(table(spark, root, "paper_detail", "paper_id", "title", "year")), refs, cits)


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "seed_paper", "paper_id").select(F.col("paper_id").alias("id"))


def _crawled(spark: SparkSession, root: str, limit: int) -> C.CrawlResult:
    return C.crawl(_source(spark, root), _seeds(spark, root), keep_all, limit)


@query(f"with {_SQL_OBS} select distinct citing_id, cited_id from obs where endpoint = 'references' and citing_id in (select lower(paper_id) from seed_paper)")
def refs_of_seeds(spark: SparkSession, root: str) -> DataFrame:
    refs, _ = _observations(spark, root)
    step = C.steps(C.CitationSource(refs, refs, refs.limit(0)), keep_all)
    return C.expand(_seeds(spark, root).select(lower_id(F.col("id")).alias("paper_id")), step, 0).select("citing_id", "cited_id")


@query(f"with {_SQL_OBS} select distinct citing_id, cited_id from obs where endpoint = 'citations' and cited_id in (select lower(paper_id) from seed_paper)")
def cits_of_seeds(spark: SparkSession, root: str) -> DataFrame:
    _, cits = _observations(spark, root)
    step = C.steps(C.CitationSource(cits, cits.limit(0), cits), keep_all)
    return C.expand(_seeds(spark, root).select(lower_id(F.col("id")).alias("paper_id")), step, 0).select("citing_id", "cited_id")


@query(f"with {_SQL_OBS}, {_SQL_STEP} select distinct nbr as paper_id from step where src in (select lower(paper_id) from seed_paper)")
def neighbours_union(spark: SparkSession, root: str) -> DataFrame:
    step = C.steps(_source(spark, root), keep_all)
    return C.expand(_seeds(spark, root).select(lower_id(F.col("id")).alias("paper_id")), step, 0).select(F.col("nbr").alias("paper_id")).distinct()


@query(f"with {_SQL_OBS}, {_SQL_STEP} select distinct nbr as paper_id from step where src in (select lower(paper_id) from seed_paper) and nbr not in (select lower(paper_id) from paper_detail)")
def neighbours_anti_discovered(spark: SparkSession, root: str) -> DataFrame:
    known = table(spark, root, "paper_detail", "paper_id").select(lower_id(F.col("paper_id")).alias("paper_id"))
    return neighbours_union(spark, root).join(known, "paper_id", "left_anti")


#: Deepest level the SQL looks at; the crawls here end before it.
DEPTH = 12


def _sql_walk(bound: int, seed: str = "select lower(paper_id) as id from seed_paper", step: str = f"{_SQL_OBS}, {_SQL_STEP}") -> str:
    return f"""with recursive {step}, hop as (select distinct src, nbr from step), walk(id, depth) as (select id, 0 from ({seed}) union
 select nbr, depth + 1 from walk join hop on src = id where depth < {bound}), level as (select id as paper_id, cast(min(depth) as int) as depth from walk group by 1)"""


@query(f"{_sql_walk(2)} select paper_id, depth, depth <= 1 as expanded from level")
def bfs_levels_limit0(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, 0).discovered


@query(f"{_sql_walk(3)} select paper_id, depth, depth <= 2 as expanded from level")
def bfs_levels_limit1(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, 1).discovered


@query(f"{_sql_walk(DEPTH)} select paper_id, depth, true as expanded from level")
def bfs_levels_full(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, -1).discovered


@query(
    f"""{_sql_walk(DEPTH)}, top as (select max(depth) as d from level) select cast(r as int) as round, cast(count(*) filter (depth = r or (r = 1 and depth = 0)) as bigint) as expanded,
 cast(count(*) filter (depth = r + 1 or (r = 1 and depth = 1)) as bigint) as news from level, (select unnest(range(1, {DEPTH})) as r) where r <= (select d from top) group by 1"""
)
def bfs_round_stats(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, -1).stats_frame()


_SQL_EDGES = f"{_sql_walk(2)}, e as (select s.citing_id, s.cited_id, min(l.depth) as level from step s join level l on l.paper_id = s.src where l.depth <= 1 group by 1, 2)"


@query(f"{_SQL_EDGES} select citing_id, cited_id, level from e")
def crawl_edges(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, 0).edges


@query(f"{_SQL_EDGES} select paper_id from level where depth <= 1 union select citing_id from e union select cited_id from e")
def crawl_nodes(spark: SparkSession, root: str) -> DataFrame:
    return _crawled(spark, root, 0).nodes()


@query(f"{_SQL_EDGES} select citing_id, count(distinct cited_id) as n_cited from e group by 1")
def adjacency_counts(spark: SparkSession, root: str) -> DataFrame:
    return C.adjacency(_crawled(spark, root, 0).edges)


@query(f"{_SQL_EDGES} select paper_id from (select citing_id as paper_id from e union select cited_id from e) where paper_id not in (select paper_id from level where depth <= 1)")
def unexpanded_nodes(spark: SparkSession, root: str) -> DataFrame:
    got = _crawled(spark, root, 0)
    return got.nodes().join(got.discovered.where("expanded"), "paper_id", "left_anti")


@query(
    f"""{_sql_walk(2)}, credit as (select s.nbr, min(s.src) as src from step s join level a on a.paper_id = s.src join level b on b.paper_id = s.nbr where b.depth = a.depth + 1 and a.depth <= 1 group by 1)
 select l.paper_id, count(credit.nbr) as news from level l left join credit on credit.src = l.paper_id where l.depth <= 1 group by 1"""
)
def crawl_news_by_paper(spark: SparkSession, root: str) -> DataFrame:
    return C.news_by_paper(_crawled(spark, root, 0), C.steps(_source(spark, root), keep_all))


_SQL_LATEST = """paper as (select * from (select *, row_number() over (partition by lower(paper_id) order by fetched_at desc nulls last, loaded_at desc nulls last, title desc nulls last) as n from paper_detail
 where paper_id <> '') where n = 1)"""
_SQL_KW_STEP = f"""{_SQL_LATEST}, raw as (select o.endpoint, lower(citing_id) as citing_id, lower(cited_id) as cited_id, neighbour_year as year, p.title from citation_obs o
 left join paper p on lower(p.paper_id) = lower(case when o.endpoint = 'references' then cited_id else citing_id end) where citing_id <> '' and cited_id <> ''),
 obs as (select * from raw where (year is null or year >= {SINCE}) and {_SQL_KW.format(t='title')}), {_SQL_STEP}"""


@query(f"{_sql_walk(3, step=_SQL_KW_STEP)} select paper_id, depth, depth <= 2 as expanded from level")
def bfs_keywords(spark: SparkSession, root: str) -> DataFrame:
    """Crawl with a keyword rule; a neighbour's title is that of its record, and one without a record doesn't match."""
    return C.crawl(_source(spark, root, titles=True), _seeds(spark, root), keep_words, 1).discovered


@query(
    f"""{_sql_walk(2)}, d as (select lower(paper_id) as paper_id, year, title from seed_paper union all select lower(paper_id), year, title from paper_detail),
 best as (select paper_id, year, title from (select *, row_number() over (partition by paper_id order by year nulls first, title nulls first) as n from d) where n = 1),
 seen as (select s.nbr as paper_id, o.year, l.depth, case when o.endpoint = 'references' then 0 else 1 end as side, l.paper_id as parent
 from obs o join step s on s.citing_id = o.citing_id and s.cited_id = o.cited_id and s.src = case when o.endpoint = 'references' then o.citing_id else o.cited_id end join level l on l.paper_id = s.src),
 other as (select paper_id, year from (select *, row_number() over (partition by paper_id order by depth, side, parent, year nulls first) as n from seen) where n = 1)
 select l.paper_id, l.depth, l.depth <= 1 as expanded, case when b.paper_id is not null then b.year else o.year end as year, b.title from level l left join best b using (paper_id) left join other o using (paper_id)"""
)
def crawl_records(spark: SparkSession, root: str) -> DataFrame:
    source = _source(spark, root)
    return C.discovered_records(C.crawl(source, _seeds(spark, root), keep_all, 0), source, keep_all)


@query(f"with {_SQL_OBS}, e as (select distinct citing_id, cited_id from obs) select a.citing_id as a, a.cited_id as b from e a join e b on a.citing_id = b.cited_id and a.cited_id = b.citing_id where a.citing_id < a.cited_id")
def mutual_citations(spark: SparkSession, root: str) -> DataFrame:
    return C.mutual(C.steps(_source(spark, root), keep_all).select("citing_id", "cited_id"))


@query(f"with {_SQL_OBS} select distinct citing_id from obs where citing_id = cited_id")
def self_loops(spark: SparkSession, root: str) -> DataFrame:
    return C.steps(_source(spark, root), keep_all).where("citing_id = cited_id").select("citing_id").distinct()


# ---- the stored graph

def _latest(spark: SparkSession, root: str) -> DataFrame:
    """The latest record of each paper, ids in lower case."""
    d = table(spark, root, "paper_detail").where("paper_id <> ''")
    cols = ["title", "year", "publication_date", "abstract", "external_ids", "authors", "fetched_at"]
    best = d.groupBy(F.lower("paper_id").alias("paper_id")).agg(F.max_by(F.struct(*cols), F.struct("fetched_at", "loaded_at", "title")).alias("r"))
    return best.select(
        "paper_id", "r.title", "r.year", F.col("r.publication_date").alias("pub_date_raw"), "r.abstract", F.col("r.external_ids.dblp").alias("dblp_key"), F.col("r.external_ids.doi").alias("doi_raw"), "r.authors", "r.fetched_at"
    )


def _batch(spark: SparkSession, root: str) -> DataFrame:
    return G.publication_batch(_latest(spark, root), F.struct("fetched_at", "paper_id"))


_ORDER = "new desc, fetched_at desc nulls last, pid desc nulls last"
_SQL_MERGE = f"""{_SQL_LATEST}, rows as (select 0 as new, null::timestamptz as fetched_at, null as pid, title_hash, title, year, doi, abstract, dblp_key, paper_id, pub_date as date from publication
 union all select 1, fetched_at, lower(paper_id), {_sql_hash()}, title, year, nullif({_sql_doi('external_ids.doi')}, ''), nullif(abstract, ''), nullif(external_ids.dblp, ''), lower(paper_id),
 {_SQL_DATE.format(c='publication_date')} from paper where title is not null),
 merged as (select title_hash, {', '.join(f"first({c} order by {_ORDER}, {c} desc nulls last) as {c}" for c in G.ALWAYS)},
 {', '.join(f"first({c} order by {_ORDER}, {c} desc) filter ({c} is not null) as {c}" for c in G.GUARDED)} from rows group by 1)"""


def _merged(spark: SparkSession, root: str) -> DataFrame:
    current = table(spark, root, "publication").withColumnRenamed("pub_date", "date")
    return G.merge_publications(current, _batch(spark, root))


@query(f"with {_SQL_MERGE} select * replace (cast(date as varchar) as date) from merged")
def publication_merge(spark: SparkSession, root: str) -> DataFrame:
    return _merged(spark, root).withColumn("date", F.col("date").cast("string"))


@query(f"select title_hash, count(*) as n_papers from (select distinct paper_id, {_sql_hash()} as title_hash from paper_detail where title is not null) group by 1 having count(*) > 1")
def publication_collisions(spark: SparkSession, root: str) -> DataFrame:
    return G.collisions(table(spark, root, "paper_detail", "paper_id", "title"))


_SQL_CITE = f"""{_SQL_LATEST}, h as (select lower(paper_id) as id, {_sql_hash()} as th from paper where title is not null), stored as (select distinct title_hash from publication),
 {_SQL_OBS}, cite as (select distinct a.th as src_title_hash, b.th as dst_title_hash from obs join h a on a.id = citing_id join h b on b.id = cited_id where a.th in (from stored) and b.th in (from stored))"""


def _observed_edges(spark: SparkSession, root: str) -> DataFrame:
    return C.steps(_source(spark, root), keep_all).select("citing_id", "cited_id").distinct()


def _cites(spark: SparkSession, root: str) -> DataFrame:
    stored = table(spark, root, "publication", "title_hash").distinct()
    return G.merge_cites(None, _observed_edges(spark, root), _batch(spark, root).select("paper_id", "title_hash"), stored)


@query(f"with {_SQL_CITE} select * from cite")
def cite_by_hash(spark: SparkSession, root: str) -> DataFrame:
    return _cites(spark, root)


@query(f"with {_SQL_CITE} select * from cite where src_title_hash = dst_title_hash")
def cite_self_loops(spark: SparkSession, root: str) -> DataFrame:
    return _cites(spark, root).where("src_title_hash = dst_title_hash")


@query(
    f"""with {_SQL_CITE}, allref as (select distinct lower(citing_id) as citing_id, lower(cited_id) as cited_id from citation_obs where endpoint = 'references' and citing_id <> '' and cited_id <> '')
 select r.* from allref r join paper p on lower(p.paper_id) = r.citing_id left join h a on a.id = r.citing_id left join h b on b.id = r.cited_id
 where not exists (from cite where src_title_hash = a.th and dst_title_hash = b.th)"""
)
def refs_skip_existing(spark: SparkSession, root: str) -> DataFrame:
    """References of all papers on record that the stored graph doesn't link yet; unfiltered, as the graph sink writes them."""
    refs = table(spark, root, "citation_obs", "endpoint", "citing_id", "cited_id").where("endpoint = 'references'").select(lower_id(F.col("citing_id")).alias("citing_id"), lower_id(F.col("cited_id")).alias("cited_id"))
    refs = refs.where("citing_id is not null and cited_id is not null")
    papers = _latest(spark, root).select("paper_id")
    return G.neighbours_to_write(papers, refs, _cites(spark, root), _batch(spark, root).select("paper_id", "title_hash"))


# ---- authors

_SQL_OBSERVED = f"""{_SQL_LATEST}, inline as (select lower(paper_id) as paper_id, unnest(authors) as a, generate_subscripts(authors, 1) - 1 as pos from paper),
 observed as (select paper_id, pos, a.author_id as author_id, a.name as name, a.homepage as homepage, a.external_ids.dblp as dblp from inline where a.author_id <> '')"""
_SQL_GRAPH = f"""{_SQL_OBSERVED}, hashes as (select lower(paper_id) as paper_id, {_sql_hash()} as title_hash from paper where title is not null),
 wrote as (select distinct element_id, title_hash from person p join (select paper_id, name from observed) o on regexp_replace(p.name, ' [0-9]{{4}}$', '') = o.name join hashes using (paper_id)),
 near as (select paper_id, element_id from hashes join wrote using (title_hash) union select o.paper_id, p.element_id from observed o join person p on p.author_id = o.author_id),
 cand as (select near.paper_id, p.* from near join person p using (element_id)),
 names as (select paper_id, name, arg_max(author_id, pos * 1000 + k) as author_id, max_by(struct_pack(h := homepage), pos * 1000 + k).h as homepage
 from (select paper_id, pos, author_id, homepage, unnest(dblp) as name, generate_subscripts(dblp, 1) as k from observed) where name <> '' group by 1, 2),
 ids as (select paper_id, author_id, max_by(struct_pack(h := homepage), pos).h as homepage from observed group by 1, 2),
 actions as (select c.paper_id, c.element_id, 'by_id' as action, c.author_id, nullif(i.homepage, '') as homepage from cand c join ids i using (paper_id, author_id)
 union all select c.paper_id, c.element_id, 'divide', n.author_id, null from cand c join names n using (paper_id, name) where c.author_id <> '' and not exists (from ids i where i.paper_id = c.paper_id and i.author_id = c.author_id)
 union all select c.paper_id, c.element_id, 'enrich', n.author_id, nullif(n.homepage, '') from cand c join names n using (paper_id, name) where coalesce(c.author_id, '') = '' and c.dblp_pid <> '')"""


def _observed(spark: SparkSession, root: str) -> DataFrame:
    rows = _latest(spark, root).select("paper_id", F.posexplode("authors").alias("pos", "a"))
    return rows.where("a.author_id <> ''").select("paper_id", "pos", "a.author_id", "a.name", "a.homepage", F.col("a.external_ids.dblp").alias("dblp_name"))


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Observed authors, papers' hashes, persons, and who wrote what: a person named like an author wrote the paper."""
    observed = cut(_observed(spark, root))
    hashes = cut(_batch(spark, root).select("paper_id", "title_hash"))
    person = table(spark, root, "person")
    bare = person.select("element_id", F.regexp_replace("name", " [0-9]{4}$", "").alias("name"))
    write = bare.join(observed.select("paper_id", "name"), "name").join(hashes, "paper_id").select("element_id", "title_hash").distinct()
    return observed, hashes, person, cut(write)


@query(f"with {_SQL_OBSERVED} select paper_id, pos, author_id, unnest(dblp) as name from observed")
def observed_dblp_names(spark: SparkSession, root: str) -> DataFrame:
    return _observed(spark, root).select("paper_id", "pos", "author_id", F.explode("dblp_name").alias("name"))


@query(f"with {_SQL_OBSERVED} select distinct paper_id, 'author_id' as key, author_id as value from observed")
def author_key_values(spark: SparkSession, root: str) -> DataFrame:
    return A.author_keys(_observed(spark, root))


@query(f"with {_SQL_OBSERVED} select distinct o.paper_id, p.element_id, p.dblp_pid from observed o join person p on p.author_id = o.author_id")
def persons_by_key(spark: SparkSession, root: str) -> DataFrame:
    return A.persons_by_key(table(spark, root, "person"), A.author_keys(_observed(spark, root))).select("paper_id", "element_id", "dblp_pid")


@query(f"with {_SQL_GRAPH} select * from wrote")
def persons_of_publications(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root)[3]


@query(f"with {_SQL_GRAPH} select paper_id, element_id, author_id, name from cand")
def correlated_persons(spark: SparkSession, root: str) -> DataFrame:
    observed, hashes, person, write = _stored(spark, root)
    return A.correlated_persons(hashes, observed, person, write).select("paper_id", "element_id", "author_id", "name")


def _actions(spark: SparkSession, root: str) -> tuple:
    observed, hashes, person, write = _stored(spark, root)
    return A.match_authors(observed, A.correlated_persons(hashes, observed, person, write)), hashes, person, write


def _matched(action: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return _actions(spark, root)[0].where(F.col("action") == action).select("paper_id", "element_id", "author_id", "homepage")

    run.__name__ = f"match_{action}"
    return query(f"with {_SQL_GRAPH} select paper_id, element_id, author_id, homepage from actions where action = '{action}'")(run)


match_by_id, match_divide, match_enrich = (_matched(a) for a in ("by_id", "divide", "enrich"))

_SQL_APPLY = f"""{_SQL_GRAPH}, act as (select * from actions join hashes using (paper_id)), owner as (select author_id, min(element_id) as owner_id from person where author_id <> '' group by 1),
 wrong as (select a.paper_id, a.element_id, a.author_id, a.title_hash, p.dblp_pid, p.name, p.homepage, coalesce(o.owner_id, 'new:' || a.author_id) as target from act a join person p using (element_id)
 left join owner o on o.author_id = a.author_id where action = 'divide'),
 patch as (select target as element_id, author_id as d_id, dblp_pid as d_pid, name as d_name, homepage as d_home from (select *, row_number() over (partition by target order by paper_id desc, element_id desc) as n from wrong) where n = 1),
 soft as (select element_id, arg_max(homepage, paper_id) filter (homepage is not null) as s_home, arg_max(author_id, paper_id) filter (action = 'enrich') as s_id from act where action <> 'divide' group by 1)"""


@query(
    f"""with {_SQL_APPLY} select coalesce(p.element_id, q.element_id) as element_id, coalesce(d_id, s_id, p.author_id) as author_id, coalesce(nullif(d_pid, ''), p.dblp_pid) as dblp_pid,
 coalesce(nullif(d_name, ''), p.name) as name, coalesce(s_home, nullif(d_home, ''), p.homepage) as homepage from person p full join patch q on p.element_id = q.element_id
 left join soft s on s.element_id = coalesce(p.element_id, q.element_id)"""
)
def person_after_link(spark: SparkSession, root: str) -> DataFrame:
    actions, hashes, person, write = _actions(spark, root)
    return A.apply_author_actions(person, write, cut(actions), hashes)[0]


@query(
    f"""with {_SQL_APPLY} select element_id, title_hash from wrote w where not exists (from wrong g where g.element_id = w.element_id and g.title_hash = w.title_hash)
 union select target, title_hash from wrong union select element_id, title_hash from act where action <> 'divide'"""
)
def write_after_divide(spark: SparkSession, root: str) -> DataFrame:
    actions, hashes, person, write = _actions(spark, root)
    return A.apply_author_actions(person, write, cut(actions), hashes)[1]


@query(
    f"""with {_SQL_LATEST}, {_SQL_USABLE}, marked as (select lower(paper_id) as paper_id, authors, authors is null or len(list_filter(authors, lambda x: x.author_id is null or x.external_ids is null)) > 0 as ask from paper)
 select paper_id, cast(pos as int) as pos, author_id, name from (select paper_id, generate_subscripts(authors, 1) - 1 as pos, unnest(authors).author_id as author_id, unnest(authors).name as name from marked where not ask) where author_id <> ''
 union all select m.paper_id, cast(i.pos as int), item->>'$.authorId', item->>'$.name' from marked m join items i on i.key_id = m.paper_id where ask and i.endpoint = 'authors' and item->>'$.authorId' <> ''"""
)
def author_fallback(spark: SparkSession, root: str) -> DataFrame:
    inline = F.transform("authors", lambda a: F.struct(a["author_id"].alias("author_id"), a["name"].alias("name"), a["homepage"].alias("homepage"), a["external_ids"]["dblp"].alias("dblp_name"), a["external_ids"].isNotNull().alias("has_ext")))
    papers = _latest(spark, root).select("paper_id", inline.alias("authors"))
    return A.authors_of(papers, D.paper_author(table(spark, root, "raw_doc"))).select("paper_id", "pos", "author_id", "name")


@query(
    f"""with {_SQL_LATEST} select lower(paper_id) as paper_id, nullif(external_ids.dblp, '') as dblp_key, nullif(title, '') as title, nullif({_sql_hash()}, '') as title_hash, nullif(year, 0) as year,
 nullif(publication_date, '') as date, nullif({_sql_doi('external_ids.doi')}, '') as doi from paper"""
)
def paper_node_projection(spark: SparkSession, root: str) -> DataFrame:
    """The JSON sink's nodes, read back from their JSON."""
    nodes = paper_nodes(_latest(spark, root), _observed(spark, root))
    back = F.from_json("node", "dblp_key string, title string, title_hash string, year int, date string, doi string")
    return nodes.select("paper_id", back.alias("n")).select("paper_id", "n.*")
