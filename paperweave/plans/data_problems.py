"""Queries p1, p5, p6: the general problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache_documents import document_children, flat_authors, flat_papers
from ..operators.compact import consolidate
from ..operators.skew import count_per_key, skew_join, spread_group
from ..sources.tables import table

#: Papers with at least this share of all observations are heavy (TESTDATA.md).
HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return document_children(table(spark, root, "raw_doc", "raw_id", "endpoint", "body"))


def p1_papers(spark: SparkSession, root: str) -> DataFrame:
    return flat_papers(table(spark, root, "raw_doc", "raw_id", "endpoint", "body"))


def p1_authors(spark: SparkSession, root: str) -> DataFrame:
    return flat_authors(table(spark, root, "raw_doc", "raw_id", "endpoint", "body"))


def paper_key(column: str):
    """A paper id as it is compared: lower case, null for an empty one."""
    return F.nullif(F.lower(column), F.lit(""))


def _counted(spark: SparkSession, root: str) -> DataFrame:
    """``side``, ``paper_id``, ``n_rows``, ``heavy``; both sides in one go, so a heavy paper has half the share of all ends."""
    obs = table(spark, root, "citation_obs", "citing_id", "cited_id")
    end = F.explode(F.array(*(F.concat(F.lit(f"{s}:"), paper_key(f"{s}_id")) for s in ("cited", "citing"))))
    per = count_per_key(obs.select(end.alias("end")), "end", HEAVY_SHARE / 2)
    return per.select(F.substring_index("end", ":", 1).alias("side"), F.expr("substring(end, instr(end, ':') + 1)").alias("paper_id"), "n_rows", "heavy")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _counted(spark, root).where("heavy").select("side", "paper_id")


def p5_rows_per_paper(spark: SparkSession, root: str) -> DataFrame:
    """Per side and paper the number of its observations, and whether it is heavy."""
    return _counted(spark, root)


def p5_paper_stats(spark: SparkSession, root: str) -> DataFrame:
    """Per side and paper: observations, distinct papers on the other side, first and last fetch."""
    out = []
    for side, other in (("cited", "citing"), ("citing", "cited")):
        obs = table(spark, root, "citation_obs", "citing_id", "cited_id", "fetched_at").select(paper_key(f"{side}_id").alias("paper_id"), paper_key(f"{other}_id").alias("other_id"), "fetched_at")
        more = [(F.min("fetched_at").alias("_f"), F.min("_f").alias("first_at")), (F.max("fetched_at").alias("_l"), F.max("_l").alias("last_at"))]
        out.append(spread_group(obs, "paper_id", "other_id", more).select(F.lit(side).alias("side"), "paper_id", "n_rows", F.col("n_distinct").alias("n_others"), "first_at", "last_at"))
    return out[0].unionByName(out[1])


def p5_cited_years(spark: SparkSession, root: str) -> DataFrame:
    """Per cited paper that has a record: the years between it and its observed citing papers.

    Every observation meets the record of its cited paper by ``skew_join``; the observations of a heavy paper are joined
    where they are, without a shuffle.
    """
    obs = table(spark, root, "citation_obs", "endpoint", "cited_id", "neighbour_year").where("endpoint = 'citations'").select(paper_key("cited_id").alias("paper_id"), "neighbour_year")
    record = table(spark, root, "paper_detail", "paper_id", "year").groupBy(F.lower("paper_id").alias("paper_id")).agg(F.max("year").alias("year"))
    gap = skew_join(obs.where(F.col("paper_id").isNotNull()), record, "paper_id", "inner", unique=True)
    lag = F.col("neighbour_year") - F.col("year")
    return gap.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(lag).alias("n_dated"), F.min(lag).alias("least_lag"), F.max(lag).alias("most_lag"), F.sum(lag.cast("bigint")).alias("sum_lag")
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The rows that aren't in the set that ``consolidate`` wrote."""
    return consolidate(table(spark, root, "raw_doc", "raw_id", "endpoint", "key_id", "body")).left_out.select("raw_id")


def p6_files(spark: SparkSession, root: str) -> DataFrame:
    """Consolidates ``raw_doc`` into the shared folder and accounts for it, one row per endpoint of what was written."""
    done = consolidate(table(spark, root, "raw_doc"))
    return spark.read.parquet(done.path).groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("body").cast("bigint")).alias("body_bytes"), F.countDistinct(F.lower("key_id")).alias("n_keys")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_papers, p1_authors, p5_found, p5_rows_per_paper, p5_paper_stats, p5_cited_years, p6_found, p6_files)}


_SIDE = """select '{s}' as side, lower({s}_id) as paper_id from citation_obs where {s}_id <> '' group by 2
 having count(*) >= 0.02 * (select count(*) from citation_obs)"""
_COUNTS = """select '{s}' as side, lower({s}_id) as paper_id, count(*) as n_rows, count(*) >= 0.02 * (select count(*) from citation_obs) as heavy
 from citation_obs where {s}_id <> '' group by 2"""
_STATS = """select '{s}' as side, lower({s}_id) as paper_id, count(*) as n_rows, count(distinct nullif(lower({o}_id), '')) as n_others,
 min(fetched_at) as first_at, max(fetched_at) as last_at from citation_obs where {s}_id <> '' group by 2"""
_DOC = "partition by coalesce(endpoint, ''), lower(key_id), body order by raw_id"


def _unnested(source: str, value: str, keep: str) -> str:
    """Items of a JSON list with their places; what isn't a list has none."""
    arr = f"from_json(case when json_type({value}) = 'ARRAY' then {value} else '[]' end, '[\"json\"]')"
    return f"(select {keep}, unnest({arr}) as item, cast(generate_subscripts({arr}, 1) - 1 as int) as pos from {source})"


_FLAT = f"""ok as (select raw_id, endpoint, cast(case when json_valid(body) then body end as json) as j from raw_doc), obj as (select * from ok where json_type(j) = 'OBJECT'),
 listed as {_unnested("obj", "json_extract(j, '$.data')", "raw_id, endpoint")},
 paper as (select * from (select raw_id, endpoint, 'paper' as kind, -1 as data_pos, j as p from obj where endpoint = 'paper'
 union all select raw_id, endpoint, 'cited', pos, json_extract(item, '$.citedPaper') from listed where endpoint = 'references'
 union all select raw_id, endpoint, 'citing', pos, json_extract(item, '$.citingPaper') from listed where endpoint = 'citations'
 union all select raw_id, endpoint, 'authored', pos, item from listed where endpoint = 'author_papers') where p->>'$.paperId' <> ''),
 inside as {_unnested("paper", "json_extract(p, '$.authors')", "raw_id, endpoint, kind, data_pos")},
 author as (select * from (select raw_id, endpoint, data_pos, pos as author_pos, item as a from inside where kind <> 'authored' union all select raw_id, endpoint, -1, pos, item from listed where endpoint = 'authors') where a->>'$.authorId' <> ''),
 ext as (select raw_id, data_pos, p, unnest(json_keys(p, '$.externalIds')) as k from paper where kind <> 'authored' and json_type(p, '$.externalIds') = 'OBJECT'),
 named as {_unnested("author", "json_extract(a, '$.externalIds.DBLP')", "raw_id, data_pos, author_pos")},
 names as (select raw_id, data_pos, author_pos, pos as name_pos, item->>'$' as name from named
 union all select raw_id, data_pos, author_pos, 0, a->>'$.externalIds.DBLP' from author where json_type(a, '$.externalIds.DBLP') = 'VARCHAR')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with {_FLAT} select raw_id, kind as child_kind, data_pos, -1 as author_pos, -1 as name_pos, p->>'$.paperId' as child_value from paper where kind <> 'paper'
 union all select * from (select raw_id, 'external', data_pos, -1, -1, k || ':' || (p->>('$.externalIds."' || k || '"')) as v from ext) where v not like '%:'
 union all select raw_id, 'author', data_pos, author_pos, -1, a->>'$.authorId' from author
 union all select raw_id, 'dblp_name', data_pos, author_pos, name_pos, name from names where name <> ''""",
        "p1_papers": f"""with {_FLAT} select raw_id, endpoint, kind, data_pos, p->>'$.paperId' as paper_id, p->>'$.title' as title, try_cast(p->>'$.year' as int) as year, p->>'$.publicationDate' as publication_date from paper""",
        "p1_authors": f"""with {_FLAT} select raw_id, endpoint, data_pos, author_pos, a->>'$.authorId' as author_id, a->>'$.name' as name, a->>'$.homepage' as homepage from author""",
        "p5_found": " union all ".join(_SIDE.format(s=s) for s in ("cited", "citing")),
        "p5_paper_stats": " union all ".join(_STATS.format(s=s, o=o) for s, o in (("cited", "citing"), ("citing", "cited"))),
        "p5_cited_years": """select o.paper_id, count(*) as n_rows, count(g) as n_dated, min(g) as least_lag, max(g) as most_lag, cast(sum(g) as bigint) as sum_lag
 from (select lower(cited_id) as paper_id, neighbour_year - r.year as g from citation_obs c
 join (select lower(paper_id) as id, max(year) as year from paper_detail group by 1) r on lower(c.cited_id) = r.id
 where endpoint = 'citations' and cited_id <> '') o group by 1""",
        "p6_found": f"select raw_id from (select raw_id, row_number() over ({_DOC}) as n from raw_doc where body is not null) where n > 1",
        "p6_files": f"""select endpoint, count(*) as n_docs, cast(sum(octet_length(encode(body))) as bigint) as body_bytes, count(distinct lower(key_id)) as n_keys
 from (select *, row_number() over ({_DOC}) as n from raw_doc) where n = 1 or body is null group by 1""",
    }
