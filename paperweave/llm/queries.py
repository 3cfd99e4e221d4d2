"""Queries of the operators in this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .canonical import copies, copy_groups
from .match import match
from .mix import mix
from .names import link_names, name_pairs
from .split import LIMIT, OVERLAP, oversized, split_texts
from .tokens import decoded, round_trip, token_counts, token_ids


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return copies(table(spark, root, "paper_feed", "record_id", "body"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return copy_groups(table(spark, root, "paper_feed", "record_id", "body"))


def _p3(spark: SparkSession, root: str) -> DataFrame:
    detail = table(spark, root, "paper_detail", "paper_id", "title", "year", "external_ids", "fetched_at")
    return match(detail, table(spark, root, "publication", "element_id", "title", "year", "doi", "dblp_key"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _p3(spark, root).select("paper_id", "element_id")


def p3_matches(spark: SparkSession, root: str) -> DataFrame:
    return _p3(spark, root)


def p4_entities(spark: SparkSession, root: str) -> DataFrame:
    profiles = table(spark, root, "author_profile", "author_id", "name", "homepage", "affiliations", "dblp_name")
    return link_names(profiles, table(spark, root, "given_name_form"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return name_pairs(p4_entities(spark, root))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return token_ids(table(spark, root, "documents", "doc_id", "text"))


def p7_round_trip(spark: SparkSession, root: str) -> DataFrame:
    return round_trip(table(spark, root, "documents", "doc_id", "text"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    return mix(table(spark, root, "documents", "doc_id", "source", "text"), table(spark, root, "mix_target")).uses


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix(table(spark, root, "documents", "doc_id", "source", "text"), table(spark, root, "mix_target")).report


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return oversized(table(spark, root, "documents", "doc_id", "text"))


def p9_pieces(spark: SparkSession, root: str) -> DataFrame:
    return split_texts(table(spark, root, "documents", "doc_id", "text"))


def p4_ids(spark: SparkSession, root: str) -> DataFrame:
    """Every id of ``p4_entities``, and whether its entity is one of the ids."""
    linked = p4_entities(spark, root)
    ids = linked.select(F.col("author_id").alias("entity")).distinct().withColumn("there", F.lit(True))
    return linked.join(ids, "entity", "left").select("author_id", F.coalesce("there", F.lit(False)).alias("entity_is_id"))


def p7_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The hash of the text that each document's ids decode to."""
    return decoded(p7_ids(spark, root)).select("doc_id", F.md5("text").alias("text_md5"))


def p8_sources(spark: SparkSession, root: str) -> DataFrame:
    """Per target its documents, and whether no document was used too often."""
    return p8_shares(spark, root).select("source", F.col("n_docs").cast("bigint").alias("n_docs"), (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"))


def p9_within(spark: SparkSession, root: str) -> DataFrame:
    """Per text whether its pieces, encoded anew, keep to the limit, follow one another and overlap as they should."""
    p = p9_pieces(spark, root)
    again = token_counts(p, "doc_id", "piece", ("piece_no", "n_pieces", "start_token"))
    both = again.join(p.select("doc_id", "piece_no", F.col("n_tokens").alias("n_own")), ["doc_id", "piece_no"])
    before = Window.partitionBy("doc_id").orderBy("piece_no")
    overlap = F.lag(F.col("start_token") + F.col("n_own")).over(before) - F.col("start_token")
    ok = (F.col("n_tokens") <= LIMIT) & (F.col("n_own") <= LIMIT) & F.when(F.col("piece_no") == 0, F.col("start_token") == 0).otherwise(overlap.between(OVERLAP, OVERLAP + 3))
    return both.withColumn("ok", ok).groupBy("doc_id").agg(F.min("ok").alias("within"), (F.count(F.lit(1)) == F.max("n_pieces")).alias("complete"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_matches, p4_found, p4_entities, p4_ids, p7_ids, p7_round_trip, p7_decoded, p8_mix, p8_shares, p8_sources, p9_found, p9_pieces, p9_within)}


_LETTERS = "regexp_replace(lower(nfc_normalize({})), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"
_FIELDS = ["array_to_string(from_json(json_extract(body, '$.authors'), '[\"varchar\"]'), '')", *(f"json_extract_string(body, '$.{f}')" for f in ("title", "year", "venue", "pages", "doi"))]
_SQL_SAME = f"""same as (select record_id, body, [{', '.join("coalesce(" + _LETTERS.format(f) + ", '')" for f in _FIELDS)}] as canon from paper_feed where json_valid(body))"""


def oracle_sql() -> dict[str, str]:
    """SQL of the record collapse, and of what must hold for other results; these can't be expressed in it and are tested in
    tests/llm."""
    return {
        "p4_ids": "select author_id, true as entity_is_id from author_profile where author_id is not null",
        "p7_decoded": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
        "p8_sources": "select t.source, count(d.doc_id) as n_docs, true as within_repeats from mix_target t left join documents d on d.source = t.source and d.text is not null group by 1",
        "p9_within": "select doc_id, true as within, true as complete from documents where text is not null",
        "p2_found": f"with {_SQL_SAME} select keep_id, record_id as copy_id from (select record_id, min(record_id) over (partition by canon) as keep_id from same) where record_id > keep_id",
        "p2_groups": f"with {_SQL_SAME} select min(record_id) as keep_id, count(*) as n_copies, cast(1 as bigint) as n_texts from same group by canon",
    }
