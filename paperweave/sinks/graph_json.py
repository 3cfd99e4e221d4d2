"""The crawl's result as nodes and edges: tables for any size, one JSON document for small graphs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import doi_norm, falsy, title_hash


def paper_nodes(papers: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """``paper_id``, ``node``: the JSON of each paper. Null, empty and zero fields are left out; authors are always there.

    ``papers``: paper_id, title, year, pub_date_raw, abstract, dblp_key, doi_raw; ``observed``: see ``authors_of``.
    Authors come in their order; the number of authors of one paper bounds the list.
    """
    empty = F.array().cast("array<struct<authorId:string,name:string,dblp_name:array<string>>>")
    out = papers
    if observed is not None:
        names = F.when(F.size("dblp_name") > 0, F.col("dblp_name"))
        one = F.struct("pos", F.struct(F.col("author_id").alias("authorId"), falsy(F.col("name")).alias("name"), names.alias("dblp_name")).alias("a"))
        lists = observed.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["a"]).alias("author_list"))
        out = papers.join(lists, "paper_id", "left")
    else:
        out = papers.withColumn("author_list", empty)
    node = F.struct(
        falsy(F.col("paper_id")).alias("paperId"), falsy(F.col("dblp_key")).alias("dblp_key"), falsy(F.col("title")).alias("title"), falsy(title_hash(F.col("title"))).alias("title_hash"),
        falsy(F.col("year"), "int").alias("year"), falsy(F.col("pub_date_raw")).alias("date"), falsy(doi_norm(F.col("doi_raw"))).alias("doi"), falsy(F.col("abstract")).alias("abstract"),
        F.coalesce("author_list", empty).alias("authors"),
    )
    return out.select("paper_id", F.to_json(node).alias("node"))


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``paper_id``, ``node``: nodes of both, a node of both with all fields of either; where both have one, the new one's.

    One row per paper on each side. A node that isn't a JSON object counts as empty.
    """
    kind = "map<string,variant>"
    fields = lambda c: F.coalesce(F.from_json(c, kind), F.from_json(F.lit("{}"), kind))
    both = old.select("paper_id", F.col("node").alias("_o")).join(new.select("paper_id", F.col("node").alias("_n")), "paper_id", "full")
    return both.select("paper_id", F.to_json(F.map_zip_with(fields("_o"), fields("_n"), lambda k, a, b: F.coalesce(b, a))).alias("node"))


def json_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the whole graph as ``{"nodes": {id: paper}, "edges": [[citing, cited]]}``, in the order of ids.

    For graphs that fit one task; larger ones are written by ``write_tables``.
    """
    none = F.lit(None)
    both = nodes.select(F.struct(F.col("paper_id").alias("k"), F.col("node").alias("v")).alias("n"), none.cast("array<string>").alias("e")).unionByName(
        edges.select(none.cast("struct<k:string,v:string>").alias("n"), F.array("citing_id", "cited_id").alias("e"))
    )
    lists = both.agg(F.sort_array(F.collect_list("n")).alias("n"), F.sort_array(F.collect_list("e")).alias("e"))
    item = lambda x: F.concat(F.to_json(F.array(x["k"])).substr(F.lit(2), F.length(F.to_json(F.array(x["k"]))) - 2), F.lit(": "), x["v"])
    body = F.concat(F.lit('{"nodes": {'), F.array_join(F.transform("n", item), ", "), F.lit('}, "edges": '), F.to_json("e"), F.lit("}"))
    return lists.select(body.alias("document"))


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part``, ``a``, ``b``, ``line``: the same document as lines that stand one after another in the order of the other columns.

    Nodes and edges are lines of their own, so no task holds the graph; each but the first of its part begins with a comma.
    """
    first = nodes.agg(F.min("paper_id")).first()[0], edges.agg(F.min(F.struct("citing_id", "cited_id"))).first()[0] or (None, None)
    one = F.to_json(F.array("paper_id"))
    n = nodes.select(F.lit(1).alias("part"), F.col("paper_id").alias("a"), F.lit("").alias("b"), F.concat(one.substr(F.lit(2), F.length(one) - 2), F.lit(": "), F.col("node")).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.col("citing_id").alias("a"), F.col("cited_id").alias("b"), F.to_json(F.array("citing_id", "cited_id")).alias("line"))
    leads = ((F.col("part") == 1) & (F.col("a") == F.lit(first[0]))) | ((F.col("part") == 3) & (F.col("a") == F.lit(first[1][0])) & (F.col("b") == F.lit(first[1][1])))
    rest = n.unionByName(e).select("part", "a", "b", F.when(leads, F.col("line")).otherwise(F.concat(F.lit(", "), F.col("line"))).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, "", "", '{"nodes": {'), (2, "", "", '}, "edges": ['), (4, "", "", "]}")], "part int, a string, b string, line string")
    return rest.unionByName(frame)


def write_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two Parquet tables below ``path``."""
    nodes.write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    edges.write.mode("overwrite").parquet(os.path.join(path, "edges"))


def write_json_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The document as text files below ``path``, one document when they are read in the order of their names."""
    json_lines(nodes, edges.select("citing_id", "cited_id").distinct()).orderBy("part", "a", "b").select("line").write.mode("overwrite").option("lineSep", " ").text(path)
