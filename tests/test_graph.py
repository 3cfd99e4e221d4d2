import json

from pyspark.sql import functions as F

from paperweave.operators import authors as A
from paperweave.operators import graphstore as G
from paperweave.sinks.graph_json import json_document, paper_nodes, write_json_graph, write_tables
from tests.conftest import rows

PAPER = "paper_id string, title string, year int, pub_date_raw string, abstract string, dblp_key string, doi_raw string, seq int"
PAPERS = [
    ("p1", "A Title", 2001, "2001-02-03", "x", "k1", "https://doi.org/10.1/a", 1), ("p2", "a title!", None, "bad", "", None, None, 2),
    ("p3", "Привет", 2005, None, None, None, "", 3), ("p4", "…", None, None, None, None, None, 4), ("p5", None, 2000, None, None, None, None, 5),
]


def batch(spark, papers=PAPERS):
    return G.publication_batch(spark.createDataFrame(papers, PAPER), F.col("seq"))


def test_merge_rules(spark):
    m = {r.title_hash: r for r in G.merge_publications(None, batch(spark)).collect()}
    assert set(m) == {"atitle", ""}  # a null title has no hash, titles without letters share the empty one
    t = m["atitle"]
    assert (t.title, t.year) == ("a title!", None)  # always overwritten, by null too
    assert (t.doi, t.abstract, t.dblp_key, t.paper_id, str(t.date)) == ("10.1/a", "x", "k1", "p2", "2001-02-03")
    kept = {r.title_hash: r for r in G.merge_publications(None, batch(spark), preserve_nulls=True).collect()}
    assert kept["atitle"].year == 2001


def test_merge_is_idempotent_and_empty(spark):
    one = G.merge_publications(None, batch(spark))
    two = G.merge_publications(one, batch(spark))
    assert rows(one) == rows(two)
    assert rows(G.merge_publications(one, batch(spark).limit(0))) == rows(one)
    assert rows(G.collisions(spark.createDataFrame(PAPERS, PAPER))) == [("", 2), ("atitle", 2)]


def test_cites(spark):
    hashes = batch(spark).select("paper_id", "title_hash")
    pubs = G.merge_publications(None, batch(spark))
    edges = spark.createDataFrame([("p1", "p3"), ("p1", "p2"), ("p2", "p3"), ("p5", "p1"), ("p9", "p1"), ("p1", "p3")], "citing_id string, cited_id string")
    cite = G.merge_cites(None, edges, hashes, pubs)
    assert rows(cite) == [("atitle", ""), ("atitle", "atitle")]
    assert rows(G.merge_cites(cite, edges, hashes, pubs)) == rows(cite)
    assert G.merge_cites(None, edges, hashes, pubs.limit(0)).count() == 0
    left = G.neighbours_to_write(hashes.select("paper_id"), edges, cite.where("dst_title_hash = ''"), hashes)
    assert rows(left) == [("p1", "p2")]
    assert G.neighbours_to_write(hashes.select("paper_id"), edges, cite, hashes, skip_existing=False).count() == 3
    assert ("p3", "p1") in rows(G.reverse_edges(edges))


OBSERVED = "paper_id string, pos int, author_id string, name string, homepage string, dblp_name array<string>"


def test_author_fallback(spark):
    kind = "paper_id string, authors array<struct<author_id string, name string, homepage string, dblp_name array<string>, has_ext boolean>>"
    papers = spark.createDataFrame(
        [("whole", [("a1", "A", None, ["A 1"], True)]), ("mixed", [("a1", "A", None, None, True), ("a2", "B", None, None, False)]), ("none", []), ("null", None), ("noid", [(None, "B", None, None, True)])], kind
    )
    endpoint = spark.createDataFrame([(p, 0, f"e-{p}", "E", None, ["E"]) for p in ("whole", "mixed", "none", "null")], OBSERVED)
    got = A.authors_of(papers, endpoint)
    assert sorted((r.paper_id, r.author_id) for r in got.collect()) == [("mixed", "e-mixed"), ("null", "e-null"), ("whole", "a1")]
    assert [r.paper_id for r in A.authors_of(papers).collect()] == ["whole"]


def test_match_and_apply(spark):
    observed = spark.createDataFrame(
        [("p", 0, "a1", "Ann", "h1", ["Ann 0001"]), ("p", 1, "a2", "Bob", "", ["Bob", "Same"]), ("p", 2, "a3", "Cyd", "h3", ["Cyd", "Same"]), ("q", 0, "a1", "Ann", None, None)], OBSERVED
    )
    person = spark.createDataFrame(
        [("n1", "a1", "pid1", "Ann 0001", None), ("n2", "stale", "pid2", "Bob", "hs"), ("n3", None, "pid3", "Cyd", ""), ("n4", "", None, "Same", None), ("n5", "other", None, "Nobody", None)],
        "element_id string, author_id string, dblp_pid string, name string, homepage string",
    )
    papers = spark.createDataFrame([("p", "hp"), ("q", "hq")], "paper_id string, title_hash string")
    write = spark.createDataFrame([("n2", "hp"), ("n3", "hp"), ("n4", "hp"), ("n5", "hp")], "element_id string, title_hash string")
    cand = A.correlated_persons(papers, observed, person, write)
    assert sorted((r.paper_id, r.element_id) for r in cand.collect()) == [("p", "n1"), ("p", "n2"), ("p", "n3"), ("p", "n4"), ("p", "n5"), ("q", "n1")]
    acts = A.match_authors(observed, cand)
    assert sorted((r.paper_id, r.element_id, r.action, r.author_id, r.homepage) for r in acts.collect()) == [
        ("p", "n1", "by_id", "a1", "h1"), ("p", "n2", "divide", "a2", None), ("p", "n3", "enrich", "a3", "h3"), ("q", "n1", "by_id", "a1", None)
    ]
    assert {r.name: r.author_id for r in A.observed_names(observed).collect()}["Same"] == "a3"  # the last one holds
    people, wrote = A.apply_author_actions(person, write, acts, papers)
    p = {r.element_id: r for r in people.collect()}
    assert p["n1"].homepage == "h1" and p["n3"].author_id == "a3" and p["n2"].author_id == "stale"
    assert tuple(p["new:a2"]) == ("new:a2", "a2", "pid2", "Bob", "hs")  # the stale person's properties win
    assert set(map(tuple, wrote.collect())) == {("new:a2", "hp"), ("n1", "hp"), ("n1", "hq"), ("n3", "hp"), ("n4", "hp"), ("n5", "hp")}
    again = A.apply_author_actions(person, wrote, acts, papers)[1]
    assert set(map(tuple, again.collect())) == set(map(tuple, wrote.collect()))
    assert A.match_authors(observed.limit(0), cand).count() == 0 and A.match_authors(observed, cand.limit(0)).count() == 0


def test_json_sink(spark, tmp_path):
    papers = spark.createDataFrame([('p"1', "T…", 0, None, "", "k", "doi:10.1/x", 1), ("p2", None, 2001, "2001", None, None, None, 2)], PAPER)
    observed = spark.createDataFrame([('p"1', 1, "a2", "B", None, []), ('p"1', 0, "a1", "", None, ["N"])], OBSERVED)
    edges = spark.createDataFrame([('p"1', "p2"), ("p2", "p2")], "citing_id string, cited_id string")
    nodes = paper_nodes(papers, observed)
    doc = json.loads(json_document(nodes, edges).first()[0])
    assert doc["edges"] == [['p"1', "p2"], ["p2", "p2"]]
    assert doc["nodes"]['p"1'] == {"paperId": 'p"1', "dblp_key": "k", "title": "T…", "title_hash": "t", "doi": "10.1/x", "authors": [{"authorId": "a1", "dblp_name": ["N"]}, {"authorId": "a2", "name": "B"}]}
    assert doc["nodes"]["p2"] == {"paperId": "p2", "year": 2001, "date": "2001", "authors": []}
    assert json.loads(json_document(nodes.limit(0), edges.limit(0)).first()[0]) == {"nodes": {}, "edges": []}
    write_json_graph(nodes, edges, str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0]) == doc
    write_tables(nodes, edges, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "edges")).count() == 2
    assert A.author_json is not None and spark.range(1).select(F.to_json(A.author_json(F.lit("a"), F.lit(""), F.lit(None).cast("string")))).first()[0] == '{"authorId":"a"}'


def test_property_graph_by_levels(spark, tmp_path):
    from paperweave.sinks.property_graph import PropertyGraph

    papers = spark.createDataFrame([(f"p{i}", f"title {i}", 2000 + i, None, None, None, None, 0) for i in range(5)], PAPER).drop("seq")
    refs = spark.createDataFrame([("p0", "p1"), ("p0", "p4"), ("p1", "p2"), ("p1", "gone")], "citing_id string, cited_id string")
    observed = spark.createDataFrame([("p0", 0, "a0", "Ann", "h", ["Ann"]), ("p1", 0, "a1", "Bob", None, ["Bob"])], OBSERVED)
    g = PropertyGraph(spark, str(tmp_path / "g"), papers, refs, observed)
    g._put("person", spark.createDataFrame([("n0", "a0", None, "Ann", None)], "element_id string, author_id string, dblp_pid string, name string, homepage string"))
    levels = [(0, ["p0"], [("p0", "p1")]), (1, ["p1"], [("p1", "p2"), ("p3", "p1")])]

    def write():
        for k, ids, e in levels:
            g.write_level(k, spark.createDataFrame([(i,) for i in ids], "paper_id string"), spark.createDataFrame([(*x, k) for x in e], "citing_id string, cited_id string, level int"))
        return {n: rows(g.table(n)) for n in ("publication", "person", "cite", "write")}

    once = write()
    assert [r[0] for r in once["publication"]] == [f"title{i}" for i in range(5)]
    assert once["cite"] == [("title0", "title1"), ("title0", "title4"), ("title1", "title2"), ("title3", "title1")]
    assert once["person"] == [("n0", "a0", None, "Ann", "h")] and once["write"] == [("n0", "title0")]
    assert write() == once
    back = PropertyGraph(spark, str(tmp_path / "r"), papers, reverse=True)
    back.write_level(0, papers.select("paper_id"), refs)
    assert ("title1", "title0") in rows(back.table("cite"))


def test_nodes_merge(spark):
    from paperweave.sinks.graph_json import merge_nodes

    old = spark.createDataFrame([("a", '{"x":1,"l":[{"y":"z"}],"t":"old"}'), ("b", '{"x":2}'), ("c", "broken")], "paper_id string, node string")
    new = spark.createDataFrame([("a", '{"t":"new","n":null}'), ("c", '{"x":3}'), ("d", None)], "paper_id string, node string")
    got = {r.paper_id: json.loads(r.node) for r in merge_nodes(old, new).collect()}
    assert got == {"a": {"x": 1, "l": [{"y": "z"}], "t": "new", "n": None}, "b": {"x": 2}, "c": {"x": 3}, "d": {}}
