import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from paperweave import options
from paperweave.sources import documents as D
from paperweave.sources import rest
from paperweave.sources import seeds as S
from paperweave.sources.cache_tree import append_documents, read_cache_tree, with_cache_path
from paperweave.streaming.ingest import arrivals, ingest, newest, read_documents
from tests.conftest import rows

BODIES = [
    ("references", "A", '{"data":[{"citedPaper":{"paperId":"B","title":"T","year":2010}}]}'), ("references", "m", '{"message":"nope"}'), ("references", "n", '{"data":null}'),
    ("references", "nn", '{"data":[{"citedPaper":null}]}'), ("references", "ni", '{"data":[{"citedPaper":{"paperId":null}}]}'), ("references", "bad", "{bad"), ("references", "arr", "[]"), ("references", "nul", None),
    ("citations", "C", '{"data":[{"citingPaper":{"paperId":"D","year":2011}},{"citingPaper":{"paperId":""}}]}'),
    ("paper", "x", '{"paperId":"y"}'), ("paper", "P", '{"paperId":"p","externalIds":null,"year":1999,"authors":[]}'), ("paper", None, '{"paperId":"q"}'),
    ("authors", "p", '{"data":[{"authorId":"1","name":"N","externalIds":{"DBLP":["N 1",""]}},{"authorId":null},{"authorId":"2","externalIds":{"DBLP":"lone"}},{"authorId":"3","externalIds":{}}]}'),
    ("author_papers", "1", '{"data":[{"paperId":"P"},{"paperId":null},{"paperId":"P"},{"paperId":"Z"}]}'),
]


def raw(spark, bodies=BODIES, day=1):
    rows_ = [(i, e, k, f"s/{k}.json", 1, b, "extra") for i, (e, k, b) in enumerate(bodies)]
    df = spark.createDataFrame(rows_, "raw_id bigint, endpoint string, key_id string, path string, n_bytes int, body string, doc string")
    at = F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    return df.select("raw_id", "endpoint", "key_id", "path", "n_bytes", at.alias("fetched_at"), at.alias("loaded_at"), "body")


def test_endpoint_tables(spark):
    r = raw(spark)
    assert rows(D.reference_obs(r).select("citing_id", "cited_id", "year")) == [("a", "b", 2010)]
    assert rows(D.citation_obs(r).select("citing_id", "cited_id", "year")) == [("d", "c", 2011)]
    assert [(x.paper_id, x.year, x.dblp_key, x.doi_raw) for x in D.paper_detail(r).collect()] == [("p", 1999, None, None)]
    assert rows(D.paper_author(r).select("author_id", "name", "dblp_name")) == [("1", "N", ["N 1"]), ("2", None, ["lone"]), ("3", None, [])]
    assert rows(D.author_paper(r)) == [("1", "p"), ("1", "z")] and rows(D.author_paper(r, page_cap=1)) == [("1", "p")]
    assert D.usable(r, "references").count() == 4
    for f in (D.paper_detail, D.reference_obs, D.citation_obs, D.paper_author, D.author_paper):
        assert f(r.limit(0)).count() == 0


def test_latest_and_ttl(spark):
    two = raw(spark, [("citations", "k", '{"data":[]}')], 1).unionByName(raw(spark, [("citations", "K", '{"data":[{"citingPaper":{"paperId":"n"}}]}')], 3))
    assert D.citation_obs(two).count() == 1
    now = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp")
    assert D.citation_obs(two, now("05")).count() == 1 and D.citation_obs(two, now("20")).count() == 0
    assert D.citation_obs(two.withColumn("endpoint", F.lit("citations")), now("20")).count() == 0


def test_cache_tree(spark, tmp_path):
    place = tmp_path / "save" / "references--title-year"
    (place / "doi").mkdir(parents=True)
    (place / "abc.json").write_text('{"data":[]}\n{"x":1}')
    (place / "doi" / "10.1.json").write_text("é")
    (place / "note.txt").write_text("no")
    got = read_cache_tree(spark, str(tmp_path))
    assert rows(got.select("endpoint", "key_id", "body")) == [("references", "abc", '{"data":[]}\n{"x":1}'), ("references", "doi:10.1", "é")]
    append_documents(got, str(tmp_path / "table"))
    append_documents(got, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4
    assert with_cache_path(got, {"references": "title,year"}).where("key_id = 'abc'").first().path == "references--title-year/abc.json"


def test_seeds(spark):
    pubs = spark.createDataFrame(
        [("zgraph", "x1", None, 2001), ("graph", None, "https://doi.org/10.1/A", 2001), ("graph", None, None, 2001), ("graph", "", "", None), ("other", "x2", None, 1990)], "title_hash string, paper_id string, doi string, year int"
    )
    assert rows(S.seed_papers(pubs)) == [("DOI:10.1/A",), ("x1",), ("x2",)]
    assert rows(S.seed_papers_keywords(pubs, 2000, "graph")) == [("DOI:10.1/A",), ("x1",)]
    assert rows(S.seed_papers_keywords(pubs, 2000, "", "z Graph")) == [("x1",)] and S.seed_papers_keywords(pubs, 2000, "z Graph", normalize=False).count() == 0
    assert rows(S.seed_authors(spark.createDataFrame([("a",), (None,), ("",)], "author_id string"))) == [("a",)]
    u = S.seed_union(spark.createDataFrame([("A",), (None,), ("",)], "id string"), spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rows(u) == [("a",), ("b",)]
    papers = spark.createDataFrame([("p9", "http://x.y/10.1/A"), ("p8", None)], "paper_id string, doi_raw string")
    assert rows(S.resolve_aliases(spark.createDataFrame([("DOI:10.1/A",), ("DOI:10.2/u",), ("Q",)], "id string"), papers)) == [("doi:10.2/u",), ("p9",), ("q",)]
    assert S.parse_seeds(["a", '["b", "c"]', "[broken", "12", None][:4]) == ["a", "b", "c", "[broken", "12"] and S.parse_seeds(None) == []
    assert S.literal_seeds(spark, ["x"]).count() == 1 and S.literal_seeds(spark, []).count() == 0


def test_options(monkeypatch):
    monkeypatch.setenv("PAPERWEAVE_X", "7")
    monkeypatch.setenv("PAPERWEAVE_Y", "no")
    monkeypatch.setenv("PAPERWEAVE_TTL_PAPER", "3")
    monkeypatch.setenv("PAPERWEAVE_HTTP_HEADERS", '{"k": 1}')
    assert (options.env_int("X"), options.env_int("Y"), options.env_float("X"), options.env_float("Z")) == (7, None, 7.0, None)
    assert options.env_headers() == {"k": "1"} and options.env_headers("Y") == {} and options.ttl_days()["paper"] == 3


class Api(BaseHTTPRequestHandler):
    def do_GET(self):
        ok = "good" in self.path
        self.send_response(200 if ok or "odd" in self.path else 404)
        self.end_headers()
        self.wfile.write(b'{"data":[]}' if ok else b"[1]")

    def log_message(self, *a):
        pass


def test_rest_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rest.register(spark)
    df = spark.read.format("paper_api").options(base=f"http://127.0.0.1:{server.server_port}", endpoint="references", ids=json.dumps(["GOOD", "good", "odd", "gone"]), batch="2", fields="title").load()
    assert rows(df.select("endpoint", "key_id", "body")) == [("references", "gone", None), ("references", "good", '{"data":[]}'), ("references", "odd", None)]
    from paperweave.sources.fetch import stale_ids, through_cache

    ids = spark.createDataFrame([("A",), ("GOOD",), ("gone",), (None,)], "id string")
    now = F.lit("2024-01-05").cast("timestamp")
    assert rows(stale_ids(ids, raw(spark), "references", now)) == [("gone",), ("good",)]
    got = through_cache(ids, raw(spark), "references", now, f"http://127.0.0.1:{server.server_port}")
    assert [r.key_id for r in got.collect()] == ["good"]
    assert D.usable(raw(spark), "references", F.col("key_id") == "m").count() == 1
    server.shutdown()
    with pytest.raises(ValueError):
        rest.PaperApiReader({"base": "x", "endpoint": "nothing"})


def test_streaming_equals_batch(spark, tmp_path):
    first = raw(spark, [("paper", "k", "v1"), ("paper", "j", "w")], 2)
    late = raw(spark, [("paper", "K", "v0")], 1)
    new = raw(spark, [("paper", "k", "v2")], 3)
    inbox, table = str(tmp_path / "in"), str(tmp_path / "table")
    seen = []
    for part in (first, late, new):
        part.coalesce(1).write.mode("append").parquet(inbox)
        ingest(read_documents(spark, inbox, 1), table, str(tmp_path / "cp"), lambda b, n: seen.append(n)).awaitTermination()
    got = spark.read.parquet(table)
    assert rows(got.select("key_id", "body")) == [("j", "w"), ("k", "v2")] and len(seen) == 3
    assert rows(newest(None, first.unionByName(late).unionByName(new)).select("key_id", "body")) == rows(got.select("key_id", "body"))
    assert rows(newest(got, new)) == rows(got)
    q = arrivals(read_documents(spark, inbox)).writeStream.format("memory").queryName("arr").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n_docs for r in spark.table("arr").collect()) == 4


def test_live_crawl_equals_crawl_over_tables(spark, tmp_path, monkeypatch):
    """A crawl that fetches level by level finds what a crawl over finished tables finds, and fetches nothing twice."""
    from http.server import ThreadingHTTPServer

    from paperweave.operators.crawl import CitationSource, crawl
    from paperweave.sources.fetch import CachedApi, unusable

    rnd = random.Random(9)
    ids = [f"p{i}" for i in range(30)]
    cites = {(rnd.choice(ids), rnd.choice(ids)) for _ in range(60)}
    record = {i: {"paperId": i.upper(), "title": f"Graph {i}", "year": rnd.randint(1995, 2010)} for i in ids}
    bodies = {f"/paper/{i}": record[i] for i in ids if i != "p3"}
    bodies |= {f"/paper/{i}/references": {"data": [{"citedPaper": record[b]} for a, b in sorted(cites) if a == i]} for i in ids}
    bodies |= {f"/paper/{i}/citations": {"data": [{"citingPaper": record[a]} for a, b in sorted(cites) if b == i]} for i in ids}
    bodies |= {"/author/a1/papers": {"data": [{"paperId": "p5", "title": "x"}]}}
    asked = []

    class Graph(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            body = bodies.get(self.path.split("?")[0])
            self.send_response(200 if body is not None else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode() if body is not None else b"")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Graph)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    path = str(tmp_path / "cache")
    bad = spark.createDataFrame([("paper", "p1", "x", "[1]")], "endpoint string, key_id string, path string, body string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    append_documents(bad.select("endpoint", "key_id", "path", "fetched_at", "body"), path)
    monkeypatch.setenv("PAPERWEAVE_HTTP_CONCURRENCY", "3")
    api = CachedApi(spark, path, f"http://127.0.0.1:{server.server_port}", fields={"paper": "title,year"})
    assert api.request["concurrency"] == 3 and rows(unusable(api.cache()).select("key_id")) == [("p1",)]
    keep = lambda y, t: y >= 2000
    seeds = spark.createDataFrame([("P1",), ("p2",), ("p3",)], "id string")
    authors = spark.createDataFrame([("a1",)], "author_id string")
    live = crawl(api, seeds, keep, 1, authors)
    first = len(asked)
    assert first == len(set(asked)) and any(p.startswith("/paper/p1?fields=title") for p in asked)
    both = [[r.asDict() for r in x.collect()] for x in (live.discovered, live.edges)]
    again = crawl(api, seeds, keep, 1, authors)  # all from the cache but the failed seed
    assert {p.split("?")[0] for p in asked[first:]} == {"/paper/p3"}
    obs = spark.createDataFrame([(a, b, record[b]["year"], record[b]["title"], record[a]["year"], record[a]["title"]) for a, b in cites], "citing_id string, cited_id string, y string, t string, y2 string, t2 string")
    table = CitationSource(
        spark.createDataFrame([(i, r["year"], r["title"]) for i, r in record.items() if i != "p3"], "paper_id string, year int, title string"),
        obs.selectExpr("citing_id", "cited_id", "int(y) as year", "t as title"), obs.selectExpr("citing_id", "cited_id", "int(y2) as year", "t2 as title"),
        spark.createDataFrame([("a1", "p5")], "author_id string, paper_id string"),
    )
    want = crawl(table, seeds, keep, 1, authors)
    for got in (live, again):
        assert rows(got.discovered) == rows(want.discovered) and rows(got.edges) == rows(want.edges) and got.stats == want.stats
    assert len(both[0]) > 5
    server.shutdown()


def some_seeds(spark):
    return ["p1", "P2"]


def test_called_seeds(spark):
    assert rows(S.called_seeds(spark, "tests.test_sources:some_seeds")) == [("P2",), ("p1",)]
