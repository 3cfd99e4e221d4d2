import json
import random

import pytest

from paperweave.llm.canonical import canonical, copies, copy_groups
from paperweave.llm.match import align, doi_key, fit_logistic, match, near, title_words
from tests.conftest import rows


def dressed(record, rnd):
    out = {}
    for k in rnd.sample(list(record), len(record)):
        v = record[k]
        if isinstance(v, str):
            v = rnd.choice([str.upper, str.lower, str.title, str])(v)
            v = rnd.choice(["", " ", "\t", " "]) + v.replace(" ", rnd.choice([" ", "  ", " - ", " ", "_"])) + rnd.choice(["", ".", " !", "…"])
        elif isinstance(v, int):
            v = rnd.choice([v, str(v)])
        elif isinstance(v, list):
            v = [x + rnd.choice(["", ".", " "]) for x in v]
        out[k] = v
    return json.dumps(out, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))


RECORDS = [
    {"title": "Größe der Straße", "authors": ["Zoë Q", "Ann B"], "year": 2001, "doi": None}, {"title": "Große der Straße", "authors": ["Zoë Q", "Ann B"], "year": 2001, "doi": None},
    {"title": "Größe der Straße", "authors": ["Zoë Q"], "year": 2001, "doi": None}, {"title": "Größe der Straße", "authors": ["Ann B", "Zoë Q"], "year": 2001, "doi": None},
    {"title": "Größe der Straße", "authors": ["Zoë Q", "Ann B"], "year": 2002, "doi": None}, {"title": "Größe der Straße", "authors": ["Zoë Q", "Ann B"], "year": 2001, "doi": "10.1/x"},
    {"title": None, "authors": [], "year": None, "doi": None}, {"title": "视频 分析", "authors": ["李 明"], "year": 1999, "doi": "10.1/X"},
]


def test_dress_doesnt_count_content_does(spark):
    rnd = random.Random(3)
    data, group, k = [], {}, 0
    for g, r in enumerate(RECORDS):
        for _ in range(g + 1):
            data.append((k, dressed(r, rnd), "x", 1))
            group[k] = g
            k += 1
    data += [(k, None, "x", 1), (k + 1, None, "x", 1), (k + 2, "not json", "x", 1), (k + 3, "NOT-JSON", "x", 1), (k + 4, "[1]", "x", 1), (k + 5, "", "x", 1), (0, data[0][1], "x", 1)]
    df = spark.createDataFrame(data, "record_id bigint, body string, hash string, keep_id int")
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    want = {(first[g], i) for i, g in group.items() if i != first[g]} | {(k + 2, k + 3)}
    assert {tuple(r) for r in copies(df).collect()} == want
    n = {r.keep_id: r.n_copies for r in copy_groups(df).collect()}
    assert n[first[3]] == 4 and n[0] == 2 and n[k] == n[k + 1] == 1 and all(r.n_texts == 1 for r in copy_groups(df).collect())
    assert copies(df.limit(0)).count() == 0 and copy_groups(df.limit(0)).count() == 0


def test_canonical_rules():
    a = canonical
    assert a('{"a":"é"}') == a('{"a":"e\\u0301"}') != a('{"a":"e"}')
    assert a('{"a":2001}') == a('{"a":"2001"}') == a('{"a":2001.0}') and a('{"a":""}') == a('{"b":null}') == a("{}")
    assert a('{"a":"x","b":"y"}') == a('{"b":"Y","a":"X"}') != a('{"a":"y","b":"x"}')
    assert a(None) is None and a("") == "?"


def test_whole_feed_against_sql(spark, sf, duck):
    from paperweave.llm import queries

    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        out = duck.execute(sql)
        cols = [d[0] for d in out.description]
        assert rows(got.select(*cols)) == sorted((tuple(r) for r in out.fetchall()), key=repr)


def test_a_third_of_all_rows_is_one_record(spark):
    df = spark.range(3000).selectExpr("id as record_id", """case when id % 3 = 0 then '{"t":"same"}' else concat('{"t":', id, '}') end as body""")
    got = copies(df)
    assert got.count() == 999 and {r.keep_id for r in got.collect()} == {0}


# ---- works across tables


def test_words_and_identifiers():
    assert title_words("<i>Beyond</i> Caf&eacute; &amp; {Graphs}") == ["beyond", "cafe", "graphs"]
    assert title_words("CÃ³mo visualisation catalogues vs. nets") == ["como", "vizualization".replace("viz", "vis"), "catalogs", "vs.", "nets"]
    assert title_words("深度学习 x") == ["深度", "度学", "学习", "x"] and title_words(None) == [] and title_words("Cut of…") == ["cut", "of…"]
    assert doi_key(" HTTPS://doi.org//10.1/A?x=1#y ") == "10.1/a" and doi_key("doi:10.1/a") == "10.1/a" and doi_key("n/a") is None and doi_key(None) is None
    assert near("methods", "methos") and near("traversal", "traverasl") and not near("linking", "ranking") and near("thesis", "tkfsis", True)
    assert align(["bibl.", "archives"], ["bibliographic", "archives"], [False] * 2) == ([True, True], 0)
    assert align(["erratum", "to", "x"], ["x", "y"], [False] * 3) == ([False, False, True], 1)


def test_logistic_learns_and_survives_nothing():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] > 0.3).astype(float)
    w = fit_logistic(x[:300], y[:300])
    assert (((x[300:] @ w[:-1] + w[-1]) > 0) == y[300:]).mean() > 0.9
    assert fit_logistic(np.zeros((0, 2)), np.zeros(0)).tolist() == [0, 0, 0]


KINDS = ["toolkit for indexing", "model of traversal", "study on caching", "view of linking"]
AREAS = ["citation graphs", "patent families", "sensor archives", "open repositories", "venue taxonomies"]


@pytest.fixture(scope="module")
def works(spark):
    rnd = random.Random(8)
    name = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5)).capitalize()
    papers, pubs, truth = [], [], set()
    for i in range(400):
        t, y = f"{name()}: a {rnd.choice(KINDS)} of {rnd.choice(AREAS)}", rnd.randint(1990, 2020)
        doi, key = (f"10.9/{i}", f"conf/{i}") if i % 3 else (None, None)
        papers.append((f"p{i}", t, y, (key, doi), None))
        if i % 10 == 0:  # an older load, otherwise written
            papers.append((f"p{i}", "Old title", None, None, None))
        if i % 2:
            k = rnd.randrange(2, len(t.split()[0]) - 2)
            typo = t[:k] + t[k + 1] + t[k] + t[k + 2 :]
            pubs.append((f"e{i}", rnd.choice([typo, t.upper(), f"<b>{t}</b>", t + "."]), y, f"https://doi.org/{doi}" if doi and i % 4 == 1 else None, None))
            truth.add((f"p{i}", f"e{i}"))
        elif i % 4 == 0:
            pubs.append((f"x{i}", rnd.choice([f"Erratum to: {t}", f'Reply to comments on "{t}"', f"{t}: tutorial notes"]), y, f"10.5/o.{i}", None))
        else:
            pubs.append((f"n{i}", f"{name()}: a {rnd.choice(KINDS)} of {rnd.choice(AREAS)}", y, None, f"conf/o{i}"))
    papers += [(f"g{i}", "Editorial", 2000 + i, None, None) for i in range(9)] + [(None, "No id", 2000, None, None), ("nt", None, None, ("conf/nt", None), None)]
    pubs += [("ge", "Editorial", 2003, None, None), ("nul", None, None, None, None), ("e-nt", "Anything", None, None, "conf/nt"), ("emp", "", 2000, "", "")]
    truth.add(("nt", "e-nt"))
    d = spark.createDataFrame([(*p, "z") for p in papers], "paper_id string, title string, year int, external_ids struct<dblp:string,doi:string>, fetched_at timestamp, words string")
    from pyspark.sql import functions as F

    d = d.withColumn("fetched_at", F.when(F.col("title") != "Old title", F.lit("2024-01-01").cast("timestamp")))
    return d, spark.createDataFrame([(*p, "z") for p in pubs], "element_id string, title string, year int, doi string, dblp_key string, q string"), truth


def test_works_are_matched(works):
    d, p, truth = works
    got = match(d, p).collect()
    found = {(r.paper_id, r.element_id) for r in got}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 2
    assert len({e for _, e in found}) == len(found) and all(0.5 <= r.confidence <= 1 for r in got)


def test_repeated_and_empty_tables(works):
    d, p, truth = works
    assert match(d.limit(0), p).count() == 0 and match(d, p.limit(0)).count() == 0
    twice = match(d, p.where("element_id = 'e1'").unionByName(p.where("element_id = 'e1'").selectExpr("'e1b' as element_id", "title", "year", "doi", "dblp_key", "q")))
    assert rows(twice.select("paper_id", "element_id")) == [("p1", "e1"), ("p1", "e1b")]


def test_recall_where_identifiers_tell(spark):
    """On the table: publications with an identifier of a paper; and works of other kinds are left alone."""
    sf = "/root/testdata/sf0.01"
    d, p = spark.read.parquet(f"{sf}/paper_detail.parquet"), spark.read.parquet(f"{sf}/publication.parquet")
    got = {r.element_id: r.paper_id for r in match(d, p).collect()}
    by_key = {r.k: r.paper_id for r in d.selectExpr("external_ids.dblp as k", "paper_id").where("k is not null").collect()}
    known = [(r.element_id, by_key[r.dblp_key]) for r in p.collect() if r.dblp_key in by_key]
    assert len(known) > 50 and sum(got.get(e) == w for e, w in known) >= 0.98 * len(known)
    # the title alone must find nearly all of them again
    hidden = p.selectExpr("element_id", "title", "year", "cast(null as string) as doi", "cast(null as string) as dblp_key")
    alone = {r.element_id: r.paper_id for r in match(d, hidden).collect()}
    right = sum(alone.get(e) == w for e, w in known)
    wrong = sum(e in alone and alone[e] != w for e, w in known)
    assert right >= 0.8 * len(known) and wrong <= 0.02 * len(known)
    assert not [r for r in p.collect() if r.element_id in got and (r.title or "").startswith(("Erratum", "Reply to"))]


def test_a_third_of_all_publications_is_alike(spark, works):
    d, p, truth = works
    from pyspark.sql import functions as F

    many = spark.range(200).select(F.concat(F.lit("c"), F.col("id")).alias("element_id"))
    one = p.where("element_id = 'e1'").drop("element_id")
    both = p.unionByName(many.withColumn("k", F.lit(1)).join(one.withColumn("k", F.lit(1)), "k").drop("k"))
    got = {r.element_id: r.paper_id for r in match(d, both).collect()}
    assert all(got.get(f"c{i}") == "p1" for i in range(200)) and got["e1"] == "p1"


def test_titles_of_common_words_only(spark):
    """No word singles a paper out, the words together do; a title of very many words is found, too."""
    import itertools

    sets = list(itertools.combinations(["archives", "graphs", "profiling", "silos", "hierarchical", "patents", "linking", "caching"], 4))
    long = [f"w{chr(97 + i)}{chr(97 + i)}x" for i in range(26)]
    titles = [" ".join(s) for s in sets] + [" ".join(long[:25] + long[25:] * (i == 0)) for i in range(20)]
    d = spark.createDataFrame([(f"p{i}", t, 2000, (None, None), None) for i, t in enumerate(titles)], "paper_id string, title string, year int, external_ids struct<dblp:string,doi:string>, fetched_at timestamp")
    asked = [(f"e{i}", t, 2000, None, None) for i, t in enumerate(titles[: len(sets)])]
    got = match(d, spark.createDataFrame(asked, "element_id string, title string, year int, doi string, dblp_key string"), confidence=0.0)
    assert rows(got.select("paper_id", "element_id")) == sorted(((f"p{i}", f"e{i}") for i in range(len(sets))), key=repr)


def test_cut_and_misspelt_titles_are_candidates(spark):
    """What reaches the goal only as it is aligned: a cut end, shortened words, two errors in a word, words run together."""
    titles = ["Kuzaskobus, a toolkit for linking and crawling of author networks"] + [f"Toolkit for {a} of {b}" for a in ("profiling", "caching") for b in ("archives", "venues", "silos")]
    asked = {"cut": "Kuzaskobus, a toolkit for lin", "end": "Kuzask…", "two": "Kuzeskabus", "run": "Kuzaskobustoolkit", "short": "Kuzaskobus t. f. lin. crawl. auth. netw."}
    d = spark.createDataFrame([(f"p{i}", t, 2000, (None, None), None) for i, t in enumerate(titles)], "paper_id string, title string, year int, external_ids struct<dblp:string,doi:string>, fetched_at timestamp")
    p = spark.createDataFrame([(e, t, 2000, None, None) for e, t in asked.items()], "element_id string, title string, year int, doi string, dblp_key string")
    got = {r.element_id: r.paper_id for r in match(d, p, confidence=0.0).collect()}
    assert got == dict.fromkeys(asked, "p0")


def test_identifier_of_many_papers(spark):
    """An identifier that more than sqrt(N) papers carry still names its papers; the nearest year decides."""
    d = spark.createDataFrame([(f"p{i}", f"Volume {i}", 1990 + i, (None, "10.1/many"), None) for i in range(30)], "paper_id string, title string, year int, external_ids struct<dblp:string,doi:string>, fetched_at timestamp")
    p = spark.createDataFrame([("e", None, 2003, "10.1/many", None)], "element_id string, title string, year int, doi string, dblp_key string")
    assert rows(match(d, p).select("paper_id", "element_id")) == [("p13", "e")]


WORKS = "paper_id string, title string, year int, external_ids struct<dblp:string,doi:string>, fetched_at timestamp"
ASKED = "element_id string, title string, year int, doi string, dblp_key string"


def test_all_equal_titles_of_common_words_are_found(spark):
    """Twelve words of twenty each, none rare, no identifiers: every publication finds the paper of the same words."""
    rnd = random.Random(3)
    words = [a + b for a in ("cita", "gra", "arch", "net", "patt") for b in ("ling", "dex", "port", "view")]
    titles = list(dict.fromkeys(" ".join(sorted(rnd.sample(words, 12))) for _ in range(230)))[:200]
    d = spark.createDataFrame([(f"p{i}", t, None, (None, None), None) for i, t in enumerate(titles)], WORKS)
    p = spark.createDataFrame([(f"e{i}", t, None, None, None) for i, t in enumerate(titles)], ASKED)
    got = {r.element_id: r.paper_id for r in match(d, p).collect()}
    assert got == {f"e{i}": f"p{i}" for i in range(len(titles))}
    shared = spark.createDataFrame([(f"p{i}", t, None, (None, "10.1/x" if i < 20 else None), None) for i, t in enumerate(titles)], WORKS)
    one = spark.createDataFrame([("e", titles[7], None, "10.1/x", None)], ASKED)
    assert rows(match(shared, one).select("paper_id", "element_id")) == [("p7", "e")]


def test_candidates_are_all_that_reach_the_floor(spark):
    """Against brute force over all pairs of titles, misspelt, cut, shortened, long and repeated words among them."""
    from pyspark.sql import functions as F

    from paperweave.llm import match as M

    rnd = random.Random(11)
    words = ["archives", "graphs", "profiling", "silos", "linking", "caching", "venues", "mining", "of", "for", "on", "kuzaskobus", "tamelovik", "rasopilum", "veturamok"]
    long = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(70)]
    titles = list({tuple(rnd.sample(words, rnd.randint(2, 8))) for _ in range(150)}) + [tuple(long), tuple(long[:60]), ("of", "of", "graphs")]

    def spoilt(t):
        t = list(t)
        k = rnd.randrange(len(t))
        w = t[k]
        t[k] = rnd.choice([w, w[:-1], w[0] + w[2:1:-1] + w[1] + w[3:] if len(w) > 4 else w, w[:4] + ".", w + "x", w * 2, w[:3] + "zz" + w[3:]])
        t = t[: rnd.randint(max(1, len(t) - 3), len(t))]
        return tuple(t + ([t[-1]] if rnd.random() < 0.1 else []))

    asked = list({spoilt(rnd.choice(titles)) for _ in range(300)})
    asked = [tuple(M.title_words(" ".join(t))) for t in asked]
    asked = [t for t in dict.fromkeys(asked) if t]
    d = spark.createDataFrame(list(enumerate(map(list, titles))), "td long, words array<string>")
    q = spark.createDataFrame(list(enumerate(map(list, asked))), "tq long, words array<string>")
    slots = M.query_slots(q, M.vocabulary(d), float(len(titles)))
    for floor in (0.5, 0.75):
        got = {(r.tq, r.td) for r in M.candidates(slots, d, floor).collect()}
        want = 0
        for r in slots.collect():
            weights, unknown = [s["weight"] for s in r.slots], [not s["known"] for s in r.slots]
            for i, t in enumerate(titles):
                hit, _ = M.align(r.words, list(t), unknown)
                if sum(weights) and sum(w for w, x in zip(weights, hit) if x) >= floor * sum(weights):
                    want += 1
                    assert (r.tq, i) in got, (floor, r.words, t)
        assert want > 100 and F is not None
