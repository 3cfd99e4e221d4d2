import random

import pytest
from pyspark.sql import functions as F

from paperweave.operators.crawl import CitationSource, adjacency, crawl, discovered_records, mutual
from paperweave.operators.predicates import crawl_predicate
from tests.conftest import rows

YEAR = 2000


def keep(y, t):
    return crawl_predicate(y, t, YEAR, None)


def source(spark, refs, cits, years, dead=(), authors=()):
    ids = sorted({x for e in [*refs, *cits] for x in e} | set(years))
    detail = spark.createDataFrame([(i, years.get(i), "t") for i in ids if i not in dead], "paper_id string, year int, title string")
    r = spark.createDataFrame([(u, v, years.get(v), "t") for u, v in refs], "citing_id string, cited_id string, year int, title string")
    c = spark.createDataFrame([(u, v, years.get(u), "t") for u, v in cits], "citing_id string, cited_id string, year int, title string")
    return CitationSource(detail, r, c, spark.createDataFrame(list(authors), "author_id string, paper_id string"))


def model(refs, cits, years, dead, seeds, limit):
    """The declarative definition of a crawl, level by level over Python sets."""
    ok = lambda x: years.get(x) is None or years[x] >= YEAR
    live = {s for s in seeds if s not in dead}
    claimed, found, edges, expanded, depth = set(seeds), set(live), {}, set(), {s: 0 for s in live}

    def visit(front, level):
        new = set()
        for u, v in refs:
            if u in front and ok(v):
                edges.setdefault((u, v), level)
                new.add(v)
        for u, v in cits:
            if v in front and ok(u):
                edges.setdefault((u, v), level)
                new.add(u)
        expanded.update(front)
        fresh = new - found
        found.update(fresh)
        depth.update({x: level + 1 for x in fresh})
        return len(fresh)

    news = visit(live, 0)
    level, rounds, stats = 1, 0, []
    while True:
        front = {x for x in found if depth[x] == level} - claimed
        claimed |= front
        size = len(front) + (len(live) if level == 1 else 0)
        news = visit(front, level) + (news if level == 1 else 0)
        rounds += 1
        stats.append((rounds, size, news))
        level += 1
        if not news or (limit >= 0 and rounds > limit):
            return {(x, depth[x], x in expanded) for x in found}, {(*e, k) for e, k in edges.items()}, stats


def check(spark, refs, cits, years, dead, seeds, limit, authors=()):
    got = crawl(source(spark, refs, cits, years, dead, authors), spark.createDataFrame([(s,) for s in seeds], "id string"), keep, limit)
    found, edges, stats = model(refs, cits, years, dead, seeds, limit)
    assert {tuple(r) for r in got.discovered.collect()} == found
    assert {tuple(r) for r in got.edges.collect()} == edges and got.stats == stats
    assert {r.paper_id for r in got.nodes().collect()} == {x for x, _, e in found if e} | {x for u, v, _ in edges for x in (u, v)}
    return got


CHAIN = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]


@pytest.mark.parametrize("limit,expanded", [(0, "ab"), (1, "abc"), (-1, "abcde")])
def test_chain(spark, limit, expanded):
    got = check(spark, CHAIN, [], {}, (), ["a"], limit)
    assert "".join(sorted(r.paper_id for r in got.discovered.where("expanded").collect())) == expanded


MINI = {
    "diamond": ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], [], {}, (), ["a"]),
    "cycle": ([("a", "b"), ("b", "a"), ("c", "c"), ("a", "c")], [], {}, (), ["a"]),
    "bridge": ([("a", "x"), ("x", "y")], [], {"x": 1990}, (), ["a"]),
    "null year": ([("a", "x")], [], {"x": None}, (), ["a"]),
    "old seed": ([("s", "a")], [("s", "a")], {"s": 1980}, (), ["s"]),
    "dead seed": ([("a", "z"), ("z", "q")], [], {}, ("z",), ["a", "z"]),
    "reverse": ([], [("b", "a")], {}, (), ["a"]),
    "no seeds": (CHAIN, [], {}, (), []),
    "all dead": (CHAIN, [], {}, ("a",), ["a"]),
}


@pytest.mark.parametrize("name", MINI)
def test_miniatures(spark, name):
    check(spark, *MINI[name], -1)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    ids = [f"p{i}" for i in range(18)]
    pick = lambda n: [(rnd.choice(ids), rnd.choice(ids)) for _ in range(n)]
    years = {i: rnd.choice([None, 1995, 2005, 2010]) for i in ids}
    check(spark, pick(16), pick(12), years, set(rnd.sample(ids, 3)), rnd.sample(ids, 3), seed - 1)


def test_letter_case_and_authors(spark):
    s = source(spark, [("A", "B")], [], {}, (), [("w", "A"), ("w", None), ("v", "q")])
    got = crawl(s, spark.createDataFrame([], "id string"), keep, -1, spark.createDataFrame([("w",), (None,)], "author_id string"))
    assert {r.paper_id for r in got.discovered.collect()} == {"a", "b"}


def test_output_filter_ends_early_and_sink(spark):
    seen = []
    s = source(spark, CHAIN, [], {"a": 2005, "b": 2001, "c": 2005, "d": 2005})
    got = crawl(s, spark.createDataFrame([("a",)], "id string"), keep, -1, write=lambda y, t: y == 1900, on_level=lambda k, front, edges: seen.append((k, front.count(), edges.count())))
    assert got.stats == [(1, 2, 0)] and seen == [(0, 1, 1), (1, 1, 1)]


def test_records_and_edge_summaries(spark):
    s = source(spark, [("a", "b"), ("b", "a"), ("a", "a")], [("c", "a")], {"b": 2003, "c": 2004}, ("b",))
    seeds = spark.createDataFrame([("a",)], "id string")
    got = crawl(s, seeds, keep, 0)
    assert {(r.paper_id, r.year) for r in discovered_records(got, s, keep).collect()} == {("a", None), ("b", 2003), ("c", 2004)}
    assert rows(adjacency(got.edges)) == [("a", 2), ("b", 1), ("c", 1)]
    assert rows(mutual(got.edges)) == [("a", "b")]
