import re
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperweave.functions import scalars as X
from paperweave.operators.predicates import crawl_predicate, fresh, hash_keyword_match, keyword_match, stored_predicate

HASHES = [
    ("Deep Learning: A Survey!", "deeplearningasurvey"), ("视频 Edge 计算 123", "视频edge计算123"), ("İstanbul", "istanbul"), ("éclair ß", "clair"),
    ("Привет", ""), ("龦龥", "龥"), ("K", "k"), ("", ""), (None, None),
]
DOIS = [
    ("10.1145/3386367.3431316", "10.1145/3386367.3431316"), ("https://doi.org/10.1109/x.y", "10.1109/x.y"), ("http://dx.doi.org//10.1/a", "10.1/a"), ("10.1/a?b=c#d", "10.1/a"),
    ("10.1002/(SICI)1097(1998)17:15/16<1661::AID-SIM968>3.0.CO;2-2", "10.1002/(SICI)1097(1998)17:15/16<1661::AID-SIM968>3.0.CO"),
    ("10.1/a;x/b;y", "10.1/a;x/b"), ("doi:10.1/a;b", "10.1/a;b"), ("doi:10.1/abc", "10.1/abc"), ("", ""), (None, None),
]


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_title_hash(spark):
    assert apply(spark, X.title_hash, [a for a, _ in HASHES]) == [b for _, b in HASHES]


def test_doi_norm(spark):
    assert apply(spark, X.doi_norm, [a for a, _ in DOIS]) == [b for _, b in DOIS]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="10./ab;:?#htp doi-_()<>\t", max_size=25), min_size=20, max_size=20))
def test_doi_norm_is_the_url_path(spark, dois):
    want = []
    for d in dois:
        try:
            want.append(re.sub(r"^/+", "", urlparse(d).path))
        except ValueError:
            want.append(None)
    got = apply(spark, X.doi_norm, dois)
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


def test_dates_ids_and_casts(spark):
    got = apply(spark, X.pub_date, ["2020-02-03", "2020-02", "2020", "2020-13-01", "n.d.", "", None])
    assert [str(g) if g else None for g in got] == ["2020-02-03", "2020-02-01", "2020-01-01", None, None, None, None]
    got = apply(spark, X.pub_date, ["Jan 5, 2020", "5 January 2020", "2020/1/5", "1/5/2020", "20200105", " 5.1.2020 ", "2020-01-05T10:00:00", "Spring 2020", "31/12/99"])
    assert [str(g) if g else None for g in got] == ["2020-01-05"] * 7 + [None] * 2
    assert apply(spark, X.lower_id, ["AB", "", None]) == ["ab", None, None]
    assert apply(spark, X.cache_path, ["DOI:10.1/x", None]) == ["DOI/10.1/x.json", None]
    assert apply(spark, X.doi_alias, ["https://doi.org/10.1/x", None]) == ["DOI:10.1/x", None]
    assert apply(spark, X.to_int, ["7", "x", None]) == [7, None, None]
    assert apply(spark, X.to_float, ["7.5", "x", None]) == [7.5, None, None]
    assert apply(spark, lambda c: X.falsy(c, "int"), [0, 3, None], "int") == [None, 3, None]


@pytest.mark.parametrize(
    "rules,want",
    [(None, [1, 1, 1]), ([""], [1, 1, 1]), (["GRAPH"], [1, 0, 0]), (["edge video", "graph"], [1, 1, 0]), (["video edge  "], [0, 1, 0])],
)
def test_keyword_match(spark, rules, want):
    got = apply(spark, lambda c: keyword_match(c, rules), ["A Graph", "Edge Video", None])
    assert got == [bool(w) for w in want]


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, 2000, "t"), (3, 1999, "t"), (4, 2001, None)], "i int, y int, t string")
    assert [r.i for r in df.where(crawl_predicate(F.col("y"), F.col("t"), 2000, None)).collect()] == [1, 2, 4]
    assert [r.i for r in df.where(stored_predicate(F.col("y"), F.col("t"), 2000, ["T"])).collect()] == [2]
    assert apply(spark, lambda c: hash_keyword_match(c, ["Peer-Review"]), ["xpeerreviewx", None]) == [True, False]
    assert apply(spark, lambda c: hash_keyword_match(c, ["Peer"], normalize=False), ["xpeerx"]) == [False]


def test_freshness(spark):
    df = spark.sql("select * from values (1, 'citations', timestamp'2024-01-01'), (2, 'citations', timestamp'2024-01-09'), (3, 'paper', timestamp'1990-01-01'), (4, 'other', null), (5, 'citations', null) t(i, e, f)")
    ok = df.where(fresh(F.col("f"), F.col("e"), F.lit("2024-01-10").cast("timestamp")))
    assert sorted(r.i for r in ok.collect()) == [2, 3, 4]
