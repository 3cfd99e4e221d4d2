import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweave.operators.cache_documents import document_children, flat_authors, flat_papers
from paperweave.operators.shred import Invalid, triples

BAD = ["", " ", "{", "{}x", "[1,]", '{"a":1,}', "[,1]", '{"a" 1}', "01", '"a', '{"a":1}}', "[1 2]", "nul", "{1:2}", '"\\x"', "{,}", "[}", '{"a":}', ":", "[:]", '{"a":,"b":1}', '{"a"}', "NaN", '"\n"', "[1]]", "1 2"]


def walk(o, path=(), places=()):
    if isinstance(o, dict):
        for k, v in o.items():
            yield from walk(v, (*path, k), places)
    elif isinstance(o, list):
        for i, v in enumerate(o):
            yield from walk(v, (*path, "[]"), (*places, i))
    else:
        yield path, places, None if o is None else o if isinstance(o, str) else json.dumps(o)


values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=4), c, max_size=4), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(values, st.booleans(), st.sampled_from([None, 1]))
def test_triples_are_the_leaves(o, ascii_, indent):
    assert triples(json.dumps(o, ensure_ascii=ascii_, indent=indent)) == list(walk(o))


@pytest.mark.parametrize("text", BAD)
def test_invalid(text):
    with pytest.raises(Invalid):
        triples(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:ab1 \\n', max_size=14))
def test_validity_is_json_validity(text):
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    try:
        triples(text)
        assert ok
    except Invalid:
        assert not ok


def test_last_repeated_key_holds():
    assert triples('{"a": {"b": 1}, "a": {"c": 2}, "d": [{"e": 1, "e": 2}]}') == [(("a", "c"), (), "2"), (("d", "[]", "e"), (0,), "2")]


def children(raw_id, endpoint, body):
    """The children by recursive descent over the parsed tree."""
    try:
        o = json.loads(body) if body is not None else None
    except ValueError:
        return
    if not isinstance(o, dict):
        return

    def text(v):
        return None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)

    def people(authors, d):
        for j, a in enumerate(authors if isinstance(authors, list) else []):
            if isinstance(a, dict) and text(a.get("authorId")):
                yield raw_id, "author", d, j, -1, text(a["authorId"])
                names = (a.get("externalIds") or {}).get("DBLP") if isinstance(a.get("externalIds"), dict) else None
                for k, n in enumerate(names if isinstance(names, list) else [names]):
                    if text(n):
                        yield raw_id, "dblp_name", d, j, k, text(n)

    def inside(p, d):
        ext = p.get("externalIds")
        for k, v in (ext if isinstance(ext, dict) else {}).items():
            if text(v):
                yield raw_id, "external", d, -1, -1, f"{k}:{text(v)}"
        yield from people(p.get("authors"), d)

    if endpoint == "paper":
        if text(o.get("paperId")):
            yield from inside(o, -1)
        return
    data = o.get("data") if isinstance(o.get("data"), list) else []
    if endpoint == "authors":
        yield from people(data, -1)
    for i, x in enumerate(data):
        if not isinstance(x, dict):
            continue
        if endpoint == "author_papers" and text(x.get("paperId")):
            yield raw_id, "authored", i, -1, -1, text(x["paperId"])
        for field, kind, where in (("citedPaper", "cited", "references"), ("citingPaper", "citing", "citations")):
            p = x.get(field)
            if endpoint == where and isinstance(p, dict) and text(p.get("paperId")):
                yield raw_id, kind, i, -1, -1, text(p["paperId"])
                yield from inside(p, i)


def test_whole_table_against_recursive_descent(spark, sf):
    raw = spark.read.parquet(f"{sf}/raw_doc.parquet")
    got = sorted(tuple(r) for r in document_children(raw).collect())
    want = sorted(c for r in raw.collect() for c in children(r.raw_id, r.endpoint, r.body))
    assert got == want and len(got) > 100


CASES = [
    ("paper", '{"paperId":"P1","title":"T","year":2001,"externalIds":{"DOI":"d","MAG":null,"X":"","C":7},"authors":[null,{"authorId":"a","externalIds":{"DBLP":"N"}},{"authorId":"","externalIds":{"DBLP":["M"]}},{"authorId":"b","externalIds":{"DBLP":["",null,"Q"]}}]}'),
    ("paper", '{"paperId":null,"authors":[{"authorId":"a"}]}'),
    ("references", '{"data":[{"citedPaper":null},{"citedPaper":{"paperId":"x","authors":null}},null,5]}'),
    ("citations", '{"data":null}'), ("citations", "{bad"), ("citations", None), ("citations", ""), ("unknown", '{"data":[]}'), (None, '{"data":[]}'),
    ("authors", '{"data":[{"authorId":"a","name":"n"},{"name":"z"}]}'), ("author_papers", '{"data":[{"paperId":"q"},{"paperId":""}]}'),
]


def test_shapes_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(i, e, b, "x", "y") for i, (e, b) in enumerate(CASES)], "raw_id bigint, endpoint string, body string, key string, columns string")
    got = sorted(tuple(r) for r in document_children(df).collect())
    assert got == sorted(c for i, (e, b) in enumerate(CASES) for c in children(i, e, b))
    assert {(r.raw_id, r.paper_id, r.year) for r in flat_papers(df).collect()} == {(0, "P1", 2001), (2, "x", None), (10, "q", None)}
    assert {(r.raw_id, r.author_pos, r.author_id) for r in flat_authors(df).collect()} == {(0, 1, "a"), (0, 3, "b"), (9, 0, "a")}
    assert document_children(df.limit(0)).count() == 0


def test_long_record_and_repeated_rows(spark):
    body = json.dumps({"data": [{"citedPaper": {"paperId": f"{i:040x}", "title": "t" * 50}} for i in range(20000)]})
    df = spark.createDataFrame([(1, "references", body), (1, "references", body)], "raw_id bigint, endpoint string, body string")
    assert document_children(df).count() == 40000
