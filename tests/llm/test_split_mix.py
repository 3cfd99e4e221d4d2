import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweave.llm.mix import horizon, mix
from paperweave.llm.split import boundaries, cut_tokens, oversized, split_texts
from paperweave.llm.tokens import encode, vocabulary

LONG = ["中文字" * 900, "😀😁" * 700, "abc" * 2500, " " * 9000, "\n" * 5000, "word " * 3000, "A sentence here. " * 600, "para one\n\n" * 900, "l\r\nm\r\n" * 900, "。句子" * 700]


def pieces_hold(text, limit=1024, overlap=64):
    v = vocabulary()
    ids = encode(v, text)
    cuts = cut_tokens(v, text, ids, limit, overlap)
    data, off = text.encode(), np.append(0, np.cumsum(v.lengths[ids]))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(ids) and (len(cuts) > 1) == (len(ids) > limit)
    for k, (p, q, _) in enumerate(cuts):
        assert q - p <= limit
        if len(cuts) > 1:
            assert len(v.ids(data[off[p] : off[q]].decode("utf-8", "replace"))) <= limit
        if k:
            assert overlap <= cuts[k - 1][1] - p <= overlap + 3 and p > cuts[k - 1][0] and q > cuts[k - 1][1]
    return cuts


@pytest.mark.parametrize("text", LONG)
def test_long_texts(text):
    pieces_hold(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n中é!", min_size=0, max_size=600), st.integers(8, 40), st.integers(0, 7))
def test_small_limits(text, limit, overlap):
    v = vocabulary()
    ids = encode(v, text)
    cuts = cut_tokens(v, text, ids, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(ids) and all(q - p <= limit for p, q, _ in cuts)
    covered = set()
    for p, q, _ in cuts:
        covered.update(range(p, q))
    assert covered == set(range(len(ids)))


def test_best_boundary_wins():
    kinds = {k for _, _, k in pieces_hold("One two three. " * 200 + "\n\n" + "four five " * 900)}
    assert {"paragraph", "space", "end"} <= kinds
    assert {k for _, _, k in pieces_hold("abc" * 2500)} == {"hard", "end"}
    p, line, s, w = boundaries(b"a b. c\n\nd\ne")
    assert (p.tolist(), line.tolist(), s.tolist(), w.tolist()) == ([6], [6, 9], [4], [1, 4, 6, 9])
    with pytest.raises(ValueError):
        cut_tokens(vocabulary(), "x", np.zeros(1, int), 5, 5)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.text is not None}
    by = defaultdict(list)
    for r in split_texts(docs).collect():
        by[r.doc_id].append(r)
    v = vocabulary()
    assert set(by) == set(text)
    for i, t in text.items():
        part = sorted(by[i], key=lambda r: r.piece_no)
        n = len(encode(v, t))
        assert part[0].n_pieces == len(part) and part[-1].start_token + part[-1].n_tokens == n and all(r.n_tokens <= 1024 for r in part)
        # without the overlaps the pieces give the text again
        ids = encode(v, t)
        whole = b"".join(v.bytes_of[int(x)] for r, nxt in zip(part, [*part[1:], None]) for x in ids[r.start_token : nxt.start_token if nxt else None])
        assert whole.decode() == t
    assert {r.doc_id for r in oversized(docs).collect()} == {i for i, t in text.items() if len(encode(v, t)) > 1024}


def test_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x", 0), (None, "y", 0)], "doc_id bigint, text string, piece_no int")
    got = sorted((str(r.doc_id), r.n_tokens, r.piece) for r in split_texts(df).collect())
    assert got == [("2", 0, ""), ("3", 1, "x"), ("None", 1, "y")]
    assert oversized(df).count() == 0 and split_texts(df.limit(0)).count() == 0


def test_horizon():
    assert horizon([(100, 0.5, 1), (10, 0.5, 2)], None) == 40  # the second runs out first
    assert horizon([(100, 0.5, 1), (10, 0.5, 2)], 50) == 60  # 20 of the second, 30 of the first
    assert horizon([(100, 0.5, 1), (10, 0.5, 2)], 10_000) == 200
    assert horizon([(0, 0.5, 1), (10, 0.0, 2)], None) == 0 and horizon([], 5) == 0


def simulate(rows, targets, end):
    """Virtual times one document at a time: how many uses and tokens each source gets."""
    out = {}
    for s, (w, r) in targets.items():
        sizes = [n for _, x, n in rows if x == s]
        out[s] = (min(r * sum(sizes), w * end), max(sizes, default=0))
    return out


def test_shares_against_simulation(spark):
    rnd = random.Random(4)
    docs, did = [], 0
    for s, n, size in (("big", 900, 40), ("small", 20, 30), ("mid", 200, 60), ("off", 50, 10), (None, 20, 10)):
        for _ in range(n):
            docs.append((did, s, "word " * rnd.randint(1, size)))
            did += 1
    docs += [(did, "big", None), (did + 1, "small", ""), (did + 2, "mid", "word"), (did + 2, "mid", "word")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, n_tokens int")
    want = {"big": (0.6, 1), "small": (0.1, 3), "mid": (0.2, 2), "void": (0.1, 5)}
    targets = spark.createDataFrame([(k, *x) for k, x in want.items()] + [(None, 0.1, 1)], "source string, target_share double, max_repeats int")
    v = vocabulary()
    sized = [(i, s, len(encode(v, t))) for i, s, t in docs if t is not None]
    for budget in (None, 4000, 10**9):
        got = mix(df, targets, budget, buckets=16)
        uses = got.uses.collect()
        report = {r.source: r for r in got.report.collect()}
        for s, (tokens, biggest) in simulate(sized, want, got.horizon).items():
            assert abs(report[s].used_tokens - tokens) <= biggest
            assert report[s].used_tokens == sum(u.n_tokens for u in uses if u.source == s) and report[s].n_uses == sum(u.source == s for u in uses)
        count = defaultdict(int)
        for u in uses:
            count[u.doc_id, u.source] += 1
        copies = defaultdict(int)
        for i, s, _ in sized:
            copies[i, s] += 1
        assert all(n <= want[s][1] * copies[i, s] for (i, s), n in count.items())
        assert [u.finish for u in uses] == sorted(u.finish for u in uses)
        assert set(report) == set(want) and report["void"].used_tokens == 0
    assert not {u.source for u in uses} - set(want)
    first = mix(df, targets, 4000, buckets=16).uses.collect()
    assert first == mix(df.repartition(7), targets, 4000, buckets=16).uses.collect()  # the same seed, the same mix
    assert mix(df.limit(0), targets).uses.count() == 0 and mix(df, targets.limit(0)).uses.count() == 0


def test_balanced_shares_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    report = mix(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_target.parquet")).report.collect()
    there = sum(r.target_share for r in report if r.n_docs)
    for r in report:
        if r.n_docs and r.source not in ("thesis_chapter", "crawl_log"):  # documents as large as their share
            assert abs(r.actual_share - r.target_share / there) < 0.035
        assert r.most_uses <= r.max_repeats


def test_a_later_document_fills_what_a_source_lacks(spark):
    """No source ends further from its part than the best single document after its last whole one would leave it."""
    rnd = random.Random(12)
    docs = [(i, "even", "word " * 10) for i in range(400)] + [(1000 + i, "uneven", "word " * rnd.choice([3, 5, 40, 900])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("even", 0.8, 1), ("uneven", 0.2, 1)], "source string, target_share double, max_repeats int")
    for budget in (900, 2000, 3500):
        got = mix(df, targets, budget, buckets=8)
        report = {r.source: r.used_tokens for r in got.report.collect()}
        goal = got.horizon * 0.2
        uses = [u for u in got.uses.collect() if u.source == "uneven"]
        whole = {u.doc_id for u in uses if u.finish < got.horizon}
        v = vocabulary()
        size = {i: len(encode(v, t)) for i, s, t in docs if s == "uneven"}
        base = sum(size[i] for i in whole)
        off = abs(report["uneven"] - goal)
        assert len(uses) - len(whole) <= 1
        assert all(off <= abs(base + n - goal) + 1e-6 for i, n in size.items() if i not in whole) and off <= abs(base - goal) + 1e-6
        assert abs(report["even"] - got.horizon * 0.8) <= 10
