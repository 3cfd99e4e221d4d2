"""Records of the same work in two tables without a common key.

Cross-table retrieval: the papers' titles are the documents of an inverted index over all attributes (title words, year,
DOI, DBLP key), each publication is a query, and scores are BM25. A query's options are all papers that share at least
``FLOOR`` of its title's weight, and the one that an identifier names; whatever can't reach that is never looked up (exact
pruning by the words' upper bounds, see ``lookups``). Kept is a query's first option if it is the paper's nearest
as well; the confidence is a logistic function of the score gap to the runner-up and the agreement of the attributes,
calibrated on records whose identifiers agree.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import skew_join
from ..session import cut

#: BM25's saturation and length normalization.
K1, B = 1.2, 0.3
#: The share of its title's weight that a query's option has at least, if no identifier names it.
FLOOR = 0.75
#: Different words of a title up to which it is listed under pairs of them; words a query word may stand for and be looked
#: up by; letters of a cut or shortened word that say something, at least; letters of a word that is compared by edits, at most.
LONG, WIDE, SHORT, WORD = 48, 8, 3, 64
#: Words of a query that are counted one by one when a list is read.
TERMS = 16
#: Rows of labelled pairs the calibration is fitted on, at most; the parameter's bound.
LABELLED = 20_000

_TAG = re.compile(r"<[^<>]{0,40}>|[{}]")
_WORD = re.compile(r"[㐀-鿿豈-﫿]+|[^\W_㐀-鿿豈-﫿]+\.?")
#: Words that are written for each other.
SAME_WORD = {"versus": "vs", "and": "", "&": "", "the": "", "a": "", "an": ""}


def _unspoilt(text: str) -> str:
    """Text whose UTF-8 bytes were read as a one-byte code, read right again."""
    if "Ã" in text or "Â" in text or "â€" in text:
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return text


def plain(text: str) -> str:
    """Text without markup, entities, accents and case."""
    text = _TAG.sub("", html.unescape(html.unescape(_unspoilt(text))))
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def title_words(title: str | None) -> list[str]:
    """Words of a title in order; a run of ideographs gives its character pairs. A shortened word keeps its full stop."""
    out: list[str] = []
    if not title:
        return out
    cutoff = re.sub(r"\s*(\.\.\.|…)\s*$", "…", title.strip())
    for w in _WORD.findall(plain(cutoff.replace("…", " "))):
        if "㐀" <= w[0] <= "﫿":
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
            continue
        short = w.endswith(".")
        w = w.rstrip(".")
        w = re.sub(r"is(ation|ations|e|ed|ing|es)$", r"iz\1", w) if len(w) > 6 else w
        w = re.sub(r"ogue(s?)$", r"og\1", w) if len(w) > 6 else w
        w = SAME_WORD.get(w, w)
        if w:
            out.append(w + "." if short and len(w) < 9 else w)
    if out and cutoff.endswith("…"):
        out[-1] = out[-1].rstrip(".") + "…"
    elif out and len(out[-1]) > 5:  # the title's own full stop
        out[-1] = out[-1].rstrip(".")
    return out


def doi_key(doi: str | None) -> str | None:
    """A DOI as it is compared: without resolver, scheme, query and case; null if it doesn't look like one."""
    if not doi:
        return None
    d = re.sub(r"^(https?://[^/]*/+|doi:\s*)", "", doi.strip().lower())
    d = re.split(r"[?#]", d)[0].strip().strip("/")
    return d if d.startswith("10.") else None


def _words_frame(df: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """``key``, the ``carry`` columns, ``words`` and ``doi_k`` of each row of (key, carry..., title, doi)."""
    schema = T.StructType([df.schema[key], *(df.schema[c] for c in carry), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("doi_k", T.StringType())])
    names = [key, *carry, "words", "doi_k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(carry) + 1
            words = pa.array([title_words(t.as_py()) for t in b.column(n)], pa.list_(pa.string()))
            dois = pa.array([doi_key(t.as_py()) for t in b.column(n + 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], words, dois], names=names)

    return df.select(key, *carry, "title", "doi").mapInArrow(run, schema)


def papers(detail: DataFrame) -> DataFrame:
    """One row per paper: the latest value of each attribute that isn't null. Papers without id are left out; ids are the same whatever their letter case."""
    def last(c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), F.col("fetched_at")))

    flat = detail.select("paper_id", "title", "year", "external_ids.doi", "external_ids.dblp", F.coalesce("fetched_at", F.lit(0).cast("timestamp")).alias("fetched_at"))
    attributes = [last(F.col(c)).alias(c) for c in ("title", "year", "doi", "dblp")]
    one = flat.where("paper_id <> ''").groupBy(F.lower("paper_id").alias("_id")).agg(F.min("paper_id").alias("paper_id"), *attributes)
    return _words_frame(one, "paper_id", ["year", "dblp"]).withColumn("dblp", F.nullif(F.trim("dblp"), F.lit("")))


def publications(pubs: DataFrame) -> DataFrame:
    flat = pubs.select("element_id", "year", F.col("dblp_key").alias("dblp"), "title", "doi").where("element_id is not null")
    return _words_frame(flat, "element_id", ["year", "dblp"]).withColumn("dblp", F.nullif(F.trim("dblp"), F.lit("")))


def _hash(words: Column, seed: int) -> Column:
    return F.when(F.size(words) > 0, F.xxhash64(F.lit(seed), words))


def _titles(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``key``, the hash of its words (null without words), and ``key``, ``words``, ``clash`` of each different
    title; ``clash`` if two titles have one hash, then all must be hashed anew."""
    mine = df if seed == 0 else df.withColumn(key, _hash(F.col("words"), seed))
    proof = F.xxhash64(F.lit(-1), "words")
    one = mine.where(F.col(key).isNotNull()).groupBy(key).agg(F.first("words").alias("words"), (F.min(proof) != F.max(proof)).alias("clash"))
    return mine, cut(one)


def _deletes(word: str) -> Column:
    """The word and the word less each of its characters: two words one edit or one swap apart share one of these."""
    return F.array_distinct(_less_one(F.col(word)))


def _less_one(w: Column) -> Column:
    """The word and the word less each of its characters, of a word of at least one."""
    return F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, "[.…]$", "")


def vocabulary(titles: DataFrame) -> DataFrame:
    """``word``, ``df``: in how many different titles each word is."""
    return titles.select(F.explode(F.array_distinct(F.transform("words", _bare))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def corrections(unknown: DataFrame, vocab: DataFrame) -> DataFrame:
    """``word``, ``as_word``, ``df``: known words that an unknown one may be misspelt from, as ``near`` has it.

    A join of the two vocabularies on their deletion neighbourhoods (of two deletions, for words of more than five
    characters), exact for words of 4 to 64 characters; titles take no part.
    """
    def keys(df: DataFrame, w: str) -> DataFrame:
        less = F.when(F.length(w) > 5, F.array_distinct(F.flatten(F.transform(_deletes(w), _less_one)))).otherwise(_deletes(w))
        return df.where(F.length(w).between(4, WORD)).withColumn("d", F.explode(F.transform(less, lambda x: F.xxhash64(x))))

    # the planner doesn't see how much longer the exploded side is than its table
    met = keys(unknown.select("word"), "word").join(keys(vocab.select(F.col("word").alias("as_word"), "df"), "as_word").hint("merge"), "d").select("word", "as_word", "df").distinct()
    same_letters = F.array_sort(F.split("word", "")) == F.array_sort(F.split("as_word", ""))
    edits, shorter = F.levenshtein("word", "as_word", 2), F.least(F.length("word"), F.length("as_word"))
    return met.where(edits.between(0, 1) | ((edits == 2) & (same_letters | (shorter > 5))))


def forms_of(forms: DataFrame, vocab: DataFrame, n: float) -> DataFrame:
    """``form``, ``known``, ``weight``, ``alts``: what each form of a query word weighs and the titles' words it may stand for.

    ``forms`` (``form``, ``word``, ``last``, ``dot``): the word without its stop, whether it ends its title (which may be
    cut), whether it is shortened. A known word stands for itself; an unknown one for its ``corrections`` and, if it is
    two known words run together, for the first of these, or a shortened plural (nets), for its long forms; a shortened or last one for all words it begins, too. The
    weight is the idf of the rarest of them, of a beginning that of all together; without any an unknown word weighs
    most; a last word of fewer than SHORT letters weighs nothing. ``alts`` is null where there are more than WIDE: such a word is never looked up and counts as there.
    """
    idf = lambda df: F.log((F.lit(n) - df + 0.5) / (df + 0.5) + 1)
    v = vocab.select(F.col("word").alias("as_word"), "df")
    f = cut(forms.join(vocab, "word", "left").withColumn("known", F.col("df").isNotNull()))
    own = f.where("known").select("form", F.col("word").alias("as_word"), "df", F.lit(0).alias("how"))
    lost = f.where("not known").select("word").distinct()
    fixed = f.where("not known").select("form", "word").join(corrections(lost, vocab), "word").select("form", "as_word", "df", F.lit(1).alias("how"))
    starts = v.where(F.length("as_word") <= WORD).select("as_word", "df", F.explode(F.transform(F.sequence(F.lit(SHORT), F.length("as_word")), lambda i: F.substring("as_word", F.lit(1), i))).alias("word"))
    starts = starts.where(F.length("word") >= SHORT).hint("merge")
    open_ = f.where((F.col("last") | F.col("dot")) & (F.length("word") >= SHORT))
    begun = open_.select("form", "word").join(starts, "word").select("form", "as_word", "df", F.lit(2).alias("how"))
    plural = f.where(~F.col("known") & F.endswith("word", F.lit("s")) & (F.length("word") > SHORT)).select("form", F.expr("substring(word, 1, length(word) - 1)").alias("word"))
    plural = plural.join(starts.where(F.endswith("as_word", F.lit("s"))).hint("merge"), "word").select("form", "as_word", "df", F.lit(1).alias("how"))
    w = F.col("word")
    torn = lost.where(F.length("word").between(7, WORD)).select("word", F.explode(F.transform(F.sequence(F.lit(2), F.length("word") - 2), lambda i: F.struct(F.substring(w, F.lit(1), i).alias("as_word"), F.substring(w, i + 1, F.length(w)).alias("rest")))).alias("t"))
    torn = torn.select("word", "t.as_word", "t.rest").join(v, "as_word").join(vocab.select(F.col("word").alias("rest")), "rest", "left_semi")
    split = f.where("not known").select("form", "word").join(torn, "word").select("form", "as_word", "df", F.lit(1).alias("how"))
    every = cut(own.unionByName(fixed).unionByName(begun).unionByName(plural).unionByName(split).groupBy("form", "as_word").agg(F.max("df").alias("df"), F.min("how").alias("how")))
    per = every.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("how") < 2, F.col("df"))).alias("rarest"), F.least(F.sum("df"), F.lit(n)).alias("all"))
    few = every.join(per.where(F.col("n") <= WIDE).select("form"), "form", "left_semi").groupBy("form").agg(F.collect_list("as_word").alias("alts"))
    got = f.join(per, "form", "left").join(few, "form", "left")
    weight = (
        F.when(F.col("last") & (F.length("word") < SHORT), F.lit(0.0)).when(F.col("rarest").isNotNull(), idf(F.col("rarest"))).when(F.col("n").isNotNull(), idf(F.col("all")))
        .when(F.col("dot"), F.lit(math.log(n + 1) / 2)).otherwise(F.lit(math.log(n + 1)))
    )
    alts = F.when(F.col("n").isNull(), F.array().cast("array<string>")).otherwise(F.col("alts"))
    return got.select("form", "known", weight.cast("double").alias("weight"), alts.alias("alts"))


def query_slots(queries: DataFrame, vocab: DataFrame, n: float) -> DataFrame:
    """``tq``, ``words``, ``slots``: per title of a query its words' ``forms_of``, in order.

    Two neighbours of which one is unknown and which run together make a known word stand for that, too.
    """
    occ = queries.select("tq", F.size("words").alias("n"), F.posexplode("words").alias("pos", "w"))
    occ = occ.select("tq", "pos", _bare(F.col("w")).alias("word"), (F.col("pos") == F.col("n") - 1).alias("last"), F.rlike("w", F.lit("[.…]$")).alias("dot"))
    occ = occ.withColumn("form", F.concat_ws("|", "word", F.col("last").cast("string"), F.col("dot").cast("string")))
    forms = cut(forms_of(occ.select("form", "word", "last", "dot").distinct(), vocab, n))
    slot = skew_join(occ.select("tq", "pos", "form"), forms, "form", "inner", unique=True).select("tq", F.struct("pos", "known", "weight", "alts").alias("s"))
    per = cut(queries.join(slot.groupBy("tq").agg(F.sort_array(F.collect_list("s")).alias("slots")), "tq"))
    pair = F.transform(F.sequence(F.lit(0), F.size("slots") - 2), lambda i: F.when(~(F.get("slots", i)["known"] & F.get("slots", i + 1)["known"]), F.struct(i.alias("i"), F.concat(_bare(F.get("words", i)), _bare(F.get("words", i + 1))).alias("word"))))
    run = per.where(F.size("slots") > 1).select("tq", F.explode(F.array_compact(pair)).alias("x")).select("tq", "x.i", "x.word").join(vocab.select("word"), "word", "left_semi")
    more = run.groupBy("tq").agg(F.collect_list(F.struct("i", "word")).alias("more"))

    def joined(s: Column) -> Column:
        mine = F.transform(F.filter("more", lambda m: (m["i"] == s["pos"]) | (m["i"] + 1 == s["pos"])), lambda m: m["word"])
        return F.struct(s["pos"].alias("pos"), s["known"].alias("known"), s["weight"].alias("weight"), F.concat(s["alts"], mine).alias("alts"))

    whole = per.join(more, "tq", "left")
    return cut(whole.select("tq", "words", F.when(F.col("more").isNull(), F.col("slots")).otherwise(F.transform("slots", joined)).alias("slots")))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


_M1, _M2, _ALL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), (1 << 64) - 1


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The list's key of two words (of one word if both are the same), whatever their order."""
    with np.errstate(over="ignore"):
        return ((np.minimum(a, b) * _M1) ^ (np.maximum(a, b) * _M2 + _M1)).view(np.int64)


def _key_of(a: int, b: int) -> int:
    """``_pair_key`` of two single words."""
    x = ((min(a, b) * int(_M1)) ^ (max(a, b) * int(_M2) + int(_M1))) & _ALL
    return x - (1 << 64) if x >> 63 else x


def _bits(h: int) -> tuple[int, int]:
    """A word's bit among 128, as two longs."""
    b = (h >> 32) & 127
    x = 1 << (b & 63)
    x -= (1 << 64) if x >> 63 else 0
    return (x, 0) if b < 64 else (0, x)


def postings(titles: DataFrame) -> DataFrame:
    """``k``, ``td``, ``sx``, ``sy``: each title under each of its words and each pair of them, with the bits of all its words.

    A title of more than LONG words is under its words only, in lists of their own that every query looks up, too.
    """
    kind = T.StructType([T.StructField("td", T.LongType()), T.StructField("sx", T.LongType()), T.StructField("sy", T.LongType()), T.StructField("ks", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, int] = {}
        upper = {n: np.triu_indices(n) for n in range(LONG + 1)}
        for b in batches:
            xs, ys, ks = [], [], []
            for ws in b.column(1).to_pylist():
                ws = list({w.rstrip(".…") for w in ws})
                x = y = 0
                for w in ws:
                    if w not in hashes:
                        if len(hashes) > 500_000:
                            hashes.clear()
                        hashes[w] = _word_hash(w)
                    p, q = _bits(hashes[w])
                    x, y = x | p, y | q
                h = np.array([hashes.get(w) or _word_hash(w) for w in ws], np.uint64)
                if len(ws) > LONG:
                    key = _pair_key(h, ~h)
                else:
                    i, j = upper[len(ws)]
                    key = _pair_key(h[i], h[j])
                xs.append(x)
                ys.append(y)
                ks.append(key)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(ks, pa.list_(pa.int64()))], names=kind.names)

    return titles.select("td", "words").mapInArrow(run, kind).select("td", "sx", "sy", F.explode("ks").alias("k"))


def lookups(slots: list[dict], floor: float) -> tuple[set[tuple[str, ...]], float]:
    """The lists one query looks up (one or two words each), and the weight that what is on them must reach.

    Its words in an order of falling weight, but neighbours apart (they mostly come together and would make long lists):
    a title that reaches ``floor`` of the query's weight has a first and a second word in that order, and what stands
    before them and between them must be light enough to be missing. So every such title is on one of the lists.
    """
    goal = floor * sum(s["weight"] for s in slots) - 1e-9 - sum(s["weight"] for s in slots if s["alts"] is None)
    left = sorted((s for s in slots if s["alts"] and s["weight"] > 0), key=lambda s: (-s["weight"], s["pos"]))
    order: list[dict] = []
    while left:
        at = next((i for i, s in enumerate(left) if not order or abs(s["pos"] - order[-1]["pos"]) > 2), 0)
        order.append(left.pop(at))
    rest = [0.0]
    for s in reversed(order):
        rest.append(rest[-1] + s["weight"])
    rest.reverse()
    out: set[tuple[str, ...]] = set()
    for i, s in enumerate(order):
        if rest[i] < goal:
            break
        if s["weight"] >= goal:  # one word is enough
            out.update((a,) for a in s["alts"])
            continue
        for j in range(i + 1, len(order)):
            if s["weight"] + rest[j] < goal:
                break
            out.update((a, b) if a < b else (b, a) for a in s["alts"] for b in order[j]["alts"])
        # one of the titles' words can stand for several of the query's, then there is no second one
        out.update((a,) for a in s["alts"] if sum(x["weight"] for x in order[i:] if a in x["alts"]) >= goal)
    return out, goal


def _query_keys(slots: DataFrame, floor: float) -> DataFrame:
    """``tq``, ``k`` of each list a query looks up, with ``goal`` and its heaviest words' weights and bits (``mi``, ``mx``, ``my``)."""
    kind = T.StructType(
        [T.StructField("tq", T.LongType()), T.StructField("goal", T.DoubleType()), T.StructField("mi", T.ArrayType(T.FloatType())), T.StructField("mx", T.ArrayType(T.LongType())), T.StructField("my", T.ArrayType(T.LongType())), T.StructField("ks", T.ArrayType(T.LongType()))]
    )
    types = [pa.int64(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = lru_cache(maxsize=200_000)(_word_hash)
        for b in batches:
            rows: list[tuple] = []
            for tq, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, goal = lookups(slots, floor)
                if not found:
                    continue
                pairs = {(hash_of(k[0]), hash_of(k[-1])) for k in found}
                ks = list({_key_of(a, z) for a, z in pairs} | {_key_of(h, h ^ _ALL) for p in pairs for h in p})
                heavy = sorted((s for s in slots if s["alts"] and s["weight"] > 0), key=lambda s: -s["weight"])
                bits = []
                for s in heavy[:TERMS]:
                    each = [_bits(hash_of(w)) for w in s["alts"]]
                    bits.append((reduce(or_, (x for x, _ in each)), reduce(or_, (y for _, y in each))))
                # the lightest words beyond TERMS count as there; rounding to single precision is allowed for
                goal -= sum(s["weight"] for s in heavy[TERMS:]) + 1e-4
                rows.append((tq, goal, [s["weight"] for s in heavy[:TERMS]], [x for x, _ in bits], [y for _, y in bits], ks))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=kind.names)

    return slots.select("tq", "slots").mapInArrow(run, kind).select("tq", "goal", "mi", "mx", "my", F.explode("ks").alias("k"))


def candidates(slots: DataFrame, titles: DataFrame, floor: float) -> DataFrame:
    """``tq``, ``td``: each pair of titles that can share ``floor`` of the query's weight (a superset, see ``lookups``).

    The join drops at once what the words' bits show to fall short; one word's bit can stand for another, so never less
    is counted than there is. A list that is looked up by many queries is split by the adaptive skew join.
    """
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    bound = sum((F.when(at("mx", i).bitwiseAND(F.col("sx")).bitwiseOR(at("my", i).bitwiseAND(F.col("sy"))) != 0, at("mi", i)).otherwise(F.lit(0.0)) for i in range(TERMS)), F.lit(0.0))
    met = _query_keys(slots, floor).hint("merge").join(postings(titles).hint("merge"), "k").where(bound >= F.col("goal"))
    return met.select("tq", "td").distinct()


def near(a: str, b: str, unknown: bool = False) -> bool:
    """Whether two different words are one edit or one swap apart; two for words of more than nine characters, and for
    those of more than five if ``a`` is no known word."""
    la, lb = len(a), len(b)
    most = 2 if min(la, lb) > (5 if unknown else 9) else 1
    if abs(la - lb) > most or min(la, lb) < 4 or max(la, lb) > WORD:
        return False
    i = 0
    while i < la and i < lb and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) <= 1 or (len(a) == len(b) == 2 and a == b[::-1]):
        return True
    return most == 2 and (max(len(a), len(b)) <= 2 or (max(len(a), len(b)) <= 9 and _edits(a, b) <= 2))


def _edits(a: str, b: str) -> int:
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            prev, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, prev + (x != y))
    return rows[-1]


def align(query: list[str], doc: list[str], unknown: list[bool]) -> tuple[list[bool], int]:
    """Which query words the document has, allowing for typing errors, shortened words and a cut end; and how many of
    the document's words no query word took. ``unknown``: per query word, whether it is in no document at all; a known word
    stands for nothing else."""
    left: dict[str, int] = {}
    for w in doc:
        w = w.rstrip(".…")
        left[w] = left.get(w, 0) + 1
    hit = [False] * len(query)
    open_: list[int] = []
    for i, w in enumerate(query):
        x = w.rstrip(".…")
        if left.get(x, 0):
            left[x] -= 1
            hit[i] = True
        else:
            open_.append(i)
    last = len(query) - 1
    for i in open_:
        w = query[i]
        x = w.rstrip(".…")
        open_end = w != x or i == last
        for d, n in left.items():
            if n and ((unknown[i] and near(x, d, True)) or (open_end and len(x) >= SHORT and d.startswith(x)) or (unknown[i] and len(x) > SHORT and x[-1] == d[-1] == "s" and d.startswith(x[:-1]))):
                left[d] -= 1
                hit[i] = True
                break
        else:
            # a word run together with, or torn from, its neighbour
            if i < last and not hit[i + 1] and (unknown[i] or unknown[i + 1]) and left.get(x + query[i + 1].rstrip(".…"), 0):
                left[x + query[i + 1].rstrip(".…")] -= 1
                hit[i] = hit[i + 1] = True
            elif len(x) > 6 and unknown[i]:
                for d, n in left.items():
                    rest = x[len(d) :] if n and x.startswith(d) else None
                    if rest and left.get(rest, 0):
                        left[d] -= 1
                        left[rest] -= 1
                        hit[i] = True
                        break
    return hit, sum(left.values())


_TITLE = T.StructType([T.StructField("tq", T.LongType()), T.StructField("td", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("score", "own", "share", "missing", "spare")])
#: The attributes of an option the confidence is a function of; ``gap`` is the score gap to the runner-up.
FEATURES = ("gap", "gap_words", "weight", "share", "missing", "spare", "years", "year_known")


def _aligned(pairs: DataFrame, mean_words: float) -> DataFrame:
    """BM25 of each pair of titles, the share of the query's weight in it, the query's words it lacks, and the share of
    the paper's words no query word took; one pass in record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _TITLE.fields]
            for tq, td, words, weights, known, doc in zip(*(c.to_pylist() for c in b.columns)):
                hit, spare = align(words, doc, [not k for k in known])
                sat = (K1 + 1) / (1 + K1 * (1 - B + B * len(doc) / mean_words))
                own = sum(weights)
                got = sum(w for w, x in zip(weights, hit) if x)
                lacks = sum(1 for w, x in zip(weights, hit) if not x and w > 0)
                for c, x in zip(cols, (tq, td, got * sat, own, got / own if own else 0.0, float(lacks), spare / len(doc))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(cols)], names=_TITLE.names)

    return pairs.select("tq", "td", "words", "weights", "known", "d_words").mapInArrow(run, _TITLE)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by Newton steps; 0 rows give zeros."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _named(queries: DataFrame, docs: DataFrame, column: str, n: float) -> DataFrame:
    """``queries`` with ``w_<column>``, the idf of their identifier (null if no paper has it), and ``p_<column>``, the papers
    that have it. Of papers alike in identifier and year two are enough (they tie), so there are two a year at most."""
    of_year = docs.where(F.col(column).isNotNull()).groupBy(column, "year").agg(F.min("paper_id").alias("a"), F.max("paper_id").alias("b"), F.count(F.lit(1)).alias("n"))
    per = of_year.groupBy(column).agg(F.least(F.sum("n"), F.lit(n)).alias("n"), F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias(f"p_{column}"))
    idf = F.log((F.lit(n) - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1)
    return skew_join(queries, per.select(column, idf.alias(f"w_{column}"), f"p_{column}"), column, "left", unique=True)


def _ranked(options: DataFrame, ident: float, least: float) -> DataFrame:
    """``options`` with their places by the whole score (``pick``) and by what words and year say (``pick_t``), and leads.

    Ties go to the nearer year, then the lesser id. ``gap``: BM25 of words and year above the best other option's (at least
    the floor, which all that was not looked up is below); ``gap_words``: the same of the words alone. These and
    ``weight``, the query's own, are counted in what a word that is in one title weighs (``ident``), so that few common
    words say little.
    """
    q = Window.partitionBy("q")
    floor = F.least(F.col("score"), least * F.col("own"))
    w = options
    for name, s in (("pick", F.col("score") + F.col("of_year") + F.col("of_ids")), ("pick_t", F.col("score") + F.col("of_year"))):
        w = w.withColumn(name, F.row_number().over(q.orderBy(s.desc(), F.col("years"), F.col("paper_id"))))
    for name, s in (("gap", F.col("score") + F.col("of_year")), ("gap_words", F.col("score"))):
        order = q.orderBy(s.desc(), F.col("years"), F.col("paper_id"))
        other = F.when(F.row_number().over(order) == 1, F.lead(s).over(order)).otherwise(F.first(s).over(order))
        w = w.withColumn(name, (s - F.greatest(F.coalesce(other, floor), floor)) / ident)
    return w.withColumn("weight", F.least(F.col("own") / ident, F.lit(2.0)))


def match(detail: DataFrame, pubs: DataFrame, floor: float = FLOOR, confidence: float = 0.6, labelled: int = LABELLED) -> DataFrame:
    """``paper_id``, ``element_id``, ``confidence``: pairs that are the same work; a publication has at most one.

    Publications alike in all attributes are one query; titles alike in their words are aligned once, and of papers alike
    in words and year, or in identifier and year, only two take part (they tie). A publication without title words is matched
    by identifier only, one without identifiers by title only. An identifier that many papers have weighs less, and
    title and year tell its papers apart. Equal scores: the gap is 0 and the confidence low. Nearest to a paper are
    the publications of the greatest share; one that comes behind a publication nearer to another paper isn't the
    paper's. Empty tables give no rows. Null titles, years and identifiers are absent evidence.
    """
    def slim(df: DataFrame, key: str) -> DataFrame:  # identifiers are compared by their hashes
        ids = {c: F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in ("doi_k", "dblp")}
        return df.withColumns({**ids, key: _hash(F.col("words"), 0)})

    all_docs, all_rows = cut(slim(papers(detail), "td")), cut(slim(publications(pubs), "tq"))
    for seed in range(100):
        docs, titles = _titles(all_docs, "td", seed)
        rows, asked = _titles(all_rows, "tq", seed)
        both = titles.select("clash", F.size("words").alias("m")).unionByName(asked.select("clash", F.lit(None).cast("int").alias("m")))
        size = both.agg(F.count("m").alias("n"), F.avg("m").alias("m"), F.max("clash").alias("clash")).first()
        if not size["clash"]:
            break
    titles, asked = titles.drop("clash"), asked.drop("clash")
    rows = rows.withColumn("q", F.xxhash64(*(F.coalesce(c, F.lit(-1)) for c in ("tq", "year", "dblp", "doi_k"))))
    vocab = cut(vocabulary(titles))
    years = docs.groupBy("year").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("year").isNotNull(), F.col("n"))).alias("n"), F.sum(F.when(F.col("year").isNotNull(), F.col("n") * F.col("n"))).alias("nn")).first()
    n, mean = float(max(1, size["n"])), float(size["m"] or 1.0)
    ident = math.log(n + 1.0)
    of_year = math.log(1 + years["n"] ** 2 / years["nn"]) if years["n"] else 0.0  # the mean idf of a year

    slots = query_slots(asked, vocab, n)
    queries = rows.groupBy("q").agg(*(F.first(c).alias(c) for c in ("tq", "year", "dblp", "doi_k")))
    queries = cut(_named(_named(queries, docs, "doi_k", years["all"] or 0.0), docs, "dblp", years["all"] or 0.0))
    named = queries.select("q", F.explode(F.array_distinct(F.concat(*(F.coalesce(f"p_{c}", F.array().cast("array<string>")) for c in ("doi_k", "dblp"))))).alias("paper_id"))
    queries = queries.drop("p_doi_k", "p_dblp")
    record = docs.select("paper_id", "td", *(F.col(c).alias(f"d_{c}") for c in ("year", "dblp", "doi_k")))
    told = cut(named.join(record, "paper_id").join(queries, "q"))

    met = candidates(slots, titles, floor).unionByName(told.where("tq is not null and td is not null").select("tq", "td")).distinct()
    text = slots.select("tq", "words", F.transform("slots", lambda s: s["weight"]).alias("weights"), F.transform("slots", lambda s: s["known"]).alias("known"))
    aligned = cut(_aligned(met.join(titles.withColumnRenamed("words", "d_words"), "td").join(text, "tq"), mean))
    good = aligned.where(F.col("share") >= floor - 1e-9)

    # papers of one title and year tie: two of them say so
    group = docs.where("td is not null").groupBy("td", F.col("year").alias("d_year")).agg(F.min(F.struct("paper_id", "dblp", "doi_k")).alias("a"), F.max(F.struct("paper_id", "dblp", "doi_k")).alias("b"))
    group = group.select("td", "d_year", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("td", "d_year", "x.paper_id", F.col("x.dblp").alias("d_dblp"), F.col("x.doi_k").alias("d_doi_k"))
    option = good.join(queries, "tq").join(group, "td")
    by_name = told.join(aligned, ["tq", "td"], "left").fillna(0.0, ["score", "share", "missing", "spare"])
    whole = slots.select("tq", F.aggregate("slots", F.lit(0.0), lambda acc, s: acc + s["weight"]).alias("whole"))
    by_name = by_name.join(whole, "tq", "left").withColumn("own", F.coalesce("own", "whole", F.lit(ident)))

    def option_of(df: DataFrame) -> DataFrame:
        """What an option's place and confidence depend on."""
        gap = F.when(F.col("year").isNotNull() & F.col("d_year").isNotNull(), F.least(F.abs(F.col("year") - F.col("d_year")), F.lit(9))).cast("double")
        same = {c: F.when(F.col(c).isNotNull() & F.col(f"d_{c}").isNotNull(), F.col(c) == F.col(f"d_{c}")) for c in ("doi_k", "dblp")}
        of = sum((F.when(same[c], F.coalesce(f"w_{c}", F.lit(0.0))).otherwise(F.lit(0.0)) for c in same), F.lit(0.0))
        year = F.when(gap == 0, F.lit(of_year)).otherwise(F.lit(0.0))
        return df.select(
            "q", "paper_id", *(F.col(c).cast("double").alias(c) for c in ("score", "own", "share", "missing", "spare")), F.coalesce(gap, F.lit(0.0)).alias("years"), gap.isNotNull().cast("double").alias("year_known"),
            same["doi_k"].cast("int").alias("same_doi"), same["dblp"].cast("int").alias("same_dblp"), of.alias("of_ids"), year.alias("of_year"),
        )

    every = option_of(option).unionByName(option_of(by_name)).repartition("q").dropDuplicates(["q", "paper_id"])
    every = cut(_ranked(every, ident, floor))
    w, of_id = _calibrated(every, labelled)
    z = sum((F.lit(float(a)) * F.col(c) for a, c in zip(w, FEATURES)), F.lit(float(w[-1]))) + of_id * (F.coalesce("same_doi", F.lit(0)) + F.coalesce("same_dblp", F.lit(0)))
    # mutual: among all options of the paper, none that is nearer to another paper comes before this publication
    near_to = F.least(F.lit(1.0), F.col("share") + F.col("of_ids") / F.greatest("own", F.lit(1e-9)))
    mine = every.where("pick = 1").select("q", "paper_id", near_to.alias("near"), (1 / (1 + F.exp(-z))).alias("confidence")).where(F.col("confidence") >= confidence)
    other = every.where("pick > 1").groupBy("paper_id").agg(F.max(near_to).alias("other"))
    kept = mine.join(other, "paper_id", "left").where(F.col("other").isNull() | (F.col("near") >= F.col("other")))
    return skew_join(rows.select("q", "element_id"), kept.select("q", "paper_id", "confidence"), "q", "inner", unique=True).select("paper_id", "element_id", "confidence")


def _calibrated(every: DataFrame, labelled: int) -> tuple[np.ndarray, float]:
    """The logistic's weights, and what each identifier that names the paper adds to it.

    The weights are fitted on what words and year say of at most ``labelled`` queries, in hash order, each labelled by
    whether an identifier of its first option agrees (all those that both sides have differ: it is another work). An
    identifier's part are the log odds that it is right, from how often the two of a query name one paper.
    """
    seen = every.where("pick_t = 1").withColumn("label", F.greatest("same_doi", "same_dblp").cast("double")).where("label is not null")
    sample = seen.orderBy(F.xxhash64("q"), "q").limit(labelled).select(*FEATURES, "label").collect()
    x = np.array([[r[c] for c in FEATURES] for r in sample], float).reshape(-1, len(FEATURES))
    told = every.groupBy("q").agg(F.max("same_doi").alias("a"), F.max("same_dblp").alias("b"), F.max(F.col("same_doi") * F.col("same_dblp")).alias("ab")).where("a > 0 and b > 0")
    agree = told.agg(F.sum(F.coalesce("ab", F.lit(0))).alias("yes"), F.count(F.lit(1)).alias("n")).first()
    yes, n = agree["yes"] or 0, agree["n"]
    if len({r["label"] for r in sample}) < 2:  # nothing to learn from: all of the title's weight and a lead, or an identifier
        return np.array([2.0, 2.0, 1.0, 8.0, -1.0, 0.0, -0.5, 0.0, -9.0]), 12.0
    return fit_logistic(x, np.array([r["label"] for r in sample], float)), math.log((yes + 19) / ((n - yes) / 2 + 1))
