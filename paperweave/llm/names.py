"""Variant spellings of the names of one person or group, linked.

Names are read into family name, given name or initial, and middle initial; which end of a plain name is the family name
is told from how its words are used elsewhere. Misspelt names are found by MinHash banding over padded q-grams, with the
number of bands tuned from the collision curve, verified by Monge-Elkan similarity, and attached to the most frequent
spelling (star clustering). Records are then attached to stars again: a star is a person, told from others of the same
name by institution; full names, short forms and initials join it by equi-keys only, so no pairs within a name are made.

The joins are of distinct profiles and spellings; a family name that holds a third of them is split by the adaptive skew
join, and all per-name choices (the only star, the least label) are aggregates combined map-side.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .match import _deletes, _less_one

#: Q-gram length and recall wanted of the banding.
Q, RECALL = 2, 0.99
#: Rows per band, and the q-gram similarity that a swap leaves at least: of family names of nine letters, of given names.
#: Shorter ones and what the bands miss are met by shared deletions.
FAMILY_BANDS, GIVEN_BANDS = (5, 0.54), (3, 0.4)
#: A given name is a misspelling only if its star is so many times as frequent.
GIVEN_RATIO = 5
#: Monge-Elkan similarity of a misspelt name to the spelling it is attached to, at least: by default what the edits
#: allowed leave in words of its length.
ALIKE = None
#: Fewest letters of a family name's word in which an edit is taken as a misspelling; below, names one edit apart are
#: mostly different ones (Wang, Yang).
SHORTEST = 5

#: Words that don't name an institution.
INSTITUTION_WORDS = frozenset(
    "university universitat universite universidad universita univ u uni of the institute institut instituto inst technology tech it school computing national natl "
    "laboratory laboratories lab labs at and for college department dept center centre visiting scholar faculty science sciences engineering research group inc ltd".split()
)
#: Words that name a kind of group, and their short forms.
GROUP_WORDS = {
    "collaboration": "collaboration", "collab": "collaboration", "consortium": "consortium", "consort": "consortium", "working": "working group", "group": "working group",
    "wg": "working group", "observatory": "observatory team", "obs": "observatory team", "team": "observatory team", "project": "project", "network": "network", "committee": "committee",
}
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})
_WORD = re.compile(r"[^\W\d_]+(?:['’`-][^\W\d_]+)*\.?")
_NUMBER = re.compile(r"\s+(\d{3,4})\s*$")


def fold(text: str) -> str:
    """Text without case and accents; bytes read in a wrong code are read again."""
    if "Ã" in text or "Â" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    text = unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD)
    return "".join(c for c in text if not unicodedata.combining(c))


def _parts(text: str) -> list[str]:
    """Words of a name; two run together (a capital after three small letters) count as two."""
    text = re.sub(r"(?<=[^\W\d_A-Z]{3})(?=[A-Z][^\W\d_A-Z]{2})", " ", text)
    return [w for w in (x.rstrip(".") for x in _WORD.findall(text.replace(".", ". "))) if w]


def _initials(raw: str, word: str) -> bool:
    """Whether a word of a name stands for initials: one letter, or two capitals with a full stop."""
    return len(word) == 1 or (len(word) == 2 and word.isupper() and not raw.isupper())


def read_name(name: str | None) -> tuple[str, str, str, str, bool]:
    """Family name, given name or initial, middle initial, shape, and whether the family name's place is certain.

    Shapes: ``group`` (family is the group's own name, given its kind), ``full``, ``initial``, ``single`` and ``none``
    (no letters; the name as written is its own family name). All parts are folded.
    """
    raw = _NUMBER.sub("", name or "").strip()
    words = _parts(raw)
    low = [fold(w) for w in words]
    kinds = [GROUP_WORDS[w] for w in low if w in GROUP_WORDS]
    if kinds and len(words) > 1:
        own = [p for w in low for p in re.split(r"['’`-]", w) if p and p not in GROUP_WORDS and p not in ("the", "of", "for", "and")]
        hyphen = [GROUP_WORDS[p] for w in low for p in w.split("-") if p in GROUP_WORDS]
        return " ".join(own), (kinds or hyphen)[0], "", "group", True
    split = [p for w in low for p in w.split("-")]
    if len(split) > 1 and any(p in GROUP_WORDS for p in split):
        return " ".join(p for p in split if p not in GROUP_WORDS and p != "the"), next(GROUP_WORDS[p] for p in split if p in GROUP_WORDS), "", "group", True
    if not words:
        return fold(raw), "", "", "none", True
    if len(words) == 1:
        return low[0], "", "", "single", True
    if "," in raw:
        a, b = raw.split(",", 1)
        fam, rest = _parts(a), _parts(b)
        if fam and rest:
            return _person(raw, [fold(w) for w in fam], rest, True)
    sure = False
    if _initials(raw, words[-1]) and not _initials(raw, words[0]):
        # Family X, Family XY. or Family Given X
        k = 1 if len(words) == 2 or all(_initials(raw, w) for w in words[1:]) else None
        return _person(raw, low[:1], words[1:], k is not None or len(words) == 3)
    if _initials(raw, words[0]) or any(_initials(raw, w) for w in words[1:-1]):
        sure = True
    return _person(raw, low[-1:], words[:-1], sure)


def _person(raw: str, family: list[str], given: list[str], sure: bool) -> tuple[str, str, str, str, bool]:
    full = [w for w in given if not _initials(raw, w)]
    letters = "".join(fold(w) if _initials(raw, w) else fold(w)[:1] for w in given)
    first = fold(full[0]) if full and not _initials(raw, given[0]) else letters[:1]
    return " ".join(family), first, letters[1:2], "full" if len(first) > 1 else "initial", sure


def places(affiliations: list | None, homepage: str | None) -> list[str]:
    """What tells a record's institutions: words of its affiliations and its homepage's host, and the homepage itself."""
    out: set[str] = set()
    for a in affiliations or []:
        out.update(w for w in re.findall(r"[^\W\d_]{3,}", fold(a or "")) if w not in INSTITUTION_WORDS)
    m = re.match(r"\s*(?:https?://)?([^/]+)/", (homepage or "") + "/")
    if m:
        out.add("page:" + re.sub(r"^https?://|/+$", "", fold(homepage.strip())))
        host = fold(m[1]).split(".")
        out.update(p for p in host[:-1] if len(p) > 3 and p not in ("people", "www", "home", "users", "pages", "staff") and p not in INSTITUTION_WORDS)
    return sorted(out)


_READ = T.StructType(
    [T.StructField("author_id", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("family", "given", "middle", "shape", "number", "other")]
    + [T.StructField("sure", T.BooleanType()), T.StructField("plain", T.BooleanType()), T.StructField("places", T.ArrayType(T.StringType()))]
)


def read_profiles(profiles: DataFrame) -> DataFrame:
    """Parsed names and institutions. The fullest name of ``dblp_name`` goes before ``name``; ``number`` is its suffix.

    ``plain``: a full name stands there without number, that is, nobody else there has it. ``other`` is the family name if a plain two-word name is the other way round. Null ids are left out; a null name
    without other names gives a record of shape ``none``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in _READ.fields]
            for r in b.to_pylist():
                names = [n for n in r["dblp_name"] or [] if n and n.strip()]
                number = next((m[1] for n in names if (m := _NUMBER.search(n))), None)
                first = read_name(r["name"])
                best = max((read_name(n) for n in names), key=lambda p: len(p[1]), default=None)
                if best is not None and best[3] in ("full", "initial") and len(best[1]) >= len(first[1]) or (first[3] == "none" and best is not None):
                    fam, giv, mid, shape, _ = best
                    sure = True
                    if not mid and first[2] and first[0] == fam:
                        mid = first[2]
                else:
                    fam, giv, mid, shape, sure = first
                plain = best is not None and best[3] == "full" and number is None
                other = giv if shape == "full" and not sure else None
                for c, x in zip(cols, (r["author_id"], fam, giv, mid, shape, number, other, sure, plain, places(r["affiliations"], r["homepage"]))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.list_(pa.string()) if f.name == "places" else pa.bool_() if f.name in ("sure", "plain") else pa.string()) for c, f in zip(cols, _READ)], names=_READ.names
            )

    return profiles.where("author_id is not null").select("author_id", "name", "homepage", "affiliations", "dblp_name").mapInArrow(run, _READ)


def bands_for(recall: float, similarity: float, rows: int) -> int:
    """Bands needed so that 1 - (1 - s^rows)^bands reaches the recall at similarity s."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def grams(text: str, q: int = Q) -> set[str]:
    """Padded q-grams: the ends of each word count."""
    return {p[i : i + q] for w in text.split() for p in ["#" * (q - 1) + w + "#" * (q - 1)] for i in range(len(p) - q + 1)}


def edits(a: str, b: str) -> int:
    """Edits and swaps of neighbours between two words."""
    if a == b:
        return 0
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, prev = prev, row
    return prev[-1]


def monge_elkan(a: str, b: str) -> float:
    """Mean over the words of each name of the likeness to the other's nearest word; the lesser of both directions."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0

    def like(u: str, v: str) -> float:
        return 1 - edits(u, v) / max(len(u), len(v))

    return min(sum(max(like(u, v) for v in y) for u in x) / len(x), sum(max(like(u, v) for u in x) for v in y) / len(y))


def allowed_edits(u: str, v: str) -> int:
    return 2 if min(len(u), len(v)) >= 10 else 1


def floor_of(x: list[str], y: list[str]) -> float:
    """The Monge-Elkan similarity that the edits allowed leave, word by word; none are in words of under SHORTEST letters."""
    return sum(1 - (allowed_edits(u, v) / max(len(u), len(v)) if min(len(u), len(v)) >= SHORTEST - 1 and max(len(u), len(v)) >= SHORTEST else 0) for u, v in zip(x, y)) / max(1, len(x))


def spelling_stars(spellings: DataFrame, rows: int, least: float, ratio: int = 2, recall: float = RECALL, alike: float | None = ALIKE) -> DataFrame:
    """``word``, ``star``: each misspelling in ``spellings`` (``word``, ``n``) and the spelling it is attached to.

    Candidates collide in one of ``bands_for(recall, least, rows)`` bands of MinHash values over padded q-grams, or share
    what deletions leave of them (exact for two edits or swaps in all, in spellings of at most 64 characters); a
    misspelling goes to the most similar candidate that is at least ``ratio`` times as frequent, ``alike`` by
    Monge-Elkan (by default ``floor_of``) and no more than one edit or swap a word away (two in words of ten or more characters). Stars keep their spelling, so a
    chain of misspellings doesn't drift. Within a band only the more frequent spellings meet rarer ones: a join of the
    distinct spellings, not of records.
    """
    bands = bands_for(recall, least, rows)
    rng = np.random.default_rng(17)
    mul = rng.integers(1, (1 << 61) - 1, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, (1 << 61) - 1, bands * rows, dtype=np.uint64)
    kind = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("band", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = np.array([xxhash.xxh64_intdigest(x) for x in sorted(grams(w))], np.uint64)
                if not len(g):
                    continue
                with np.errstate(over="ignore"):
                    low = ((g[:, None] * mul + add) >> np.uint64(3)).min(axis=0).reshape(bands, rows)
                for k, row in enumerate(low):
                    out[0].append(w)
                    out[1].append(n)
                    out[2].append(xxhash.xxh64_intdigest(row.tobytes(), k) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["word", "n", "band"])

    sig = spellings.select("word", F.col("n").cast("bigint").alias("n")).where(F.length("word") >= SHORTEST - 1).mapInArrow(run, kind)
    sig = cut(sig)
    rare = sig.select("word", "n", "band")
    # in a bucket, spellings of the same frequency can't attach to each other
    often = sig.where(F.col("n") >= ratio).select(F.col("word").alias("star"), F.col("n").alias("m"), "band")
    met = rare.hint("merge").join(often.hint("merge"), "band").where(F.col("m") >= ratio * F.col("n")).where(F.abs(F.length("word") - F.length("star")) <= 2).select("word", "star", "m")
    less = F.when(F.length("word") > 7, F.array_distinct(F.flatten(F.transform(_deletes("word"), _less_one)))).otherwise(_deletes("word"))
    left = spellings.where(F.length("word").between(4, 64)).select("word", F.col("n").cast("bigint").alias("n"), F.explode(less).alias("d"))
    stars = left.where(F.col("n") >= ratio).select(F.col("word").alias("star"), F.col("n").alias("m"), "d")
    met = met.unionByName(left.hint("merge").join(stars.hint("merge"), "d").where(F.col("m") >= ratio * F.col("n")).where(F.levenshtein("word", "star", 4) >= 0).select("word", "star", "m")).distinct()
    kept = T.StructType([*met.schema.fields, T.StructField("sim", T.DoubleType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for w, s, m in zip(*(c.to_pylist() for c in b.columns)):
                x, y = w.split(), s.split()
                if len(x) == len(y) and all(edits(u, v) <= allowed_edits(u, v) for u, v in zip(x, y)):
                    sim = monge_elkan(w, s)
                    if sim >= (floor_of(x, y) - 1e-9 if alike is None else alike):
                        good.append((w, s, m, sim))
            cols = list(zip(*good)) if good else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.float64()))], names=kept.names)

    found = met.mapInArrow(verify, kept)
    best = found.groupBy("word").agg(F.max_by("star", F.struct("sim", "m", "star")).alias("star"))
    # a star that is attached itself isn't one: follow it once, and drop what still isn't at a star
    again = best.select(F.col("word").alias("star"), F.col("star").alias("further"))
    once = best.join(again, "star", "left").select("word", F.coalesce("further", "star").alias("star"))
    return once.join(best.select(F.col("word").alias("star")), "star", "left_anti").select("word", "star")


def _respell(df: DataFrame, column: str, stars: DataFrame) -> DataFrame:
    named = stars.select(F.col("word").alias(column), F.col("star").alias("_star"))
    return df.join(named, column, "left").withColumn(column, F.coalesce("_star", column)).drop("_star")


def _oriented(read: DataFrame) -> DataFrame:
    """Plain two-word names turned round where the words' use elsewhere says so."""
    sure = read.where("sure and shape in ('full', 'initial')")
    used = (
        sure.select(F.explode(F.array(F.struct(F.col("family").alias("w"), F.lit(1).alias("f")), F.struct(F.col("given").alias("w"), F.lit(-1).alias("f")))).alias("x"))
        .groupBy(F.col("x.w").alias("w")).agg(F.sum("x.f").alias("f"))
    )
    used = cut(used)
    rest = read.where("not (sure or shape <> 'full')")
    a = rest.join(used.select(F.col("w").alias("family"), F.col("f").alias("f_family")), "family", "left")
    b = a.join(used.select(F.col("w").alias("given"), F.col("f").alias("f_given")), "given", "left")
    turn = (F.coalesce("f_given", F.lit(0)) > 0) & (F.coalesce("f_given", F.lit(0)) > F.coalesce("f_family", F.lit(0))) | (
        (F.coalesce("f_family", F.lit(0)) < 0) & (F.coalesce("f_given", F.lit(0)) >= 0)
    )
    family, given = F.when(turn, F.col("given")).otherwise(F.col("family")), F.when(turn, F.col("family")).otherwise(F.col("given"))
    turned = b.select("author_id", family.alias("family"), given.alias("given"), "middle", "shape", "number", "plain", "places")
    return read.where("sure or shape <> 'full'").select("author_id", "family", "given", "middle", "shape", "number", "plain", "places").unionByName(turned)


def _uncrowded(rows: DataFrame, key: list[str], star: str = "star") -> DataFrame:
    """Per key, the star if it is the only one: ``key``..., ``star``. Two aggregates, combined map-side."""
    return rows.groupBy(*key).agg(F.min(star).alias("_a"), F.max(star).alias("_b")).where("_a = _b").select(*key, F.col("_a").alias("to_star"))


def link_names(profiles: DataFrame, short_forms: DataFrame) -> DataFrame:
    """``author_id``, ``entity``: ids of the same person or group share the entity (the least id among its star's).

    Records alike in name, middle initial, number and institutions are one profile, handled once. Rounds, each by
    equi-joins on the family name: (1) full names with an institution or number form stars, joined over shared ones (a name that any record gives in
    full and without number is one person's altogether);
    (2) full names without evidence join the only star of their name, or the one that holds two thirds of it;
    (3) short forms and initials join by institution; (4) what has none joins if only one star fits; (5) what is left
    forms stars of its own by name and institution. Short forms come from ``short_forms``
    (``given_name``, ``short_form``). Middle initials that differ never meet. A name nobody else has, a null name and
    an ambiguous one stay alone. An empty table gives no rows.
    """
    read = cut(read_profiles(profiles))
    turned = _oriented(read)
    # misspelt family names, then misspelt given names
    fam = cut(turned.groupBy(F.col("family").alias("word")).agg(F.count(F.lit(1)).alias("n")))
    turned = cut(_respell(turned, "family", cut(spelling_stars(fam, *FAMILY_BANDS))))
    of_people = turned.where("shape = 'full'")
    given = cut(of_people.groupBy(F.col("given").alias("word")).agg(F.count(F.lit(1)).alias("n")))
    spelt = _respell(of_people, "given", cut(spelling_stars(given, *GIVEN_BANDS, ratio=GIVEN_RATIO, alike=0.75)))
    whole = spelt.unionByName(turned.where("shape <> 'full'"))

    # classes of records that say the same
    said = F.xxhash64("family", "given", F.coalesce("middle", F.lit("")), F.coalesce("number", F.lit("")), "shape", F.coalesce("places", F.array().cast("array<string>")))
    whole = cut(whole.withColumn("profile", F.when(F.col("shape") == "none", F.xxhash64("author_id")).otherwise(said)))
    profile = whole.groupBy("profile").agg(*(F.first(c).alias(c) for c in ("family", "given", "middle", "number", "shape", "places")), F.max("plain").alias("plain"), F.count(F.lit(1)).alias("n"))
    profile = profile.withColumn("initial", F.substring("given", 1, 1))

    told = short_forms.select(F.lower("short_form").alias("s"), F.lower("given_name").alias("g"))
    # the table is incomplete: a short name that longer names begin with may be short for them
    longer = given.where("length(word) > 5 and n > 1").select(F.col("word").alias("g"), F.explode(F.transform(F.sequence(F.lit(3), F.lit(5)), lambda k: F.substring("word", F.lit(1), k))).alias("s"))
    shorts = cut(told.unionByName(longer.hint("merge").join(given.select(F.col("word").alias("s")), "s").select("s", "g")).where("s <> g").distinct())
    can = shorts.select(F.col("s").alias("given")).distinct().withColumn("is_short", F.lit(True))
    p = profile.join(can, "given", "left").withColumn("is_short", F.coalesce("is_short", F.lit(False)))
    p = cut(p)
    # groups and full names that aren't short forms can be stars; a short form whose long one isn't there is one, too
    solid = p.where("shape in ('full', 'group') and not is_short")
    nick = p.where("shape = 'full' and is_short")
    bare = p.where("shape in ('initial', 'single')")
    alone = p.where("shape = 'none'")

    # (1)
    key = ["family", "given"]
    # a name that stands somewhere without a number is one person's
    only = solid.groupBy(*key).agg(F.max("plain").alias("only")).where("only")
    solid = cut(solid.join(only, key, "left").withColumn("only", F.coalesce("only", F.lit(False))))
    has = "size(places) > 0 or number is not null or only"
    seeds = _evidence_stars(solid.where(has), key)
    loose = solid.where(f"not ({has})")
    # (2)
    members = _join_only(loose, seeds, key)
    rest = loose.join(members.select("profile"), "profile", "left_anti")
    own = rest.join(seeds.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min("profile").alias("star"))
    # without any evidence a full name is one person
    own_members = rest.join(own, key).select("profile", "star")
    star = seeds.select("profile", "star").unionByName(members).unionByName(own_members)
    star = cut(star)
    # (3)-(5) for short forms, then initials
    star = _attach(p, star, nick.join(shorts.select(F.col("s").alias("given"), F.col("g").alias("long")), "given"), ["family", "long"], ["family", "given"], ["family", "given"])
    star = _attach(p, star, bare.withColumn("long", F.col("initial")), ["family", "long"], ["family", "initial"], ["family", "initial"])
    star = star.unionByName(alone.select("profile", F.col("profile").alias("star")))
    linked = p.select("profile").join(star, "profile", "left").select("profile", F.coalesce("star", "profile").alias("star"))
    out = cut(whole.select("author_id", "profile").join(linked, "profile").select("author_id", "star"))
    head = out.groupBy("star").agg(F.min("author_id").alias("entity"))
    return out.join(head, "star").select("author_id", "entity")


def _evidence_stars(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with ``star``: star clustering of the profiles of one key over shared institutions or numbers.

    A profile is a star if none that shares evidence with it has more evidence (then more records, then the lesser id);
    all others go to the greatest star they share evidence with. Who shares none with a star, only with a profile that
    went to one, stays for the next round, with the rest of its kind; so a chain of institutions isn't followed. Per
    key and evidence only the greatest profile is looked at: aggregates combined map-side, no pairs.
    """
    proof = F.array_union(F.coalesce("places", F.array().cast("array<string>")), F.when(F.col("number").isNotNull(), F.array("number")).otherwise(F.array().cast("array<string>")))
    if "only" in rows.columns:  # one person's name: it is evidence itself
        proof = F.when(F.col("only"), F.array_union(proof, F.array(F.lit("=")))).otherwise(proof)
    rows = cut(rows.withColumn("proof", proof))
    weight = F.struct(F.size("proof").alias("p"), F.col("n").alias("n"), (-F.col("profile")).alias("i"))
    rest = cut(rows.select("profile", weight.alias("w"), F.explode("proof").alias("e"), *key).select("profile", "w", F.xxhash64("e", *key).alias("k")))
    found: list[DataFrame] = []
    while True:
        head = rest.groupBy("k").agg(F.max(F.struct("w", "profile")).alias("h"))
        own = rest.join(head, "k").groupBy("profile").agg(F.max("h").alias("h"))
        stars = cut(own.where("h.profile = profile").select("profile"))
        lead = rest.join(stars, "profile").groupBy("k").agg(F.max(F.struct("w", "profile")).alias("h"))
        got = cut(rest.join(lead, "k").groupBy("profile").agg(F.max("h").alias("h")).select("profile", F.col("h.profile").alias("star")))
        found.append(got)
        left = cut(rest.join(got.select("profile"), "profile", "left_anti"))
        if not left.limit(1).count():
            break
        rest = left
    star = found[0]
    for f in found[1:]:
        star = star.unionByName(f)
    return rows.drop("proof").join(star, "profile")


def _join_only(loose: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """Profiles without evidence to the only star of their key, or the one with two thirds of its records."""
    per = seeds.groupBy(*key, "star").agg(F.sum("n").alias("n"))
    top = per.groupBy(*key).agg(F.sum("n").alias("all"), F.max(F.struct("n", "star")).alias("best")).where("3 * best.n >= 2 * all").select(*key, F.col("best.star").alias("star"))
    return loose.join(top, key).select("profile", "star")


def _attach(p: DataFrame, star: DataFrame, partial: DataFrame, long: list[str], match_on: list[str], own: list[str]) -> DataFrame:
    """``star`` with the ``partial`` profiles: those whose name could be that of a star's profiles.

    ``long`` are the columns of ``partial`` that meet the columns ``match_on`` of the stars' profiles; ``own`` those by
    which the rest form stars. By institution first; then, for what has no institution or none that is known, if a
    single star fits. Middle initials must not differ.
    """
    there = star.join(p, "profile").select("star", "family", "given", "initial", "middle", "places")
    left = partial.select("profile", *dict.fromkeys([*long, *own]), "middle", "places", "n")
    k = [F.col(a).alias(f"_k{i}") for i, a in enumerate(long)]
    s = [F.col(a).alias(f"_k{i}") for i, a in enumerate(match_on)]
    keys = [f"_k{i}" for i in range(len(long))]
    fits = "middle = '' or m = '' or middle = m"
    # by institution
    at = there.select(*s, F.col("middle").alias("m"), F.explode("places").alias("place"), "star").distinct()
    hit = left.select("profile", *k, "middle", F.explode("places").alias("place")).join(at, [*keys, "place"]).where(fits)
    # the star with most of it; none if two have as much
    share = cut(hit.groupBy("profile", "star").agg(F.count_distinct("place").alias("c")))
    most = share.groupBy("profile").agg(F.max("c").alias("c"))
    got = _uncrowded(share.join(most, ["profile", "c"]), ["profile"]).select("profile", F.col("to_star").alias("star"))
    rest = left.join(got.select("profile"), "profile", "left_anti")
    # what names an institution no star of the name has is someone else
    placed = rest.where("size(places) > 0")
    new = _evidence_stars(placed.dropDuplicates(["profile"]).withColumn("number", F.lit(None).cast("string")), own).select("profile", "star")
    star = cut(star.unionByName(got).unionByName(new))
    # without institution: the only star that fits
    there = star.join(p, "profile").select("star", "family", "given", "initial", "middle")
    every = cut(there.select(*s, F.col("middle").alias("m"), "star").distinct())
    free = rest.where("size(places) = 0")
    with_m = free.where("middle <> ''").select("profile", *k, F.col("middle").alias("m")).join(every, [*keys, "m"])
    exact = _uncrowded(with_m, ["profile"])
    open_ = free.join(exact.select("profile"), "profile", "left_anti")
    none_m = _uncrowded(every.where("m = ''"), keys)
    any_m = _uncrowded(every, keys)
    by_m = _uncrowded(open_.where("middle <> ''").select("profile", *k).join(none_m, keys).withColumnRenamed("to_star", "star"), ["profile"])
    by_any = _uncrowded(open_.where("middle = ''").select("profile", *k).join(any_m, keys).withColumnRenamed("to_star", "star"), ["profile"])
    done = exact.unionByName(by_m).unionByName(by_any).select("profile", F.col("to_star").alias("star"))
    done = cut(done)
    # nobody there of that name: the rest of one name and middle initial is one person
    last = free.join(done.select("profile"), "profile", "left_anti").dropDuplicates(["profile"])
    taken = every.select(*keys).distinct()
    fresh = last.select("profile", *k, *own, "middle").join(taken, keys, "left_anti")
    head = fresh.groupBy(*own).agg(F.min("profile").alias("star"))
    return cut(star.unionByName(done).unionByName(fresh.join(head, own).select("profile", "star")))


def name_pairs(linked: DataFrame) -> DataFrame:
    """``author_id_a`` < ``author_id_b``: every pair of ids of one entity (this result's own form needs all pairs)."""
    sizes = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entity")
    many = linked.join(sizes, "entity", "left_semi")
    b = many.select("entity", F.col("author_id").alias("author_id_b"))
    return many.join(b, "entity").where("author_id < author_id_b").select(F.col("author_id").alias("author_id_a"), "author_id_b")
