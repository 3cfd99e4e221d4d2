import random

import pytest

from paperweave.llm.names import FAMILY_BANDS, GIVEN_BANDS, RECALL, bands_for, edits, fold, grams, link_names, monge_elkan, name_pairs, places, read_name, spelling_stars

NAMES = [
    ("Ann B. Zöbel", ("zobel", "ann", "b", "full", True)), ("Zöbel, Ann", ("zobel", "ann", "", "full", True)), ("Zobel A", ("zobel", "a", "", "initial", True)), ("Zobel AB.", ("zobel", "a", "b", "initial", True)),
    ("A.Zobel", ("zobel", "a", "", "initial", True)), ("A. B. Zobel", ("zobel", "a", "b", "initial", True)), ("ANN ZOBEL", ("zobel", "ann", "", "full", False)), ("Ann Zobel 0002", ("zobel", "ann", "", "full", False)),
    ("AnnaZobelski", ("zobelski", "anna", "", "full", False)), ("The Xyz Collaboration", ("xyz", "collaboration", "", "group", True)), ("Collab. Xyz", ("xyz", "collaboration", "", "group", True)), ("Xyz-Consortium", ("xyz", "consortium", "", "group", True)),
    ("Zobel", ("zobel", "", "", "single", True)), ("", ("", "", "", "none", True)), (None, ("", "", "", "none", True)), ("???", ("???", "", "", "none", True)),
]


@pytest.mark.parametrize("name,want", NAMES)
def test_read_name(name, want):
    assert read_name(name) == want


def test_places():
    assert places(["Institute of Technology Nezopfäkot", None], "https://people.abcd.example/~x1/") == ["abcd", "nezopfakot", "page:people.abcd.example/~x1"]
    assert places(None, None) == [] and places([], "") == [] and fold("Łódź ß") == "lodz ss"


def test_likeness():
    assert edits("abcd", "acbd") == 1 and edits("abc", "abc") == 0 and edits("", "ab") == 2
    assert monge_elkan("ann zobel", "zobel ann") == 1 and monge_elkan("ann", "") == 0 and monge_elkan("olga x", "olya x") < 0.9


@pytest.mark.parametrize("bands,length", [(FAMILY_BANDS, range(9, 14)), (GIVEN_BANDS, range(6, 11))])
def test_collision_curve(bands, length):
    """An edit or swap leaves the similarity the bands are tuned for, and the curve gives the recall there."""
    rows, least = bands
    assert 1 - (1 - least**rows) ** bands_for(RECALL, least, rows) >= RECALL
    rnd = random.Random(2)
    low = 0
    for _ in range(400):
        w = "".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(rnd.choice(length)))
        i = rnd.randrange(1, len(w) - 2)
        x = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
        a, b = grams(w), grams(x)
        low += len(a & b) / len(a | b) < least - 0.1
    assert low <= 40


def test_stars(spark):
    words = [("bradekluwala", 20), ("bradeklnwala", 1), ("bradekluwla", 2), ("plesutsulul", 9), ("plesutsulu", 1), ("short", 5), ("shorx", 1), ("abc", 9), (None, 3), ("", 3)]
    got = {tuple(r) for r in spelling_stars(spark.createDataFrame(words, "word string, n bigint"), 3, 0.4, alike=0.75).collect()}
    assert got == {("bradeklnwala", "bradekluwala"), ("bradekluwla", "bradekluwala"), ("plesutsulu", "plesutsulul"), ("shorx", "short")}


def test_every_edit_is_met(spark):
    """Misspellings that the bands all but never bring together are found: here there is one band of 40 rows."""
    rnd = random.Random(4)
    words, want = [], set()
    for _ in range(60):
        w = "".join(rnd.choice("abcdefghiklmnoprstuvz") for _ in range(rnd.randrange(6, 13)))
        i = rnd.randrange(1, len(w) - 3)
        x = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :] if w[i] != w[i + 1] else w[:i] + "q" + w[i + 1 :]])
        words += [(w, 20), (x, 1)]
        want.add((x, w))
    got = {tuple(r) for r in spelling_stars(spark.createDataFrame(words, "word string, n bigint"), 40, 0.999).collect()}
    assert got == want


def test_short_family_names(spark):
    """One edit or swap counts in names of fewer than ten letters, too, but not in those of four."""
    words = [("johnson", 20), ("jonhson", 1), ("smith", 30), ("smiht", 1), ("smyth", 2), ("wang", 50), ("yang", 9), ("brown", 9), ("braun", 1)]
    got = {tuple(r) for r in spelling_stars(spark.createDataFrame(words, "word string, n bigint"), 2, 0.3).collect()}
    assert got == {("jonhson", "johnson"), ("smiht", "smith"), ("smyth", "smith")}


PEOPLE = [
    # one person in many spellings
    ("01", "Katarzyna Dupöklober", None, ["Univ. of Nibernudat"], None), ("02", "K Dupöklober", "https://people.nibernudat.example/~kd3", None, None), ("03", "Kasia Dupoklober", None, ["U. Nibernudat"], None),
    ("04", "Dupöklober, Katarzyna", None, None, None), ("05", "Kataryzna Dupöklober", None, None, []), ("06", "KatarzynaDupöklober", "https://people.nibernudat.example/~kd3/", None, None), ("07", "K. Dupöklober", None, None, ["Katarzyna Dupöklober"]),
    # two people of one name
    ("11", "Xenia Cahobjomej", None, ["Kopin IT, School of Computing"], ["Xenia Cahobjomej 0001"]), ("12", "Xenia Cahobjomej", "https://people.kopin.example/~x1", None, None), ("13", "Xenia Cahobjomej", None, ["Univ. of Wacuntikah"], ["Xenia Cahobjomej 0002"]),
    # others
    ("21", "Olga Dupöklober", None, None, None), ("22", "The Bagintorac Consortium", None, None, None), ("23", "Bagintorac-Consortium", None, None, None), ("24", "The Bagintorac Working Group", None, None, None),
    ("31", None, None, None, None), ("32", None, None, None, None), ("33", "", "", [], []), (None, "Katarzyna Dupöklober", None, None, None), ("41", "B. Lone", None, None, None), ("42", "Lone, B.", None, None, None),
]
KIND = "author_id string, name string, homepage string, affiliations array<string>, dblp_name array<string>, star string, profile int"


def people(spark, rows=PEOPLE):
    common = [(f"z{i}", n, None, None, None) for i, n in enumerate(["Katarzyna Aa Bolek", "Katarzyna B. Celik", "Katarzyna C. Dudek", "Katarzyna D. Ebel", "Katarzyna E. Fabel", "Olga F. Gabel"])]
    forms = spark.createDataFrame([("Katarzyna", "Kasia"), ("Olga", "Olya")], "given_name string, short_form string")
    return spark.createDataFrame([(*r, "s", 1) for r in [*rows, *common]], KIND), forms


def test_spellings_and_namesakes(spark):
    got = {tuple(r) for r in name_pairs(link_names(*people(spark))).collect()}
    one = [f"0{i}" for i in range(1, 8)]
    want = {(a, b) for a in one for b in one if a < b} | {("11", "12"), ("22", "23"), ("41", "42")}
    assert got == want


def test_every_id_once_and_empty(spark):
    p, forms = people(spark)
    got = link_names(p, forms).collect()
    assert sorted(r.author_id for r in got) == sorted(r.author_id for r in p.where("author_id is not null").collect())
    assert link_names(p.limit(0), forms).count() == 0 and link_names(p, forms.limit(0)).count() == len(got)


def test_homepages_tell(spark):
    """On the table: ids with one homepage are one person's, ids with different ones are not."""
    sf = "/root/testdata/sf0.01"
    a = spark.read.parquet(f"{sf}/author_profile.parquet")
    entity = {r.author_id: r.entity for r in link_names(a, spark.read.parquet(f"{sf}/given_name_form.parquet")).collect()}
    page = {r.author_id: r.homepage.lower().rstrip("/") for r in a.collect() if r.homepage}
    ids = sorted(page)
    same = [(x, y) for i, x in enumerate(ids) for y in ids[:i] if page[x] == page[y]]
    assert len(same) > 20 and sum(entity[x] == entity[y] for x, y in same) >= 0.95 * len(same)
    pages = {}
    for x in ids:
        pages.setdefault(entity[x], set()).add(page[x])
    assert sum(len(v) > 1 for v in pages.values()) <= 2


def test_a_third_of_all_rows_has_one_name(spark):
    same = [(f"s{i:03d}", "Wide Spread", None, None, None) for i in range(200)]
    rest = [(f"r{i:03d}", f"Given{chr(97 + i % 26)}{chr(97 + i // 26)}x Family{chr(97 + i % 26)}{chr(97 + i // 26)}qz", None, None, None) for i in range(400)]
    p, forms = people(spark, same + rest)
    linked = {r.author_id: r.entity for r in link_names(p, forms).collect()}
    assert {linked[a] for a, *_ in same} == {"s000"} and len(linked) == 606
    assert name_pairs(link_names(p, forms)).count() == 200 * 199 // 2


def test_held_out_names(spark):
    """With the DBLP names of half the table's records hidden, nearly the same pairs are linked."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    a, forms = spark.read.parquet(f"{sf}/author_profile.parquet"), spark.read.parquet(f"{sf}/given_name_form.parquet")
    hidden = a.withColumn("dblp_name", F.when(F.pmod(F.xxhash64("author_id"), F.lit(2)) == 1, F.col("dblp_name")))
    full, part = ({tuple(r) for r in name_pairs(link_names(x, forms)).collect()} for x in (a, hidden))
    assert len(full & part) >= 0.95 * len(part) and len(full & part) >= 0.9 * len(full)


def test_a_chain_of_institutions_is_not_one_person(spark):
    """Star clustering: who shares an institution with a star joins it, who shares one only with a member doesn't."""
    from paperweave.llm.names import _evidence_stars

    rows_ = [(1, ["a"], 5), (2, ["a", "b"], 1), (3, ["b", "c"], 1), (4, ["c"], 9), (5, ["z"], 1), (6, [], 1)]
    df = spark.createDataFrame([("smithson", "ann", i, p, None, n) for i, p, n in rows_], "family string, given string, profile long, places array<string>, number string, n long")
    got = {r.profile: r.star for r in _evidence_stars(df, ["family", "given"]).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}
