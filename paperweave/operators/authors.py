"""Observed authors of papers reconciled with stored persons: link, enrich, divide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, falsy
from .skew import skew_join


def authors_of(papers: DataFrame, endpoint_authors: DataFrame | None = None) -> DataFrame:
    """Observed authors of each paper: ``paper_id``, ``pos``, ``author_id``, ``name``, ``homepage``, ``dblp_name``.

    ``papers``: paper_id, authors (array of author_id, name, homepage, dblp_name array, has_ext). If any inline author
    lacks an id or external ids, the endpoint's list (paper_id, pos, author_id, name, homepage, dblp_name) stands for
    all of them; an empty list means no authors, a null one asks the endpoint. Authors without id are left out.
    """
    bad = F.col("authors").isNull() | any_of(F.col("authors"), lambda a: a["author_id"].isNull() | ~F.coalesce(a["has_ext"], F.lit(False)))
    marked = papers.select("paper_id", "authors", bad.alias("ask"))
    inline = marked.where("not ask").select("paper_id", F.posexplode("authors").alias("pos", "a")).select("paper_id", "pos", falsy(F.col("a.author_id")).alias("author_id"), "a.name", "a.homepage", "a.dblp_name")
    inline = inline.where("author_id is not null")
    if endpoint_authors is None:
        return inline
    asked = marked.where("ask").select("paper_id").join(endpoint_authors, "paper_id").select(*inline.columns)
    return inline.unionByName(asked)


def author_keys(observed: DataFrame) -> DataFrame:
    """``paper_id``, ``key``, ``value``: the keys by which stored persons are looked up (this source knows only ids)."""
    return observed.where(falsy(F.col("author_id")).isNotNull()).select("paper_id", F.lit("author_id").alias("key"), F.col("author_id").alias("value")).distinct()


def persons_by_key(person: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored persons by key: ``paper_id`` and the person's columns, for each (paper_id, key, value) of ``keys``.

    ``key`` names the column compared, author_id or dblp_pid; null and empty values find nobody.
    """
    by = person.select("element_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), falsy(F.col(k)).alias("value")) for k in ("author_id", "dblp_pid")])).alias("x")).select("element_id", "x.key", "x.value").where("value is not null")
    return keys.join(by, ["key", "value"]).select("paper_id", "element_id").distinct().join(person, "element_id")


def observed_names(observed: DataFrame) -> DataFrame:
    """``paper_id``, ``name``, and the author it stands for in that paper: the last in order, as names repeat."""
    rows = observed.select("paper_id", "pos", "author_id", "homepage", F.posexplode("dblp_name").alias("k", "name")).where("name <> ''")
    return rows.groupBy("paper_id", "name").agg(F.max_by(F.struct("author_id", "homepage"), F.struct("pos", "k")).alias("a")).select("paper_id", "name", "a.*")


def correlated_persons(papers: DataFrame, observed: DataFrame, person: DataFrame, write: DataFrame) -> DataFrame:
    """Stored persons a paper's authors are compared with: those who wrote it and those found by key, once each.

    ``papers``: paper_id, title_hash; ``write``: element_id, title_hash. Result: ``paper_id`` and the person's columns.
    """
    # the empty hash and those of generic titles can be many papers' and many persons'
    by_write = skew_join(papers.select("paper_id", "title_hash"), write.select("element_id", "title_hash"), "title_hash").select("paper_id", "element_id")
    by_key = persons_by_key(person, author_keys(observed)).select("paper_id", "element_id")
    return by_write.unionByName(by_key).distinct().join(person, "element_id")


def match_authors(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each (paper, stored person): ``action`` by_id, divide or enrich, with the author it concerns.

    by_id: the person's id is among the paper's authors; divide: it has an id that isn't, but its name is the DBLP name
    of one; enrich: it has no id, but such a name and a DBLP pid to be found by. Persons of no action are left out.
    ``stored``: paper_id, element_id, author_id, dblp_pid, name. Null and empty ids count as none.
    """
    s = stored.select("paper_id", "element_id", falsy(F.col("author_id")).alias("stored_author_id"), falsy(F.col("dblp_pid")).alias("dblp_pid"), "name")
    ids = observed.groupBy("paper_id", F.col("author_id").alias("stored_author_id")).agg(F.max_by("homepage", "pos").alias("homepage"))
    with_id = s.where("stored_author_id is not null")
    by_id = with_id.join(ids, ["paper_id", "stored_author_id"]).select("paper_id", "element_id", F.lit("by_id").alias("action"), F.col("stored_author_id").alias("author_id"), falsy(F.col("homepage")).alias("homepage"), "stored_author_id", "dblp_pid")
    names = observed_names(observed)
    other = with_id.join(ids.select("paper_id", "stored_author_id"), ["paper_id", "stored_author_id"], "left_anti")
    divide = other.join(names, ["paper_id", "name"]).select("paper_id", "element_id", F.lit("divide").alias("action"), "author_id", F.lit(None).cast("string").alias("homepage"), "stored_author_id", "dblp_pid")
    without = s.where("stored_author_id is null and dblp_pid is not null")
    enrich = without.join(names, ["paper_id", "name"]).select("paper_id", "element_id", F.lit("enrich").alias("action"), "author_id", falsy(F.col("homepage")).alias("homepage"), "stored_author_id", "dblp_pid")
    return by_id.unionByName(divide).unionByName(enrich)


def apply_author_actions(person: DataFrame, write: DataFrame, actions: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next versions of the person and write tables, from one snapshot; divisions come before links.

    Link (by_id): the person keyed by the id gets the homepage and a write link. Enrich: the one keyed by its DBLP pid gets
    id and homepage. Divide: the wrong person's link to this paper goes; the right one, keyed by id (made if missing,
    with the id as element id prefixed ``new:``), takes over the wrong one's properties - they win over its own, the id
    apart - and gets the link. Where several papers' actions meet one person, the greatest paper id writes last.
    """
    hashes = papers.select("paper_id", "title_hash").where("title_hash is not null")
    act = actions.join(hashes, "paper_id")
    owner = person.where(falsy(F.col("author_id")).isNotNull()).groupBy("author_id").agg(F.min("element_id").alias("owner_id"))
    props = ["dblp_pid", "name", "homepage"]
    # divide: the wrong person's properties for the right one
    wrong = act.where("action = 'divide'").join(person.select("element_id", *[F.col(c).alias(f"w_{c}") for c in props]), "element_id").join(owner, "author_id", "left")
    wrong = wrong.withColumn("target", F.coalesce("owner_id", F.concat(F.lit("new:"), F.col("author_id"))))
    patch = wrong.groupBy("target").agg(F.max_by(F.struct("author_id", *[F.col(f"w_{c}") for c in props]), F.struct("paper_id", "element_id")).alias("p")).select(F.col("target").alias("element_id"), F.col("p.author_id").alias("p_author_id"), *[F.col(f"p.w_{c}").alias(f"d_{c}") for c in props])
    # link and enrich: fields set on the person itself
    soft = act.where("action <> 'divide'").groupBy("element_id").agg(F.max_by("homepage", F.when(F.col("homepage").isNotNull(), F.col("paper_id"))).alias("s_homepage"), F.max_by("author_id", F.when(F.col("action") == "enrich", F.col("paper_id"))).alias("s_author_id"))
    base = person.select("element_id", "author_id", *props).join(patch, "element_id", "full").join(soft, "element_id", "left")

    def over(c: str) -> Column:
        return F.coalesce(falsy(F.col(f"d_{c}")), F.col(c)).alias(c)

    next_person = base.select(
        "element_id", F.coalesce("p_author_id", "s_author_id", "author_id").alias("author_id"), over("dblp_pid"), over("name"),
        F.coalesce("s_homepage", falsy(F.col("d_homepage")), F.col("homepage")).alias("homepage"),
    )
    gone = wrong.select("element_id", "title_hash").distinct()
    added = wrong.select(F.col("target").alias("element_id"), "title_hash").unionByName(act.where("action <> 'divide'").select("element_id", "title_hash"))
    next_write = write.join(gone, ["element_id", "title_hash"], "left_anti").unionByName(added).distinct()
    return next_person, next_write


def author_json(author_id: Column, name: Column, dblp_pid: Column) -> Column:
    """An author for the JSON sink: what is null or empty is left out."""
    return F.struct(falsy(author_id).alias("authorId"), falsy(name).alias("name"), falsy(dblp_pid).alias("dblp_pid"))
