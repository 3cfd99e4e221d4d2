"""Several sources mixed to target shares of all tokens, by weighted fair queueing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZER_DIR, VOCABULARY, token_counts

#: More targets than this are refused: the table of targets is broadcast and its totals come to the driver.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Mix:
    """``uses``: a row per use of a document, in mixing order; ``report``: a row per target with the reached share."""

    uses: DataFrame
    report: DataFrame
    horizon: float


def horizon(totals: list[tuple[float, float, int]], budget: float | None) -> float:
    """The virtual time at which mixing ends, from (tokens, weight, most repeats) of each source.

    Without a budget: when the first source has used up all its repeats, the longest mix in which every source with
    documents still keeps its proportion. With one: when sum(min(repeats x tokens, weight x time)) reaches it, so sources
    that run out leave their part to the others; at most what all repeats of all sources hold.
    """
    live = sorted((t * r / w, w, t * r) for t, w, r in totals if t > 0 and w > 0 and r > 0)
    if not live:
        return 0.0
    if budget is None:
        return live[0][0]
    rest, weight = float(budget), sum(w for _, w, _ in live)
    for end, w, cap in live:
        if end * weight >= rest:
            return rest / weight
        rest -= cap
        weight -= w
    return live[-1][0]


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    name: str = VOCABULARY,
    folder: str = TOKENIZER_DIR,
    buckets: int = 4096,
) -> Mix:
    """Mix ``docs`` to the shares in ``targets`` (``source``, ``target_share``, ``max_repeats``).

    Each source's documents are shuffled by a seeded hash and repeated as a whole up to ``max_repeats`` times. A use's
    virtual finish time is the source's tokens so far divided by its weight; uses are sorted by it and the mix ends at
    ``horizon``, where the total budget is reached. What a source then still lacks, as its next document is too long,
    is filled by the one of its later documents in that pass that brings it nearest to its share, if any does: it
    finishes at the end.

    The running sums need no task that sees a whole source: sums per (source, hash bucket) first, then within buckets.
    Null texts and documents whose source is null or has no target stay out; a target without documents is reported
    with 0 and the others keep their proportions to each other; an empty text is used without adding tokens. Repeated
    rows count as documents of their own. Targets with a null or non-positive share or no repeats get nothing.
    """
    spark = docs.sparkSession
    want = targets.groupBy(F.col(source).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where(F.col("source").isNotNull())
    if want.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    want = F.broadcast(want)
    mine = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    mine = mine.join(want.select("source"), "source", "left_semi")
    sized = cut(token_counts(mine, "doc_id", "text", ("source",), name, folder))

    order = F.xxhash64(F.lit(seed), "doc_id")
    place = sized.select("*", order.alias("u"), (F.shiftrightunsigned(order, 40) % buckets).alias("bucket"))
    sums = place.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d"))
    sums = cut(sums)  # at most targets x buckets rows
    total = sums.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("d").alias("docs"))
    plan = want.join(total, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"))
    end = horizon([(r["tokens"], r["target_share"] or 0.0, r["max_repeats"] or 0) for r in plan.collect()], total_tokens)

    before = sums.withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # whole passes over a source that the mix can reach, at most the repeats allowed
    passes = F.least(F.col("max_repeats"), F.when(F.col("tokens") > 0, F.ceil(F.lit(end) * F.col("target_share") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
    goal = F.lit(end) * F.col("target_share") * (1 + 1e-12)
    passed = cut(
        place.withColumn("within", within)
        .join(before.select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base")).hint("merge"), ["source", "bucket"])  # partitioned so already
        .join(F.broadcast(plan.where("target_share > 0 and max_repeats > 0").select("source", "target_share", "max_repeats", "tokens")), "source")
        .withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
        .withColumn("so_far", F.col("repeat_no") * F.col("tokens") + F.col("base") + F.col("within"))
        .select("doc_id", "source", "repeat_no", "n_tokens", "so_far", goal.alias("goal"), "target_share")
    )
    full = passed.where("so_far <= goal")
    lacks = plan.select("source").join(full.groupBy("source").agg(F.max("so_far").alias("got")), "source", "left").select("source", F.coalesce("got", F.lit(0)).alias("got"))
    later = passed.where("so_far > goal").join(F.broadcast(lacks), "source").withColumn("off", F.abs(F.col("goal") - F.col("got") - F.col("n_tokens")))
    later = later.where(F.col("off") < F.col("goal") - F.col("got"))
    fill = later.groupBy("source").agg(F.min_by(F.struct("doc_id", "repeat_no", "n_tokens"), F.struct("off", "so_far", "doc_id")).alias("x"))
    uses = (
        full.select("doc_id", "source", "repeat_no", "n_tokens", (F.col("so_far") / F.col("target_share")).alias("finish"))
        .unionByName(fill.select("x.doc_id", "source", "x.repeat_no", "x.n_tokens", F.lit(end).alias("finish")))
        .orderBy("finish", "source", "doc_id", "repeat_no")
    )
    used = uses.groupBy("source").agg(
        F.sum("n_tokens").alias("used_tokens"), F.count(F.lit(1)).alias("n_uses"), F.sum(F.when(F.col("repeat_no") == 0, 1).otherwise(0)).alias("used_docs"), (F.max("repeat_no") + 1).alias("most_uses")
    )
    got = plan.join(used, "source", "left")
    all_used = F.sum("used_tokens").over(Window.partitionBy())  # a row per target
    report = got.select(
        "source", "target_share", "max_repeats", F.col("docs").alias("n_docs"), F.col("tokens").alias("available_tokens"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("used_docs", "n_uses", "most_uses", "used_tokens")),
        F.coalesce(F.col("used_tokens") / all_used, F.lit(0.0)).alias("actual_share"),
    )
    return Mix(uses, report, end)
