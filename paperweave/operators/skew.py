"""Per-key work where a few keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch, counted exactly, and treated apart: their rows meet the
other side by broadcast (of at most ``1/share`` rows) or by salting, all other rows by an ordinary shuffle; the results
are united. Nothing is dropped, capped or sampled: the sketch only names candidates.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def sketch_candidates(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``key``, ``n``, ``n_total``: a superset of the keys holding at least ``share`` of the rows of ``df``, at most ``3/share``,
    with about how many rows each has, and how many rows have a key.

    A frequent-items sketch tracking m items errs by at most 3.5/m of all rows; with m >= 14/share the error is a quarter
    of ``share``, so every such key is in it and none with less than half of it can crowd one out of the first
    ``3/share``. The sketch is built map-side and merged: one small object per task crosses the network. Null keys are
    no candidates. An empty ``df`` gives no rows.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    k = math.ceil(3 / share)
    m = 1 << max(6, math.ceil(math.log2(max(14 / share, 2 * k))))
    top = df.select(key.alias("_k")).where(F.col("_k").isNotNull()).agg(F.expr(f"approx_top_k(_k, {k}, {m})").alias("_t"), F.count(F.lit(1)).alias("n_total"))
    return top.select(F.explode("_t").alias("_e"), "n_total").select(F.col("_e.item").alias("key"), F.col("_e.count").alias("n"), "n_total")


def parted(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` may be heavy, and all others with a key.

    The candidates are written down, so that both parts see the same ones, and met by broadcast (at most ``3/share``
    rows): no row is moved to tell. Rows with a null key are in neither part.
    """
    cand = cut(sketch_candidates(df, F.col(key), share))
    tag = F.broadcast(cand.select(F.col("key").alias(key)))
    return df.join(tag, key, "left_semi"), df.where(F.col(key).isNotNull()).join(tag, key, "left_anti")


def count_per_key(df: DataFrame, key: str, share: float) -> DataFrame:
    """``key``, ``n_rows``, ``n_total``, ``heavy``: the rows of every key, those of at least ``share`` of all rows marked.

    Candidates for heavy keys are named by a sketch and met by broadcast (at most ``3/share`` rows); their rows are counted
    where they are, so what is shuffled of them is a row per task and key. All other keys go through one ordinary
    shuffle; the results are united. ``n_total`` (null for the others) counts all rows of ``df``, those with a null key
    too; ties at the threshold are heavy. An empty table gives no rows. Where only heavy keys are asked for, the other
    part is never computed.
    """
    cand = cut(sketch_candidates(df, F.col(key), share).select(F.col("key").alias(key)))
    count = F.count(F.lit(1)).alias("n_rows")
    known = df.join(F.broadcast(cand.withColumn("_c", F.lit(1))), key, "left")
    # a row per candidate and one (null) for all the rest, few enough for one window: the total is their sum
    hit = known.groupBy(F.when(F.col("_c").isNotNull(), F.col(key)).alias(key)).agg(count).withColumn("n_total", F.sum("n_rows").over(Window.partitionBy()))
    hot = hit.where(F.col(key).isNotNull()).select(key, "n_rows", "n_total", (F.col("n_rows") >= F.lit(share) * F.col("n_total")).alias("heavy"))
    # what isn't a candidate can't reach the share
    light = df.where(F.col(key).isNotNull()).join(F.broadcast(cand), key, "left_anti").groupBy(key).agg(count)
    return hot.unionByName(light.select(key, "n_rows", F.lit(None).cast("bigint").alias("n_total"), F.lit(False).alias("heavy")))


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``key``, ``n_rows``, ``n_total``: the keys holding at least ``share`` of all rows, counted exactly; the heavy keys
    of ``count_per_key``."""
    return count_per_key(df.select(key.alias("key")), "key", share).where("heavy").select("key", "n_rows", "n_total")


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    how: str = "inner",
    share: float = 0.001,
    unique: bool = False,
    salts: int = 32,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """``big`` joined to ``small`` on ``on`` (inner or left), without a task that gets a whole heavy key.

    ``heavy`` (column ``on``): the heavy keys of ``big``, which must come out the same each time; found by
    ``sketch_candidates`` and written down if not given, so at most ``3/share``. ``unique``: ``small`` has one row per key; its heavy rows are then at most that many and broadcast.
    Otherwise the heavy rows of ``big`` get a salt and those of ``small`` are repeated per salt, so that a key's rows are
    spread over as many tasks as it has times ``share`` of all rows (``salts`` if the heavy keys are given). All other keys hold less than ``share`` of the rows and
    go through one ordinary shuffle join. Null keys match nothing (a left join keeps their rows). A column of ``small``
    named like one of ``big`` comes out with ``_small`` behind its name. Empty sides give what the join gives.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    taken = {c.lower() for c in big.columns} - {on.lower()}
    small = small.select(*(F.col(f"`{c}`").alias(f"{c}_small") if c.lower() in taken else F.col(f"`{c}`") for c in small.columns))
    tag = f"_h{uuid.uuid4().hex[:8]}"
    if heavy is None:
        # both branches must see the same keys, and a sketch may come out differently when it is computed again
        found = sketch_candidates(big, F.col(on), share)
        parts = F.ceil(F.col("n") / F.greatest(F.lit(1.0), F.col("n_total") * share)).cast("int")
        heavy = cut(found.select(F.col("key").alias(on), F.greatest(parts, F.lit(1)).alias(tag)))
    else:
        heavy = heavy.select(on).distinct().withColumn(tag, F.lit(salts))
    marked = big.join(F.broadcast(heavy), on, "left")
    light = marked.where(F.col(tag).isNull()).drop(tag).join(small, on, how)
    hot_big = marked.where(F.col(tag).isNotNull())
    if unique:
        hot_small = small.join(F.broadcast(heavy.select(on)), on, "left_semi")
        hot = hot_big.drop(tag).join(F.broadcast(hot_small), on, how)
    else:
        s = f"_s{tag}"
        spread = hot_big.withColumn(s, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c != on] or [F.col(on)]), F.col(tag)).cast("int")).drop(tag)
        copies = small.join(F.broadcast(heavy), on).withColumn(s, F.explode(F.sequence(F.lit(0), F.col(tag) - 1))).drop(tag)
        hot = spread.join(copies, [on, s], how).drop(s)
    return light.unionByName(hot)


def attach_first(rows: DataFrame, group: str, value: str, out: str, share: float = 0.001) -> DataFrame:
    """``rows`` with ``out``: the least ``value`` of each row's ``group``; rows alone in their group are left out.

    Two steps: the least value per group with map-side combining, then a join back that treats groups holding more than
    ``share`` of the rows (at most ``1/share`` of them, so a broadcast of bounded size) apart from all others. Rows whose
    group or value is null are left out. ``rows`` is read twice: cut it first if it is costly to compute.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    groups = rows.groupBy(group).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    heavy = groups.where(F.col("_n") >= max(1000.0, share * rows.count())).select(group)
    return skew_join(rows, groups.drop("_n"), group, "inner", unique=True, heavy=heavy)


def spread_group(df: DataFrame, key: str, member: str, extra: list[tuple[Column, Column]] | None = None, share: float = 0.001) -> DataFrame:
    """Per ``key``: ``n_rows`` and ``n_distinct`` (members that aren't null), exact, without a task that gets a whole heavy key.

    The rows of heavy keys (``parted``) are aggregated per (key, member) first, so a key spreads over as many tasks as it
    has members and a repeated pair is combined map-side, then per key over the partial results. All other rows are
    shuffled once, by key, and both steps take place there. The results are united. Rows with a null key are left out.
    ``extra``: further mergeable aggregates as pairs of (first step, second step) named alike.
    """
    def steps(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(key, member).agg(F.count(F.lit(1)).alias("_n"), *[a for a, _ in extra or []])
        return one.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.count(member).alias("n_distinct"), *[b for _, b in extra or []])

    hot, light = parted(df, key, share)
    return steps(hot).unionByName(steps(light.repartition(key)))
