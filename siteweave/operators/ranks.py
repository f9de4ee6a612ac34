"""Ranks, percentiles, top shares and multiple testing without a global sort in one task.

Everything starts from a histogram of scores (``groupBy`` group and score), and running sums
over it are computed in range partitions: a window inside each partition, plus the totals of the
partitions before it, of which there are as many as partitions. The partitions' bounds come from
a sample, so the ranged rows are checkpointed before they are read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stable


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def running(df: DataFrame, group: list[str], order: list[Column], sums: list[str] = (), mins: list[str] = ()) -> DataFrame:
    """``df`` with cum_<c> for each of ``sums`` and least_<c> for each of ``mins``, up to and with the row.

    ``order`` must be total within a group.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stable(df.repartitionByRange(spread, *[F.col(g) for g in group], *order).withColumn("__p", F.spark_partition_id()))
    keys = [*group, "__p"]
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        "*", *[F.sum(c).over(here).alias(f"__s_{c}") for c in sums], *[F.min(c).over(here).alias(f"__m_{c}") for c in mins]
    )
    totals = ranged.groupBy(*keys).agg(
        *[F.sum(c).alias(f"t_{c}") for c in sums], *[F.min(c).alias(f"u_{c}") for c in mins], F.lit(1).alias("__one")
    )
    before = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in sums],
        *[F.min(f"u_{c}").over(earlier).alias(f"__l_{c}") for c in mins],
    )
    joined = local.alias("l").join(before.alias("b"), reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        *[(F.col(f"__s_{c}") + F.col(f"__b_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.least(f"__m_{c}", f"__l_{c}").alias(f"least_{c}") for c in mins],
    )


def histogram(df: DataFrame, group: list[str], score: str, label: str | None = None) -> DataFrame:
    """n (and pos, neg of a 0/1 label) by group and distinct score; null scores and labels are left out."""
    known = df.where(F.col(score).isNotNull() & (F.col(label).isNotNull() if label else F.lit(True)))
    counts = [F.count("*").alias("n")]
    if label:
        counts += [F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")]
    return known.groupBy(*group, score).agg(*counts)


def _totals(hist: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return hist.groupBy(*group).agg(*[F.sum(c).alias(f"total_{c}") for c in columns])


def with_totals(hist: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``hist`` with total_<c> of its group."""
    totals = _totals(hist, group, columns)
    if not group:
        return hist.crossJoin(totals)  # one row
    joined = hist.alias("l").join(totals.alias("r"), reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group]))
    return joined.select("l.*", *[f"total_{c}" for c in columns])


def percentile_ranks(df: DataFrame, value: str, group: list[str] = (), zero_based: bool = False, out: str = "percentile") -> DataFrame:
    """WIN-01, 02, 03: percentile of average ranks, null for null.

    rank / n, or (rank - 1) / (n - 1) if ``zero_based``.
    """
    group = list(group)
    hist = with_totals(histogram(df, group, value), group, ["n"])
    ranked = running(hist, group, [F.col(value)], ["n"])
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    share = (rank - 1) / F.greatest(F.col("total_n") - 1, F.lit(1)) if zero_based else rank / F.col("total_n")
    ranked = ranked.select(*group, value, share.alias(out))
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group], F.col(f"l.{value}") == F.col(f"r.{value}"))
    return df.alias("l").join(ranked.alias("r"), cond, "left").select("l.*", out)


def quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """A column per named quantile of ``value`` by group, interpolated between neighbouring values; none for groups without values.

    From the histogram's running counts, so a group's distinct values never meet in one task.
    """
    group = list(group)
    hist = with_totals(histogram(df.withColumn("__v", F.col(value).cast("double")), group, "__v"), group, ["n"])
    ranked = running(hist, group, [F.col("__v")], ["n"])
    out = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("total_n") - 1)
        holds = lambda i: F.max(F.when((F.col("cum_n") - F.col("n") <= i) & (i < F.col("cum_n")), F.col("__v")))
        low, high, part = holds(F.floor(place)), holds(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*group).agg(*out)


def reference_percentile(df: DataFrame, reference: DataFrame, score: str, group: list[str] = (), out: str = "percentile") -> DataFrame:
    """WIN-04: mid-rank percentile (below + equal / 2) / n of each score against the reference of its group.

    Also ``<out>_n``, the size of that reference; both null where there is none.
    """
    return layers_of(df, reference, score, {out: list(group)})


def layers_of(df: DataFrame, reference: DataFrame, score: str, layers: dict[str, list[str]]) -> DataFrame:
    """WIN-04: a percentile and its reference's size for each of several groupings, from one running sum.

    Every grouping is a layer of one keyed histogram: the layer's number and its group's values as text.
    """
    names = list(layers)
    key = lambda cols: F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(c).cast("string").alias(c) for c in cols]))
    tags = F.array(*[F.struct(F.lit(i).alias("layer"), key(layers[n]).alias("key")) for i, n in enumerate(names)])
    spread = lambda x: x.where(F.col(score).isNotNull()).select(F.col(score).alias("__s"), F.explode(tags).alias("t")).select("t.*", "__s")
    hist = spread(reference).groupBy("layer", "key", "__s").agg(F.count("*").alias("ref"))
    asked = spread(df).distinct().withColumn("ref", F.lit(0).cast("long"))
    both = hist.unionByName(asked).groupBy("layer", "key", "__s").agg(F.sum("ref").alias("ref"))
    placed = running(with_totals(both, ["layer", "key"], ["ref"]), ["layer", "key"], [F.col("__s")], ["ref"])
    share = F.when(F.col("total_ref") > 0, (F.col("cum_ref") - F.col("ref") / 2) / F.col("total_ref"))
    placed = placed.select("layer", "key", "__s", share.alias("share"), F.nullif("total_ref", F.lit(0)).alias("size"))
    for i, name in enumerate(names):
        own = placed.where(F.col("layer") == i).select(F.col("key").alias("__k"), F.col("__s").alias("__v"), F.col("share").alias(name), F.col("size").alias(f"{name}_n"))
        df = df.withColumn("__key", key(layers[name])).join(own, (F.col("__key") == F.col("__k")) & (F.col(score) == F.col("__v")), "left").drop("__key", "__k", "__v")
    return df


def layered_percentile(df: DataFrame, reference: DataFrame, score: str, pattern: str, breadth: str, least: int = 20) -> DataFrame:
    """WIN-04: percentile by pattern if the reference has ``least`` there, else by breadth, else over all."""
    z = layers_of(df, reference, score, {"p_pattern": [pattern], "p_breadth_only": [breadth], "p_all": []})
    by_pattern = F.when(F.col("p_pattern_n") >= least, F.col("p_pattern"))
    by_breadth = F.when(F.col("p_breadth_only_n") >= least, F.col("p_breadth_only")).otherwise(F.col("p_all"))
    mode = F.when(by_pattern.isNotNull(), "same_source_pattern").otherwise("same_source_breadth")
    extra = {"p_pattern", "p_pattern_n", "p_breadth_only", "p_breadth_only_n", "p_all", "p_all_n"}
    return z.select(
        *[c for c in z.columns if c not in extra], by_pattern.alias("pattern_percentile"), by_breadth.alias("breadth_percentile"),
        F.coalesce(by_pattern, by_breadth).alias("reference_percentile"), F.when(F.col(score).isNotNull(), mode).alias("reference_used"),
    )


def quintile_gradient(df: DataFrame, score: str, label: str) -> DataFrame:
    """WIN-05: n, positives, rate and score range by quintile of the percentile; ties stay together."""
    hist = with_totals(histogram(df, [], score, label), [], ["n"])
    ranked = running(hist, [], [F.col(score)], ["n"])
    share = (F.col("cum_n") - (F.col("n") - 1) / 2) / F.col("total_n")
    quintile = F.least(F.greatest(F.ceil(share * 5), F.lit(1)), F.lit(5)).cast("int")
    return ranked.groupBy(quintile.alias("quintile")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("positives"), (F.sum("pos") / F.sum("n")).alias("rate"),
        F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    )


def _cut(df: DataFrame, score: str, label: str, group: list[str]) -> DataFrame:
    hist = with_totals(histogram(df, group, score, label), group, ["n", "pos"])
    return running(hist, group, [F.col(score).desc()], ["n", "pos"])


def tie_inclusive_top(df: DataFrame, score: str, label: str, fraction: float, group: list[str] = ()) -> DataFrame:
    """WIN-08: precision and lift of the top share, with all that tie at its edge."""
    cut = _cut(df, score, label, list(group))
    k = F.greatest(F.ceil(F.lit(fraction) * F.col("total_n")), F.lit(1))
    inside = cut.where(F.col("cum_n") - F.col("n") < k)
    precision = F.sum("pos") / F.sum("n")
    return inside.groupBy(*group).agg(
        F.max(k).alias("k_nominal"), F.sum("n").alias("k_tie_inclusive"), F.min(score).alias("threshold"), precision.alias("precision"),
        F.try_divide(precision, F.max("total_pos") / F.max("total_n")).alias("lift"),
    )


def expected_budget(df: DataFrame, score: str, label: str, budget: int, group: list[str] = ()) -> DataFrame:
    """WIN-09: expected positives of exactly ``budget`` picks; those tied at the edge are exchangeable."""
    cut = _cut(df, score, label, list(group))
    k = F.least(F.lit(budget), F.col("total_n"))
    picked = F.least(F.col("n"), k - (F.col("cum_n") - F.col("n")))
    inside = cut.where(F.col("cum_n") - F.col("n") < k)
    expected = F.sum(picked * F.col("pos") / F.col("n"))
    return inside.groupBy(*group).agg(
        F.max(k).alias("k"), expected.alias("expected_positives"), (expected / F.max(k)).alias("expected_precision"),
        F.try_divide(expected / F.max(k), F.max("total_pos") / F.max("total_n")).alias("expected_lift"), F.min(score).alias("boundary_score"),
    )


def top_share(df: DataFrame, score: str, label: str, key: str, fraction: float | None = None, k: int | None = None) -> DataFrame:
    """WIN-06, 07: precision and lift of the first ceil(fraction * n) or ``k`` rows; ties go by ``key``."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        score, key, F.col(label).cast("long").alias("pos"), F.lit(1).cast("long").alias("n")
    )
    rows = running(known, [], [F.col(score).desc(), F.col(key)], ["n"]).crossJoin(_totals(known, [], ["n", "pos"]))
    want = F.ceil(F.lit(fraction) * F.col("total_n")) if fraction is not None else F.least(F.lit(k), F.col("total_n"))
    want = F.greatest(want, F.lit(1))
    precision = F.sum("pos") / F.sum("n")
    return rows.where(F.col("cum_n") <= want).agg(
        F.sum("n").alias("k"), F.sum("pos").alias("positives"), precision.alias("precision"),
        F.try_divide(precision, F.max("total_pos") / F.max("total_n")).alias("lift"),
    )


def bh_adjust(df: DataFrame, p: str, group: list[str] = (), out: str = "q") -> DataFrame:
    """WIN-10: Benjamini-Hochberg q by group; null p stay null and don't count."""
    group = list(group)
    hist = with_totals(histogram(df, group, p), group, ["n"])
    ranked = running(hist, group, [F.col(p)], ["n"]).withColumn("raw", F.col(p) * F.col("total_n") / F.col("cum_n"))
    least = running(ranked, group, [F.col(p).desc()], mins=["raw"]).select(*group, p, F.least("least_raw", F.lit(1.0)).alias(out))
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group], F.col(f"l.{p}") == F.col(f"r.{p}"))
    return df.alias("l").join(least.alias("r"), cond, "left").select("l.*", out)


def blocks(df: DataFrame, group: list[str], position: str, max_gap: int = 2, least: int = 1) -> DataFrame:
    """WIN-12: runs of positions whose gaps are at most ``max_gap``: start, end and n by group."""
    w = Window.partitionBy(*group).orderBy(position)
    gap = (F.col(position) - F.lag(position).over(w) > max_gap).cast("int")
    numbered = df.select(*group, position).distinct().withColumn("__gap", F.coalesce(gap, F.lit(0))).withColumn("block", F.sum("__gap").over(w))
    return numbered.groupBy(*group, "block").agg(
        F.min(position).alias("block_start"), F.max(position).alias("block_end"), F.count("*").alias("n")
    ).where(F.col("n") >= least)


MOST_MEMBERS = 1000


def leave_one_out(df: DataFrame, member: str, out: str = "omitted") -> DataFrame:
    """WIN-14: every row once for each other member, named in ``out``; at most ``MOST_MEMBERS`` members."""
    members = [r[0] for r in df.select(member).distinct().orderBy(member).limit(MOST_MEMBERS + 1).collect()]
    if len(members) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members of {member}")
    others = F.filter(F.array(*[F.lit(m) for m in members]), lambda m: m != F.col(member))
    return df.withColumn(out, F.explode(others))
