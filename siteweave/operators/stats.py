"""Association statistics as sums over histograms and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import normal_p
from .loci import class_counts
from .ranks import bh_adjust, histogram, running, with_totals
from .storage import stable


def auroc(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """ST-01: n, positives and AUROC by group, ties at one half; null with a single class."""
    return auroc_of(histogram(df, list(group), score, label), score, list(group))


def auroc_of(hist: DataFrame, score: str, group: list[str]) -> DataFrame:
    """ST-01 from a histogram with pos and neg by score."""
    ranked = running(hist, group, [F.col(score)], ["neg"])
    pos, neg = F.sum("pos"), F.sum("neg")
    below = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return ranked.groupBy(*group).agg(
        (pos + neg).alias("n"), pos.alias("n_pos"), F.try_divide(below, pos.cast("double") * neg).alias("auroc")
    )


def average_precision(df: DataFrame, score: str, label: str, group: list[str] = ()) -> DataFrame:
    """ST-02: average precision by group, a step per distinct score; null without positives."""
    group = list(group)
    ranked = running(histogram(df, group, score, label), group, [F.col(score).desc()], ["n", "pos"])
    total = F.sum("pos")
    return ranked.groupBy(*group).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), total).alias("average_precision")
    )


def macro_auroc(df: DataFrame, score: str, label: str, target: str, group: list[str] = ()) -> DataFrame:
    """ST-03: mean AUROC over the targets that have both classes."""
    per = auroc(df, score, label, [*group, target])
    return per.groupBy(*group).agg(F.avg("auroc").alias("macro_auroc"), F.count("auroc").alias("n_targets"))


def log_ratio(train: DataFrame, category: str, label: str, alpha: float = 0.5, universe: int | None = None, group: list[str] = ()) -> DataFrame:
    """ST-04, 05, 07: smoothed log-ratio of class 1 to class 0 by category.

    ``universe`` is the number of categories in the denominators: fixed, or those observed (None).
    Values are rounded to 12 digits, so that equal ratios of different counts tie.
    ``unseen`` is the value of a category without counts: by the same formula with a fixed
    universe, 0 otherwise.
    """
    group = list(group)
    counts = class_counts(train.where(F.col(category).isNotNull()), [*group, category], label).withColumn("one", F.lit(1).cast("long"))
    counts = with_totals(counts, group, ["n0", "n1", "one"])
    m = F.lit(universe) if universe else F.col("total_one")
    side = lambda n, c: F.log((n + alpha) / (F.col(f"total_{c}") + alpha * m))
    zero = F.lit(0)
    value = lambda n1, n0: F.round(side(n1, "n1") - side(n0, "n0"), 12)
    unseen = value(zero, zero) if universe else F.lit(0.0)
    return counts.select(*group, category, "n0", "n1", value(F.col("n1"), F.col("n0")).alias("log_ratio"), unseen.alias("unseen"))


def score_by(test: DataFrame, table: DataFrame, category: str, group: list[str] = (), unseen: bool = True) -> DataFrame:
    """FN-35, ST-05: test rows with log_ratio (``unseen`` of the group, or 0, where not learned) and a seen flag."""
    learned = table.select(*group, category, "log_ratio")
    joined = test.join(learned, [*group, category], "left").withColumn("seen", F.col("log_ratio").isNotNull().cast("int"))
    if not unseen:
        return joined.fillna(0.0, ["log_ratio"])
    rest = table.groupBy(*group).agg(F.max("unseen").alias("__unseen"))
    joined = joined.join(rest, list(group), "left") if group else joined.crossJoin(rest)  # one row
    return joined.withColumn("log_ratio", F.coalesce("log_ratio", "__unseen")).drop("__unseen")


def transfer(rows: DataFrame, side: str, train: str, test: str, category: str, label: str, alpha: float = 0.5, universe: int | None = 256) -> DataFrame:
    """ST-06: AUROC in the rows of ``test`` of log-ratios learned in those of ``train``; null with a single class."""
    table = log_ratio(rows.where(F.col(side) == train), category, label, alpha, universe)
    scored = score_by(rows.where(F.col(side) == test), table, category)
    return auroc(scored, "log_ratio", label).select(F.lit(train).alias("train"), F.lit(test).alias("test"), "n", "n_pos", "auroc")


def transfer_test(rows: DataFrame, side: str, train: str, test: str, category: str, label: str, replicates: int, seed: int, alpha: float = 0.5, universe: int | None = 256) -> DataFrame:
    """ST-06: ``transfer`` with the counts of both sides, a bootstrap interval over categories and the permutation p of the mapping.

    Interval and p are null where the AUROC is.
    """
    from .resample import cluster_bootstrap_auroc, interval, mapping_permutation

    learned = rows.where(F.col(side) == train)
    table = log_ratio(learned, category, label, alpha, universe)
    scored = stable(score_by(rows.where(F.col(side) == test), table, category))
    seen = auroc(scored, "log_ratio", label).crossJoin(scored.agg(F.count_if(F.col("seen") == 0).alias("n_unseen")))  # one row each
    ci = interval(cluster_bootstrap_auroc(scored, "log_ratio", label, category, replicates, seed), "auroc")
    dealt = mapping_permutation(scored, category, "log_ratio", label, replicates, seed + 1).withColumnRenamed("auroc", "__drawn")
    p = dealt.crossJoin(seen.select("auroc")).agg(((F.count_if(F.col("__drawn") >= F.col("auroc")) + 1) / (F.count("__drawn") + 1)).alias("p_upper"))  # one row
    n = learned.where(F.col(category).isNotNull()).agg(F.count("*").alias("n_train"))
    both = seen.crossJoin(ci.select("ci_low", "ci_high")).crossJoin(p).crossJoin(n)  # one row each
    known = lambda c: F.when(F.col("auroc").isNotNull(), F.col(c)).alias(c)
    return both.select(F.lit(train).alias("train"), F.lit(test).alias("test"), "n_train", "n", "n_pos", "n_unseen", "auroc", known("ci_low"), known("ci_high"), known("p_upper"))


def decomposed(table: DataFrame, x: str, y: str, w: str, component: str = "component", residual: str = "residual") -> DataFrame:
    """ST-08: ``table`` with the part of ``y`` that the weighted line on ``x`` explains, and the rest.

    The line is fitted where ``y`` is known and its weight positive; the component covers every row with ``x``.
    """
    line = weighted_line(table.where(F.col(w) > 0), x, y, w)
    joined = table.crossJoin(line.select(F.col("slope").alias("__b"), F.col("intercept").alias("__a")))  # one row
    part = F.col("__a") + F.col("__b") * F.col(x)
    return joined.withColumns({component: part, residual: F.col(y) - part}).drop("__a", "__b")


def category_auroc(scored: DataFrame, category: str, score: str, label: str, least: int = 20, group: list[str] = ()) -> DataFrame:
    """ST-07: AUROC of a fixed score inside each category; null below ``least`` rows or with a single class."""
    per = auroc(scored, score, label, [*group, category])
    return per.withColumn("auroc", F.when(F.col("n") >= least, F.col("auroc")))


def weighted_line(df: DataFrame, x: str, y: str, w: str, group: list[str] = ()) -> DataFrame:
    """ST-08: slope, intercept and weighted R-squared of y on x."""
    c = lambda e: F.sum(F.expr(e))
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(
        c(f"{w}").alias("sw"), c(f"{w}*{x}").alias("sx"), c(f"{w}*{y}").alias("sy"),
        c(f"{w}*{x}*{x}").alias("sxx"), c(f"{w}*{x}*{y}").alias("sxy"), c(f"{w}*{y}*{y}").alias("syy"),
    )
    vx, vxy, vy = F.expr("sxx - sx*sx/sw"), F.expr("sxy - sx*sy/sw"), F.expr("syy - sy*sy/sw")
    slope = F.try_divide(vxy, vx)
    return s.select(*group, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"), F.try_divide(vxy * vxy, vx * vy).alias("r2"))


def log_odds_table(counts: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """ST-09: corrected log odds, SE, OR, interval, z and p of 2x2 counts (a with and b without in class 1; c, d in class 0)."""
    p, q, r, s = (F.col(k) + 0.5 for k in (a, b, c, d))
    out = counts.withColumn("log_or", F.log(p * s / (q * r))).withColumn("se", F.sqrt(1 / p + 1 / q + 1 / r + 1 / s))
    z = F.col("log_or") / F.col("se")
    return out.withColumns({
        "odds_ratio": F.exp("log_or"), "ci_low": F.exp(F.col("log_or") - 1.96 * F.col("se")),
        "ci_high": F.exp(F.col("log_or") + 1.96 * F.col("se")), "z": z, "p": normal_p(z),
    })


def positional_log_odds(df: DataFrame, motif: str, label: str, group: list[str], letters: list[str], positions: dict[int, int]) -> DataFrame:
    """ST-09: log odds of each letter at each position (name to 1-based place), by group, with BH q by group."""
    # Letters are counted per position before the table of cells is spread.
    at = F.explode(F.array(*[F.struct(F.lit(name).alias("position"), F.substring(motif, place, 1).alias("found")) for name, place in positions.items()]))
    counted = df.select(*group, label, at.alias("c")).groupBy(*group, "c.position", "c.found").agg(
        F.count_if(F.col(label) == 1).alias("y1"), F.count_if(F.col(label) == 0).alias("y0")
    )
    spread = counted.withColumn("letter", F.explode(F.array(*[F.lit(x) for x in letters])))
    has = F.col("found") == F.col("letter")
    counted = spread.groupBy(*group, "position", "letter").agg(
        *[F.coalesce(F.sum(F.when(has if h else ~has, F.col(f"y{y}"))), F.lit(0)).alias(f"n{y}{int(h)}") for y in (1, 0) for h in (True, False)]
    )
    return bh_adjust(log_odds_table(counted, "n11", "n10", "n01", "n00"), "p", group)


def fit_scores(predictions: DataFrame, group: list[str], y: str, prediction: str, ranks: tuple[str, str] | None = None) -> DataFrame:
    """ST-23, AGG-18: R-squared, RMSE and correlation by group; Spearman's, of two columns of average ranks, if given."""
    e2 = F.sum((F.col(y) - F.col(prediction)) ** 2)
    n = F.count(y)
    total = F.sum(F.col(y) ** 2) - F.sum(y) * F.sum(y) / n
    extra = [F.corr(*ranks).alias("spearman")] if ranks else []
    return predictions.groupBy(*group).agg(
        n.alias("n"), (1 - F.try_divide(e2, total)).alias("r2"), F.sqrt(e2 / n).alias("rmse"), F.corr(y, prediction).alias("pearson"), *extra
    )


def r2_increments(performance: DataFrame, group: list[str], model: str, r2: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """ST-24: R-squared of the second model less that of the first, a column per pair."""
    models = sorted({m for p in pairs for m in p})
    wide = performance.groupBy(*group).pivot(model, models).agg(F.min(r2))
    return wide.select(*group, *[(F.col(b) - F.col(a)).alias(f"{b}_minus_{a}") for a, b in pairs])


def set_summary(df: DataFrame, flag: str, values: list[str]) -> DataFrame:
    """ST-25: n, mean and median of each value among flagged rows."""
    stats = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.percentile(F.col(v).cast("double"), F.lit(0.5)).alias(f"median_{v}"))]
    return df.where(F.col(flag)).agg(F.count("*").alias("n"), *stats)


def plus_one_effect(df: DataFrame, value: str, flag: str, least: tuple[int, int] = (5, 20), group: list[str] = ()) -> DataFrame:
    """ST-26: difference of median log1p between flagged rows and the rest, shifted if negative; null below ``least`` rows."""
    group = list(group)
    low = df.groupBy(*group).agg(F.least(F.min(value), F.lit(0.0)).alias("__low"))
    rows = df.join(low, group) if group else df.crossJoin(low)  # one row
    x = F.log1p(F.col(value) - F.col("__low"))
    side = lambda f: F.percentile(F.when(f, x), F.lit(0.5))
    is_, n1, n0 = F.col(flag), F.count(F.when(F.col(flag), F.col(value))), F.count(F.when(~F.col(flag), F.col(value)))
    return rows.groupBy(*group).agg(
        n1.alias("n_flagged"), n0.alias("n_rest"), F.when((n1 >= least[0]) & (n0 >= least[1]), side(is_) - side(~is_)).alias("effect")
    )


def with_subsets(df: DataFrame, subsets: dict[str, Column], out: str = "subset") -> DataFrame:
    """ST-27, ML-11: every row once per declared subset that it is in, so that one grouped analysis covers the grid."""
    return df.withColumn(out, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in subsets.items()]))))


def guarded(table: DataFrame, enough, columns: list[str]) -> DataFrame:
    """ST-29: a status of RUN or NOT_RUN; results of analyses without enough rows are null."""
    return table.withColumns({"status": F.when(enough, "RUN").otherwise("NOT_RUN")} | {c: F.when(enough, F.col(c)) for c in columns})


def monotone(table: DataFrame, order: str, value: str) -> bool:
    """QC-08: whether a value never falls along a small table's order."""
    values = [r[value] for r in table.orderBy(order).select(value).collect()]
    return all(a <= b for a, b in zip(values, values[1:], strict=False))
