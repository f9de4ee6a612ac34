"""Rankers that hold out a technology: weights, folds, fits, tuning, scoring and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from .fits import Task, fit_all, ranker
from .ranks import histogram, layered_percentile, percentile_ranks, running, with_totals
from .resample import draw, paired_difference, row_bootstrap
from .stats import auroc, auroc_of, macro_auroc, score_by
from .storage import stable

#: Inverse penalties that tuning tries (fixed values).
C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
LEAST_SCALE = 1e-12


def equal_weights(df: DataFrame, unit: str, out: str = "weight") -> DataFrame:
    """ML-01: every unit has the same total weight over its rows; mean weight 1."""
    counts = df.groupBy(unit).agg(F.count("*").alias("__n"))
    mean = counts.agg((F.count("*") / F.sum("__n")).alias("__mean"))
    joined = df.join(counts, unit).crossJoin(mean)  # one row
    return joined.withColumn(out, 1 / F.col("__n") / F.col("__mean")).drop("__n", "__mean")


def weighted_moments(df: DataFrame, features: list[str], weight: str) -> dict[str, tuple[float, float]]:
    """AGG-19: weighted mean and SD of each feature, in one pass; an SD of nearly 0 counts as 1."""
    w = F.col(weight)
    row = df.agg(
        F.sum(w).alias("w"), *[F.sum(w * F.col(f)).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(w * F.col(f) * F.col(f)).alias(f"q{i}") for i, f in enumerate(features)],
    ).first()
    out = {}
    for i, f in enumerate(features):
        mean = row[f"s{i}"] / row["w"]
        sd = max(row[f"q{i}"] / row["w"] - mean * mean, 0.0) ** 0.5
        out[f] = (mean, sd if sd > LEAST_SCALE else 1.0)
    return out


def fit_ranker(train: DataFrame, features: list[str], label: str, unit: str, c: float) -> list[dict]:
    """ML-02, 06: weighted L2 logistic on standardised features; rows of feature, coefficient, mean and scale, and an intercept."""
    rows = equal_weights(train.dropna(subset=[*features, label]), unit).select(label, "weight", *features).persist()
    moments = weighted_moments(rows, features, "weight")
    scaled = rows.select(
        F.col(label).cast("double").alias("label"), "weight", *[((F.col(f) - m) / s).alias(f"x{i}") for i, (f, (m, s)) in enumerate(moments.items())]
    )
    total = rows.agg(F.sum("weight").alias("w")).first()["w"]
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(features))], outputCol="features").transform(scaled)
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=300, tol=1e-9
    ).fit(data)
    rows.unpersist()
    out = [
        {"feature": f, "coefficient": float(b), "mean": m, "scale": s} for (f, (m, s)), b in zip(moments.items(), model.coefficients, strict=True)
    ]
    return [*out, {"feature": "(intercept)", "coefficient": float(model.intercept), "mean": 0.0, "scale": 1.0}]


def linear_score(model: list[dict]) -> Column:
    """ML-07: the score of a coefficient table as one expression."""
    out = F.lit(0.0)
    for r in model:
        out = out + (F.lit(r["coefficient"]) if r["feature"] == "(intercept)" else (F.col(r["feature"]).cast("double") - r["mean"]) / r["scale"] * r["coefficient"])
    return out


def with_score(df: DataFrame, model: list[dict], out: str = "score") -> DataFrame:
    """ML-07: ``df`` with its score; ValueError if a feature is missing."""
    if missing := sorted({r["feature"] for r in model} - {"(intercept)", *df.columns}):
        raise ValueError(f"missing features: {missing}")
    return df.withColumn(out, linear_score(model))


def grouped_folds(df: DataFrame, unit: str, k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    """ML-03, 12: folds from a hash of the unit, so that units stay whole and every table agrees."""
    return df.withColumn(out, F.pmod(draw(seed, unit), F.lit(k)).cast("int"))


def dealt_folds(units: DataFrame, unit: str, k: int, seed: int) -> DataFrame:
    """ML-12: units in hash order, dealt to k folds whose sizes differ by one at most."""
    from .resample import numbered

    ordered = units.select(unit).distinct().withColumn("__d", draw(seed, unit))
    return numbered(ordered, ["__d", unit], "__i").select(unit, (F.col("__i") % k).cast("int").alias("fold"))


def _scoped(tasks: DataFrame, scopes: dict, label: str, unit: str, target: str, folds: int) -> tuple[DataFrame, dict]:
    """A table of the tasks with, per scope, the weights w<i> of its training rows and their folds d<i>.

    ``scopes`` maps a name to features and the target left out (None: none). A row's weight is one
    by its unit's training rows. Also returns (i, usable folds) by scope; a fold is usable if the
    rows outside it have both classes.
    """
    from .resample import numbered

    features = sorted({f for fs, _ in scopes.values() for f in fs})
    # A row's target may be null: it is left out by no scope that names one, and trains none of them.
    trains = [F.lit(True) if t is None else F.coalesce(F.col(target) != t, F.lit(False)) for _, t in scopes.values()]
    whole = [c & F.col(label).isNotNull() & _all_known(fs) for c, (fs, _) in zip(trains, scopes.values(), strict=True)]
    base = tasks.select(*dict.fromkeys([unit, target, label, *features]))
    per = base.groupBy(unit).agg(*[F.count_if(c).alias(f"__n{i}") for i, c in enumerate(whole)], *[F.count_if(c).alias(f"__t{i}") for i, c in enumerate(trains)])
    spread = per.withColumn("scope", F.explode(F.array_compact(F.array(*[F.when(F.col(f"__t{i}") > 0, F.lit(i)) for i in range(len(scopes))]))))
    dealt = numbered(spread.select("scope", F.col(unit).alias("__u"), draw(0, unit).alias("__d")), ["__d", "__u"], "__i", ["scope"])
    held = dealt.groupBy("__u").agg(*[F.max(F.when(F.col("scope") == i, F.col("__i") % folds)).cast("int").alias(f"d{i}") for i in range(len(scopes))])
    joined = base.join(per, unit).join(held, F.col(unit) == F.col("__u")).drop("__u")
    table = stable(joined.select(
        *base.columns, *[F.col(f"d{i}") for i in range(len(scopes))],
        *[F.when(c, 1.0 / F.col(f"__n{i}")).otherwise(0.0).alias(f"w{i}") for i, c in enumerate(whole)], *[c.alias(f"t{i}") for i, c in enumerate(trains)],
    ))
    counts = F.array(*[F.struct(F.lit(i).alias("scope"), F.col(f"d{i}").alias("fold"), F.col(f"t{i}").alias("there")) for i in range(len(scopes))])
    classes = table.select(label, F.explode(counts).alias("s")).where("s.there").groupBy("s.scope", "s.fold").agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).collect()
    usable = {}
    for i, name in enumerate(scopes):
        own = [r for r in classes if r["scope"] == i]
        pos, n = sum(r["pos"] or 0 for r in own), sum(r["n"] for r in own)
        usable[name] = i, sorted(r["fold"] for r in own if 0 < pos - (r["pos"] or 0) < n - r["n"])
    return table, usable


def _all_known(features: list[str]) -> Column:
    return F.forall(F.array(*[F.col(f).cast("double") for f in features]), lambda x: x.isNotNull() & ~F.isnan(x)) if features else F.lit(True)


def _tuned(table: DataFrame, usable: dict, scopes: dict, label: str, target: str, grid) -> dict[str, tuple[float, list[dict]]]:
    """ML-04 for every scope at once: the chosen C and the record of the grid."""
    grid = sorted(map(float, grid))
    asked = [(name, f, c) for name, (_, folds) in usable.items() for f in folds for c in grid]
    fits = fit_all(table, [Task(tuple(scopes[name][0]), f"w{usable[name][0]}", label, c, f"d{usable[name][0]}", f) for name, f, c in asked])
    models = dict(zip(asked, map(ranker, fits), strict=True))
    scores = []
    for name, (i, folds) in usable.items():
        for c in grid:
            score = F.lit(None).cast("double")
            for f in folds:
                score = F.when(F.col(f"d{i}") == f, linear_score(models[name, f, c])).otherwise(score)
            scores.append(F.struct(F.lit(i).alias("scope"), F.lit(c).alias("C"), F.col(f"d{i}").alias("fold"), F.when(F.col(f"t{i}"), score).alias("score")))
    held = table.select(target, label, F.explode(F.array(*scores)).alias("s")).select(target, label, "s.*").where(F.col("score").isNotNull())
    macro = macro_auroc(held, "score", label, target, ["scope", "C", "fold"]).groupBy("scope", "C").agg(F.avg("macro_auroc").alias("macro_auroc"), F.count("macro_auroc").alias("folds"))
    found = {(r["scope"], r["C"]): r for r in macro.collect()}
    out = {}
    for name, (i, _) in usable.items():
        rows = [{"C": c, "macro_auroc": found[i, c]["macro_auroc"] if (i, c) in found else None, "folds": found[i, c]["folds"] if (i, c) in found else 0} for c in grid]
        scored = [r for r in rows if r["macro_auroc"] is not None]
        out[name] = next((r["C"] for r in scored if r["macro_auroc"] >= max(x["macro_auroc"] for x in scored) - 1e-10), min(grid)), rows
    return out


def tune(train: DataFrame, features: list[str], label: str, unit: str, target: str, grid=C_GRID, folds: int = 5) -> tuple[float, list[dict]]:
    """ML-04: the C with the best mean macro AUROC over folds; a tie goes to the smallest. Folds with one class are skipped.

    Units stay whole, and folds are dealt so that their numbers of units differ by one at most. The
    fits of all folds and C go in the same rounds (``fits``), all held-out scores of the grid are
    columns of one table, and all their AUROCs come from one pass.
    """
    scopes = {"all": (list(features), None)}
    table, usable = _scoped(train, scopes, label, unit, target, folds)
    return _tuned(table, usable, scopes, label, target, grid)["all"]


#: A target list longer than this isn't fitted.
MOST_TARGETS = 50


def _alike(tasks: DataFrame, scopes: dict, label: str, unit: str, target: str) -> DataFrame:
    """(target, label, features, __rows, w<i>, n<i>): rows alike in these, and for each scope those that train it and their weight.

    A row's weight is one by its unit's training rows. A fit or an AUROC needs no more than these sums,
    and no folds, so rows are shuffled once, by unit.
    """
    columns = list(dict.fromkeys([target, label, *sorted({f for fs, _ in scopes.values() for f in fs})]))
    known = F.col(label).isNotNull() & F.col(unit).isNotNull()
    whole = [known & _all_known(fs) & (F.lit(True) if t is None else F.coalesce(F.col(target) != t, F.lit(False))) for fs, t in scopes.values()]
    own = Window.partitionBy(unit)
    rows = tasks.select(*dict.fromkeys([unit, *columns]))
    rows = rows.select(*columns, *[F.when(c, 1.0 / F.count_if(c).over(own)).alias(f"w{i}") for i, c in enumerate(whole)])
    sums = [x for i in range(len(whole)) for x in (F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"w{i}"), F.count(f"w{i}").alias(f"n{i}"))]
    return stable(rows.groupBy(*columns).agg(F.count("*").alias("__rows"), *sums))


def _left_out(tasks: DataFrame, feature_sets: dict[str, list[str]], label: str, unit: str, target: str, c: float | None, grid, folds: int = 5) -> tuple[dict[str, Column], DataFrame | None]:
    """By feature set, the score of each row by a ranker that never saw its target; all fits in the same rounds.

    With ``c`` given also the table of ``_alike``, which the fits use then.
    """
    targets = [r[0] for r in tasks.select(target).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(MOST_TARGETS + 1).collect()]
    if len(targets) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} values of {target}")
    scopes = {(name, t): (features, t) for name, features in feature_sets.items() for t in targets}
    if not scopes:
        return {name: F.lit(None).cast("double") for name in feature_sets}, None
    alike = None
    if c is not None:
        alike = _alike(tasks, scopes, label, unit, target)
        fits = fit_all(alike, [Task(tuple(fs), f"w{i}", label, c, count=f"n{i}") for i, (fs, _) in enumerate(scopes.values())])
    else:
        table, usable = _scoped(tasks, scopes, label, unit, target, folds)
        chosen = {s: best for s, (best, _) in _tuned(table, usable, scopes, label, target, grid).items()}
        fits = fit_all(table, [Task(tuple(fs), f"w{usable[s][0]}", label, chosen[s]) for s, (fs, _) in scopes.items()])
    models = dict(zip(scopes, map(ranker, fits), strict=True))
    out = {}
    for name in feature_sets:
        score = F.lit(None).cast("double")
        for t in targets:
            score = F.when(F.col(target) == t, linear_score(models[name, t])).otherwise(score)
        out[name] = score
    return out, alike


def leave_target_out(tasks: DataFrame, features: list[str], label: str, unit: str, target: str, c: float | None = None, grid=C_GRID) -> DataFrame:
    """ML-05: every task row scored by a ranker that never saw its target; C is tuned on the other targets unless given.

    Rows without a target stay, unscored. More than ``MOST_TARGETS`` targets are an error.
    """
    return tasks.withColumn("score", _left_out(tasks, {"all": features}, label, unit, target, c, grid)[0]["all"])


def model_comparison(tasks: DataFrame, feature_sets: dict[str, list[str]], label: str, unit: str, target: str, c: float | None = None, grid=C_GRID) -> DataFrame:
    """ML-05: (model, target, n, n_pos, auroc) of every feature set, each target scored by rankers that never saw it."""
    scores, alike = _left_out(tasks, feature_sets, label, unit, target, c, grid)
    each = F.array(*[F.struct(F.lit(name).alias("model"), score.alias("score")) for name, score in scores.items()])
    rows = tasks.withColumn("__rows", F.lit(1).cast("long")) if alike is None else alike
    rows = rows.select(target, F.col(label).cast("long").alias("y"), "__rows", F.explode(each).alias("m")).select(target, "y", "__rows", "m.*").where("score is not null and y is not null")
    hist = rows.groupBy("model", target, "score").agg(F.sum(F.col("__rows") * F.col("y")).alias("pos"), F.sum(F.col("__rows") * (1 - F.col("y"))).alias("neg"))
    return auroc_of(hist, "score", ["model", target]).select("model", target, "n", "n_pos", "auroc")


def measures(df: DataFrame, score: str, label: str, fractions: tuple[float, ...] = (0.1, 0.2), budgets: tuple[int, ...] = (50, 100, 200), group: list[str] = ()) -> DataFrame:
    """ML-08: n, positives, prevalence, AUROC, AP, precision and lift of top shares (ties at the edge included), expected
    positives and lift of budgets (ties at the edge exchangeable), by group; a row in any case if there is no group.

    One histogram by score with running sums from the greatest score down, of which all are aggregates:
    the rows are shuffled once. Null scores and labels take no part.
    """
    group = list(group)
    hist = histogram(df, group, score, label)
    cut = running(with_totals(hist, group, ["n", "pos"]), group, [F.col(score).desc()], ["n", "pos"])
    n, pos, before = F.sum("n"), F.sum("pos"), F.col("cum_n") - F.col("n")
    neg_below = F.col("total_n") - F.col("total_pos") - (F.col("cum_n") - F.col("cum_pos"))
    prevalence = F.max("total_pos") / F.max("total_n")
    out = [
        F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(pos, F.lit(0)).alias("n_pos"), prevalence.alias("prevalence"),
        F.try_divide(F.sum(F.col("pos") * (neg_below + F.col("neg") / 2)), pos.cast("double") * F.sum("neg")).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")), pos).alias("average_precision"),
    ]
    for f in fractions:
        inside = before < F.greatest(F.ceil(F.lit(f) * F.col("total_n")), F.lit(1))
        precision = F.sum(F.when(inside, F.col("pos"))) / F.sum(F.when(inside, F.col("n")))
        out += [precision.alias(f"precision_{f:g}"), F.try_divide(precision, prevalence).alias(f"lift_{f:g}")]
    for k in budgets:
        most = F.least(F.lit(k), F.col("total_n"))
        picked = F.when(before < most, F.least(F.col("n"), most - before) * F.col("pos") / F.col("n"))
        out += [F.sum(picked).alias(f"expected_{k}"), F.try_divide(F.sum(picked) / F.max(most), prevalence).alias(f"expected_lift_{k}")]
    return cut.groupBy(*group).agg(*out)


def evaluate(df: DataFrame, score: str, label: str, key: str, replicates: int = 200, seed: int = 1) -> dict:
    """ML-08: ``measures`` with intervals of AUROC and of the lift of the top tenth, and the share of replicates above one half."""
    out = measures(df, score, label).first().asDict()
    boot = row_bootstrap(df, [score], label, key, replicates, seed, fraction=0.1)
    low = lambda c, p: F.percentile(F.col(f"{c}_{score}"), F.lit(p))
    found = boot.agg(
        low("auroc", 0.025).alias("auroc_low"), low("auroc", 0.975).alias("auroc_high"), F.avg((F.col(f"auroc_{score}") > 0.5).cast("double")).alias("auroc_above_half"),
        low("lift", 0.025).alias("lift_low"), low("lift", 0.975).alias("lift_high"),
    )
    return out | found.first().asDict()


#: Thresholds of the development choice: a model is useful from the first three on, the larger one gains from the last two on (fixed values).
USEFUL_AUROC, USEFUL_LOW, USEFUL_LIFT, GAIN, GAIN_SHARE = 0.58, 0.50, 1.15, 0.02, 0.80


def development_choice(auroc_: dict[str, Column], low: dict[str, Column], lift: dict[str, Column], gain: Column, gain_share: Column) -> list[Column]:
    """ML-10: status and choice between a ``full`` and a ``simple`` model, given by those keys in each mapping.

    ``lift`` is that of the top tenth, ``gain`` the difference of the two AUROCs, and ``gain_share`` the
    share of its bootstrap above 0. Unknown values count as not reached.
    """
    useful = {m: F.coalesce((auroc_[m] >= USEFUL_AUROC) & (low[m] > USEFUL_LOW) & (lift[m] >= USEFUL_LIFT), F.lit(False)) for m in ("full", "simple")}
    gains = F.coalesce((gain >= GAIN) & (gain_share >= GAIN_SHARE), F.lit(False))
    pick = lambda both, full, simple, none: F.when(useful["full"] & gains, both).when(useful["full"], full).when(useful["simple"], simple).otherwise(none)
    status = pick("READY_FOR_LOCKBOX", "USEFUL_WITH_MODEST_GAIN", "SIMPLE_MODEL_ONLY", "NO_USEFUL_RANKING")
    return [status.alias("status"), pick("full", "full_qualified", "simple", "none").alias("selected")]


#: Thresholds of the lockbox: positives, AUROC, its lower limit and lift of the top fifth for the strong verdict;
#: positives, AUROC, share of the bootstrap above one half and lift of either top share for the weaker one (fixed values).
STRONG = (15, 0.60, 0.50, 1.20)
SUPPORTIVE = (10, 0.55, 0.90, 1.15)


def lockbox_verdict(n_pos: Column, auroc_: Column, low: Column, above_half: Column, lift10: Column, lift20: Column) -> Column:
    """ML-10: what an untouched evaluation says: too few positives, validated, supported or not confirmed."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    strong = sure((n_pos >= STRONG[0]) & (auroc_ >= STRONG[1]) & (low > STRONG[2]) & (lift20 >= STRONG[3]))
    lifted = sure(lift10 >= SUPPORTIVE[3]) | sure(lift20 >= SUPPORTIVE[3])
    supportive = sure((n_pos >= SUPPORTIVE[0]) & (auroc_ >= SUPPORTIVE[1]) & (above_half >= SUPPORTIVE[2])) & lifted
    return (
        F.when(sure(n_pos < SUPPORTIVE[0]) | n_pos.isNull(), "INCONCLUSIVE_LOW_POWER").when(strong, "EXTERNALLY_VALIDATED")
        .when(supportive, "EXTERNALLY_SUPPORTED").otherwise("NOT_CONFIRMED")
    )


def decide(spark: SparkSession, development: DataFrame, lockbox: DataFrame, full: str, simple: str, label: str, key: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """ML-10: the development choice between two scores, and the lockbox verdict on the one chosen; one row.

    Both scores are evaluated on ``development`` and compared over shared draws; ``lockbox`` is looked
    at only if one of them is chosen, with that score. Without a choice the verdict is null.
    """
    seen = {name: evaluate(development, score, label, key, replicates, seed) for name, score in (("full", full), ("simple", simple))}
    paired = paired_difference(development, (simple, full), label, key, replicates, seed).first()
    gain = None if None in (seen["full"]["auroc"], seen["simple"]["auroc"]) else seen["full"]["auroc"] - seen["simple"]["auroc"]
    of = lambda measure: {name: F.lit(e[measure]).cast("double") for name, e in seen.items()}
    number = lambda x: F.lit(x).cast("double")
    choice = development_choice(of("auroc"), of("auroc_low"), of("lift_0.1"), number(gain), number(paired["p_above_0"]))
    status, selected = spark.range(1).select(*choice).first()
    out = [number(gain).alias("gain"), number(paired["p_above_0"]).alias("gain_share"), F.lit(status).alias("status"), F.lit(selected).alias("selected")]
    if selected == "none":
        return spark.range(1).select(*out, F.lit(None).cast("long").alias("n_pos"), number(None).alias("auroc"), F.lit(None).cast("string").alias("verdict"))
    held = evaluate(lockbox, simple if selected == "simple" else full, label, key, replicates, seed)
    n_pos = F.lit(held["n_pos"]).cast("long")
    verdict = lockbox_verdict(n_pos, *[number(held[m]) for m in ("auroc", "auroc_low", "auroc_above_half", "lift_0.1", "lift_0.2")])
    return spark.range(1).select(*out, n_pos.alias("n_pos"), number(held["auroc"]).alias("auroc"), verdict.alias("verdict"))


def alignment_diagnostic(tasks: DataFrame, alignment: str, label: str, target: str) -> DataFrame:
    """ML-09: AUROC of the negative alignment among rows of breadth 1, by target."""
    rows = tasks.where("source_breadth = 1").withColumn("__score", -F.col(alignment))
    return auroc(rows, "__score", label, [target])


def heldout_benchmark(union: DataFrame, technologies: list[str], label: str) -> DataFrame:
    """ML-19: support flags as sources of a held-out platform, without a mask."""
    sources = {f"source_{t}": F.col(f"{t}_support") for t in technologies}
    fields = fn.source_fields({t: F.col(f"{t}_support") for t in technologies})
    return union.select("*", *[c.alias(n) for n, c in sources.items()], *fields, F.col(label).alias("target_reported")).drop(
        "breadth", "pattern", *[f"{t}_support" for t in technologies]
    )


def scorecard(df: DataFrame, score: str, pattern: str = "source_pattern") -> DataFrame:
    """ML-20: percentile of the score among all rows and within the pattern."""
    return percentile_ranks(percentile_ranks(df, score, out="global_percentile"), score, [pattern], out="within_pattern_percentile")


def site_features(sites: DataFrame, fingerprint: DataFrame, technologies: list[str], direction: tuple[str, str]) -> DataFrame:
    """Validated sources, motif, domain and sequence features of a user's sites.

    Sources come as 0/1 columns source_<technology> or as one column ``source_assay``. ValueError
    if a value is neither, or a row has no source. ``fingerprint`` has motif and log_ratio.
    """
    flags = [f"source_{t}" for t in technologies]
    if set(flags) <= set(sites.columns):
        rows = sites.withColumns({f: fn.to_integer(F.col(f).cast("string")).cast("int") for f in flags})
    elif "source_assay" in sites.columns:
        assay = F.upper(F.trim("source_assay"))
        rows = sites.withColumns({f"source_{t}": F.when(assay.isin(*technologies), (assay == t).cast("int")) for t in technologies})
    else:
        raise ValueError(f"the input needs source_assay or all of {flags}")
    wrong = F.lit(False)
    for f in flags:
        wrong = wrong | F.col(f).isNull() | ~F.col(f).isin(0, 1)
    breadth, pattern = fn.source_fields({t: F.col(f"source_{t}") for t in technologies})
    rows = rows.withColumns({"source_breadth": breadth, "source_pattern": pattern, "motif": fn.rna("motif")})
    bad = rows.agg(F.count_if(wrong).alias("flags"), F.count_if(F.col("source_breadth") < 1).alias("empty")).first()
    if bad["flags"] or bad["empty"]:
        raise ValueError(f"{bad['flags']} rows with a source that is unknown, {bad['empty']} without a source")
    rows = score_by(rows, fingerprint, "motif", unseen=False).withColumnRenamed("log_ratio", "fp").withColumnRenamed("seen", "fp_seen")
    return rows.withColumns({
        "domain_status": fn.domain_status(F.col("motif")), "fp_abs": F.abs("fp"),
        "fp_source_alignment": F.col("fp") * (F.col(f"source_{direction[0]}") - F.col(f"source_{direction[1]}")),
    }).select("*", *fn.flank_onehot(F.col("motif")))


def score_sites(sites: DataFrame, model: list[dict], fingerprint: DataFrame, reference: DataFrame, technologies: list[str],
                direction: tuple[str, str], domain_guard: bool = True) -> DataFrame:
    """ML-18: the scorer: features, score inside the domain, reference and within-input percentiles, labels.

    ``reference`` has score, source_pattern and source_breadth. Rows outside the domain stay,
    unscored. Without ``domain_guard`` every row is scored.
    """
    rows = with_score(site_features(sites, fingerprint, technologies, direction), model, "__raw")
    inside = F.col("domain_status") == "in_validated_domain"
    rows = rows.withColumn("score", F.when(inside | F.lit(not domain_guard), F.col("__raw"))).drop("__raw")
    rows = layered_percentile(rows, reference, "score", "source_pattern", "source_breadth")
    rows = percentile_ranks(rows, "score", ["source_pattern"], out="within_input_percentile")
    return rows.select("*", *fn.evidence_labels(F.col("domain_status"), F.col("source_breadth")), fn.priority_band(F.col("reference_percentile")).alias("priority"))


def running_rank(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """WIN-11: a deterministic place within each (small) group of a result table."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
