"""Regressions as sums: Spark gathers Gram matrices and scores, the driver solves K by K systems."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import chi2_tail, t_quantile, t_tail
from .fits import Task, fit_all, gather, moments


@dataclass
class Fit:
    """Coefficients and their covariance."""

    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int

    def rows(self, exponentiate: bool = True) -> list[dict]:
        out = []
        for term, b, v in zip(self.terms, self.beta, np.diag(self.cov), strict=True):
            se = math.sqrt(max(v, 0.0))
            z = float(b / se) if se > 0 else None
            row = {"term": term, "beta": float(b), "se": se, "z": z, "p": None if z is None else math.erfc(abs(z) / math.sqrt(2))}
            lo, hi = b - 1.96 * se, b + 1.96 * se
            if exponentiate:
                row |= {"odds_ratio": math.exp(b), "ci_low": math.exp(lo), "ci_high": math.exp(hi)}
            else:
                row |= {"ci_low": float(lo), "ci_high": float(hi)}
            out.append(row | {"n": self.n, "n_clusters": self.clusters})
        return out

    def table(self, spark: SparkSession, exponentiate: bool = True) -> DataFrame:
        last = "odds_ratio double, ci_low double, ci_high double" if exponentiate else "ci_low double, ci_high double"
        return spark.createDataFrame(
            [tuple(r.values()) for r in self.rows(exponentiate)], f"term string, beta double, se double, z double, p double, {last}, n long, n_clusters long"
        )

    def contrast(self, a: str, b: str) -> dict:
        """ST-14: the difference of two coefficients, from the covariance."""
        i, j = self.terms.index(a), self.terms.index(b)
        diff, se = float(self.beta[i] - self.beta[j]), math.sqrt(max(self.cov[i, i] + self.cov[j, j] - 2 * self.cov[i, j], 0.0))
        return contrast_row(f"{a}_minus_{b}", diff, se)

    def wald(self, terms: list[str]) -> dict:
        """ST-18: joint chi-square test of some coefficients."""
        at = [self.terms.index(t) for t in terms]
        stat = float(self.beta[at] @ np.linalg.pinv(self.cov[np.ix_(at, at)]) @ self.beta[at])
        return {"chi2": stat, "df": len(at), "p": chi2_tail(stat, len(at))}


def contrast_row(name: str, diff: float, se: float) -> dict:
    z = diff / se if se > 0 else None
    return {
        "contrast": name, "beta_difference": diff, "se": se, "z": z, "p": None if z is None else math.erfc(abs(z) / math.sqrt(2)),
        "ratio": math.exp(diff), "ci_low": math.exp(diff - 1.96 * se), "ci_high": math.exp(diff + 1.96 * se),
    }


def _unpack(row, prefix: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"{prefix}{i}_{j}"]
    return out


def _products(xs: list[Column], weight: Column, prefix: str) -> list[Column]:
    return [F.sum(weight * xs[i] * xs[j]).alias(f"{prefix}{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]


def _sandwich(scores: DataFrame, cluster: str, k: int) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their score sums; ``scores`` has s0..s(k-1)."""
    per = scores.groupBy(cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    row = per.agg(*_products([F.col(f"s{i}") for i in range(k)], F.lit(1.0), "m"), F.count("*").alias("g")).first()
    return _unpack(row, "m", k), row["g"]


def logistic_cluster(df: DataFrame, outcome: str, predictors: list[str], cluster: str, rounds: int = 200, tol: float = 1e-9) -> Fit:
    """ST-12, 13: logistic regression by reweighted least squares, SE robust to clusters.

    Rows with a null take no part; interactions are columns of their own. Equal covariates are
    collapsed first; every round is one aggregate of K(K+1)/2 + K sums. ValueError with a single class.
    """
    known = df.select(outcome, *predictors, F.col(cluster).cast("string").alias("__c")).dropna()
    columns = [F.col(p).cast("double").alias(f"x{i + 1}") for i, p in enumerate(predictors)]
    rows = known.select("__c", F.col(outcome).cast("double").alias("y"), F.lit(1.0).alias("x0"), *columns)
    k = len(predictors) + 1
    names = [f"x{i}" for i in range(k)]
    xs = [F.col(x) for x in names]
    cells = rows.groupBy("__c", *names).agg(F.count("*").cast("double").alias("w"), F.sum("y").alias("y")).persist()
    flat = cells.groupBy(*names).agg(F.sum("w").alias("w"), F.sum("y").alias("y")).persist()
    try:
        size = flat.agg(F.sum("w").alias("n"), F.sum("y").alias("pos")).first()
        if not size["n"] or size["pos"] in (0.0, size["n"]):
            raise ValueError(f"{outcome} has only one class")
        beta = np.zeros(k)

        def probability(b: np.ndarray) -> Column:
            eta = sum((float(b[i]) * xs[i] for i in range(k)), F.lit(0.0))
            return 1 / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))

        def information(b: np.ndarray):
            p = probability(b)
            w = F.greatest(p * (1 - p), F.lit(1e-8)) * F.col("w")
            row = flat.agg(*_products(xs, w, "h"), *[F.sum((F.col("y") - F.col("w") * p) * x).alias(f"g{i}") for i, x in enumerate(xs)]).first()
            return _unpack(row, "h", k), np.array([row[f"g{i}"] for i in range(k)])

        for _ in range(rounds):
            h, g = information(beta)
            step = np.linalg.pinv(h) @ g
            beta = beta + step
            if np.abs(step).max() < tol:
                break
        bread = np.linalg.pinv(information(beta)[0])
        resid = F.col("y") - F.col("w") * probability(beta)
        meat, clusters = _sandwich(cells.select("__c", *[(resid * x).alias(f"s{i}") for i, x in enumerate(xs)]), "__c", k)
        n = int(size["n"])
        fix = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
        return Fit(["intercept", *predictors], beta, bread @ meat @ bread * fix, n, clusters)
    finally:
        flat.unpersist()
        cells.unpersist()


def with_interaction(df: DataFrame, x: str, group: str, level: str, out: str) -> DataFrame:
    """ST-13: ``df`` with an indicator ``<out>`` of a group's level and its product ``<x>_x_<out>`` with a predictor."""
    flag = (F.col(group) == level).cast("double")
    return df.withColumns({out: flag, f"{x}_x_{out}": F.col(x).cast("double") * flag})


def label_models(df: DataFrame, labels: str, declared: list[str], predictors: list[str], cluster: str, effect: str, least: int = 20) -> list[dict]:
    """ST-15: the ``effect`` term of a model for each declared label of an array column, with BH q across labels.

    Labels with fewer than ``least`` rows, or that all rows have, are left out. All labels go in the
    same rounds (``fits``), over cells of equal predictors and cluster.
    """
    return _labels_of(df, labels, declared, {"": (F.lit(True), predictors)}, cluster, effect, least)[""]


def single_label_models(df: DataFrame, labels: str, declared: list[str], scopes: dict[str, tuple[Column, list[str]]], cluster: str, effect: str, least: int = 10) -> list[dict]:
    """ST-28: which label a row has, among rows with exactly one, by scope (a condition and its predictors); BH q within each scope."""
    found = _labels_of(df.where(F.size(labels) == 1), labels, declared, scopes, cluster, effect, least)
    return [{"scope": name} | r for name, rows in found.items() for r in rows]


def _labels_of(df: DataFrame, labels: str, declared: list[str], scopes: dict[str, tuple[Column, list[str]]], cluster: str, effect: str, least: int) -> dict[str, list[dict]]:
    held = F.coalesce(F.col(labels), F.array().cast(df.schema[labels].dataType))
    inside = [F.coalesce(keep, F.lit(False)) for keep, _ in scopes.values()]
    has = [F.array_contains(held, v) for v in declared]
    counts = df.agg(
        *[F.count_if(c & h).alias(f"n{i}_{j}") for i, c in enumerate(inside) for j, h in enumerate(has)], *[F.count_if(c).alias(f"n{i}") for i, c in enumerate(inside)]
    ).first()
    used = sorted({p for _, ps in scopes.values() for p in ps})
    names = {p: f"x{i}" for i, p in enumerate(used)}
    known = [c & F.forall(F.array(*[F.col(p).cast("double") for p in ps]), lambda x: x.isNotNull()) & F.col(cluster).isNotNull() for c, (_, ps) in zip(inside, scopes.values(), strict=True)]
    cells = df.groupBy(F.col(cluster).cast("string").alias("__c"), *[F.col(p).cast("double").alias(n) for p, n in names.items()]).agg(
        *[F.count_if(k).cast("double").alias(f"w{i}") for i, k in enumerate(known)], *[F.count_if(k & h).cast("double").alias(f"y{i}_{j}") for i, k in enumerate(known) for j, h in enumerate(has)]
    ).persist()
    try:
        wanted = [(i, j, name) for i, name in enumerate(scopes) for j in range(len(declared)) if least <= counts[f"n{i}_{j}"] < counts[f"n{i}"]]
        tasks = [Task(tuple(names[p] for p in scopes[name][1]), f"w{i}", f"y{i}_{j}", trials=True) for i, j, name in wanted]
        sizes = moments(cells, [Task(t.features, t.weight, t.weight, trials=True) for t in tasks])
        fits = _clustered(cells, tasks, fit_all(cells, tasks), [int(m["weight"]) for m in sizes])
    finally:
        cells.unpersist()
    out: dict[str, list[dict]] = {name: [] for name in scopes}
    for (i, j, name), fit in zip(wanted, fits, strict=True):
        fit.terms = ["intercept", *scopes[name][1]]
        row = next(r for r in fit.rows() if r["term"] == effect)
        out[name].append({"label": declared[j], "cases": counts[f"n{i}_{j}"]} | row)
    for rows in out.values():
        for r, q in zip(rows, bh([r["p"] for r in rows]), strict=True):
            r["q"] = q
    return out


def _clustered(cells: DataFrame, tasks: list[Task], states: list, sizes: list[int]) -> list[Fit]:
    """Fits of cells (trials and successes) with covariances robust to the clusters ``__c``, in one job."""
    sums, starts, at = [], [], 0
    for t, s in zip(tasks, states, strict=True):
        xs = [F.lit(1.0), *[F.col(x) for x in t.features]]
        eta = sum((float(b) * x for b, x in zip(s.beta, xs, strict=True)), F.lit(0.0))
        resid = F.col(t.label) - F.col(t.weight) / (1 + F.exp(-F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))
        there = F.col(t.weight) > 0
        sums += [F.sum(F.when(there, resid * x)).alias(f"s{at + i}") for i, x in enumerate(xs)]
        starts.append((at, len(xs)))
        at += len(xs)
    if not tasks:
        return []

    def kernel(f: pd.DataFrame):
        for i, (first, k) in enumerate(starts):
            v = f[[f"s{first + j}" for j in range(k)]].to_numpy(float)
            v = v[~np.isnan(v).any(axis=1)]
            yield i, np.concatenate(([len(v)], (v.T @ v).ravel()))

    out = []
    for t, s, n, found in zip(tasks, states, sizes, gather(cells.groupBy("__c").agg(*sums), kernel, len(tasks)), strict=True):
        k, clusters = len(s.beta), int(found[0])
        bread = np.linalg.pinv(s.hessian)
        fix = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
        out.append(Fit(["intercept", *t.features], s.beta, bread @ found[1:].reshape(k, k) @ bread * fix, n, clusters))
    return out


def bh(p: list[float | None]) -> list[float | None]:
    """Benjamini-Hochberg q of a short list; null stays null and doesn't count."""
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    out: list[float | None] = [None] * len(p)
    least = 1.0
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        least = min(least, x * len(known) / rank)
        out[i] = least
    return out


#: Most levels of a fixed effect.
MOST_LEVELS = 200


def dataset_design(df: DataFrame, dataset: str, slopes: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
    """ST-16, 18: ``df`` with an indicator per dataset but the first, and one per product with each of ``slopes``.

    Also the names of the indicators and of the products. ValueError beyond ``MOST_LEVELS`` datasets.
    """
    levels = [r[0] for r in df.select(dataset).where(F.col(dataset).isNotNull()).distinct().orderBy(dataset).limit(MOST_LEVELS + 1).collect()]
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} values of {dataset}")
    flags = {f"dataset::{v}": (F.col(dataset) == v).cast("double") for v in levels[1:]}
    products = {f"{x}::{v}": F.col(x).cast("double") * (F.col(dataset) == v).cast("double") for x in slopes for v in levels[1:]}
    return df.withColumns(flags | products), list(flags), list(products)


def fixed_effects_ols(df: DataFrame, outcome: str, predictors: list[str], dataset: str, cluster: str) -> Fit:
    """ST-16: least squares with an intercept per dataset and cluster-robust SE."""
    rows, flags, _ = dataset_design(df.dropna(subset=[outcome, *predictors, dataset, cluster]), dataset)
    return ols_cluster(rows, outcome, [*predictors, *flags], cluster)


def interaction_test(df: DataFrame, outcome: str, slope: str, others: list[str], dataset: str, cluster: str) -> dict:
    """ST-18: joint Wald test of a predictor's slope over datasets, and the slope of each dataset. ValueError with fewer than two."""
    known = df.dropna(subset=[outcome, slope, *others, dataset, cluster])
    rows, flags, products = dataset_design(known, dataset, (slope,))
    if not products:
        raise ValueError(f"an interaction needs two values of {dataset}")
    fit = ols_cluster(rows, outcome, [slope, *others, *flags, *products], cluster)
    first = known.agg(F.min(dataset).alias("d")).first()["d"]
    base = float(fit.beta[fit.terms.index(slope)])
    slopes = {str(first): base} | {t.split("::", 1)[1]: base + float(fit.beta[fit.terms.index(t)]) for t in products}
    return fit.wald(products) | {"n": fit.n, "n_clusters": fit.clusters, "slopes": slopes}


def ols_cluster(df: DataFrame, outcome: str, predictors: list[str], cluster: str) -> Fit:
    """ST-16, 18: least squares with cluster-robust SE, from two aggregates."""
    known = df.select(outcome, *[F.col(f"`{p}`") for p in predictors], F.col(cluster).alias("__c")).dropna()
    xs = [F.lit(1.0), *[F.col(f"`{p}`").cast("double") for p in predictors]]
    y, k = F.col(outcome).cast("double"), len(predictors) + 1
    row = known.agg(*_products(xs, F.lit(1.0), "h"), *[F.sum(x * y).alias(f"g{i}") for i, x in enumerate(xs)], F.count("*").alias("n")).first()
    inv = np.linalg.pinv(_unpack(row, "h", k))
    beta = inv @ np.array([row[f"g{i}"] for i in range(k)])
    resid = y - sum((float(b) * x for b, x in zip(beta, xs, strict=True)), F.lit(0.0))
    meat, clusters = _sandwich(known.select("__c", *[(resid * x).alias(f"s{i}") for i, x in enumerate(xs)]), "__c", k)
    n = row["n"]
    fix = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
    return Fit(["intercept", *predictors], beta, inv @ meat @ inv * fix, n, clusters)


def standardised(df: DataFrame, columns: dict[str, Column], group: list[str] = (), unit: str | None = None) -> DataFrame:
    """``df`` with z-scores (population SD), each unit counted once, by group; a constant column gives null."""
    group = list(group)
    rows = df.withColumns({f"__{name}": c for name, c in columns.items()})
    base = rows.dropDuplicates([*group, unit]) if unit else rows
    stats = base.groupBy(*group).agg(*[x for n in columns for x in (F.avg(f"__{n}").alias(f"__m_{n}"), F.stddev_pop(f"__{n}").alias(f"__s_{n}"))])
    joined = rows.join(stats, group) if group else rows.crossJoin(stats)  # one row
    out = {n: F.try_divide(F.col(f"__{n}") - F.col(f"__m_{n}"), F.col(f"__s_{n}")) for n in columns}
    return joined.withColumns(out).select(*df.columns, *columns)


def dataset_effects(df: DataFrame, group: str, outcome: str, predictors: list[str], least: int = 100) -> DataFrame:
    """ST-17: per group the first predictor's coefficient and HC3 SE; groups below ``least`` rows are left out.

    Gram sums and the leverage-weighted sums are aggregates; each group's small system is solved
    in one row.
    """
    known = df.select(group, outcome, *predictors).dropna()
    xs = [F.lit(1.0), *[F.col(p).cast("double") for p in predictors]]
    y, k = F.col(outcome).cast("double"), len(predictors) + 1
    grams = known.groupBy(group).agg(
        F.array(*[F.sum(a * b) for a in xs for b in xs]).alias("xx"), F.array(*[F.sum(a * y) for a in xs]).alias("xy"), F.count("*").alias("n")
    ).where(F.col("n") >= least)
    kind = df.schema[group].dataType.simpleString()

    def solve(frames):
        for f in frames:
            inv = [np.linalg.pinv(np.reshape(x, (k, k))) for x in f["xx"]]
            yield pd.DataFrame({"g": f[group], "n": f["n"], "inv": [i.ravel() for i in inv], "beta": [i @ v for i, v in zip(inv, f["xy"], strict=True)]})

    solved = grams.mapInPandas(solve, f"g {kind}, n long, inv array<double>, beta array<double>")
    rows = known.join(solved, known[group].eqNullSafe(solved["g"]))
    fitted = sum((F.col("beta")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
    leverage = sum((F.col("inv")[i * k + j] * xs[i] * xs[j] for i in range(k) for j in range(k)), F.lit(0.0))
    adjusted = (y - fitted) / F.greatest(1 - leverage, F.lit(1e-6))
    row = lambda j: sum((F.col("inv")[k + i] * xs[i] for i in range(k)), F.lit(0.0))  # noqa: E731  the first predictor's row of the inverse
    variance = F.sum((adjusted * row(1)) ** 2)
    return rows.groupBy("g").agg(F.first("beta")[1].alias("beta"), F.sqrt(variance).alias("se"), F.first("n").alias("n")).withColumnRenamed("g", group)


def reml_tau2(y: np.ndarray, v: np.ndarray) -> float:
    """Restricted maximum-likelihood between-study variance by golden-section search on its logarithm."""

    def loss(log_tau2: float) -> float:
        w = 1 / (v + math.exp(log_tau2))
        mu = (w * y).sum() / w.sum()
        return 0.5 * (-np.log(w).sum() + math.log(w.sum()) + (w * (y - mu) ** 2).sum())

    lo, hi = math.log(1e-12), math.log(max(1.0, np.var(y) * 100 + 1e-6))
    grid = np.linspace(lo, hi, 200)
    best = int(np.argmin([loss(g) for g in grid]))
    a, b = grid[max(best - 1, 0)], grid[min(best + 1, 199)]
    ratio = (math.sqrt(5) - 1) / 2
    while b - a > 1e-12:
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    at = (a + b) / 2
    return 0.0 if loss(lo) <= loss(at) + 1e-8 else math.exp(at)


META = (
    "k long, fixed_beta double, fixed_se double, fixed_p double, q double, q_p double, i2 double, tau2 double, "
    "random_beta double, random_se double, random_low double, random_high double, random_p double, prediction_low double, prediction_high double"
)


def meta_of(y: np.ndarray, se: np.ndarray) -> dict:
    """ST-19, 20: fixed effect, heterogeneity, and random effects with the modified Hartung-Knapp interval."""
    v, k = se**2, len(y)
    w = 1 / v
    mu, s = (w * y).sum() / w.sum(), math.sqrt(1 / w.sum())
    q = float((w * (y - mu) ** 2).sum())
    tau2 = reml_tau2(y, v) if k > 1 else 0.0
    r = 1 / (v + tau2)
    mr = float((r * y).sum() / r.sum())
    sr = math.sqrt(max(1.0, (r * (y - mr) ** 2).sum() / max(k - 1, 1)) / r.sum())
    crit = t_quantile(0.975, k - 1) if k > 1 else math.nan
    wide = math.sqrt(tau2 + sr**2)
    return {
        "k": k, "fixed_beta": float(mu), "fixed_se": s, "fixed_p": math.erfc(abs(mu / s) / math.sqrt(2)), "q": q,
        "q_p": chi2_tail(q, k - 1) if k > 1 else math.nan, "i2": max(0.0, (q - (k - 1)) / q) * 100 if q > 0 else 0.0, "tau2": tau2,
        "random_beta": mr, "random_se": sr, "random_low": mr - crit * sr, "random_high": mr + crit * sr,
        "random_p": 2 * t_tail(abs(mr / sr), k - 1) if k > 1 else math.nan, "prediction_low": mr - crit * wide, "prediction_high": mr + crit * wide,
    }


def meta_analysis(effects: DataFrame, group: list[str], beta: str, se: str) -> DataFrame:
    """ST-19, 20, 21: a meta-analysis per group of effects (a handful of datasets each)."""
    keys = ", ".join(f"{g} {effects.schema[g].dataType.simpleString()}" for g in group)

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(group, key, strict=True)) | meta_of(f[beta].to_numpy(float), f[se].to_numpy(float))])

    return effects.select(*group, beta, se).dropna().groupBy(*group).applyInPandas(one, f"{keys}, {META}")


def fixed_effect(effects: DataFrame, group: list[str], beta: str, se: str) -> DataFrame:
    """ST-19 with columns alone: pooled effect, SE, Cochran's Q and I-squared."""
    w, b = 1 / F.col(se) ** 2, F.col(beta)
    s = effects.groupBy(*group).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * b).alias("swb"), F.sum(w * b * b).alias("swbb"))
    q = F.expr("swbb - swb * swb / sw")
    i2 = F.when(q > 0, F.greatest((q - (F.col("k") - 1)) / q, F.lit(0.0)) * 100).otherwise(0.0)
    return s.select(*group, "k", F.expr("swb / sw").alias("fixed_beta"), F.expr("sqrt(1 / sw)").alias("fixed_se"), q.alias("q"), i2.alias("i2"))


def stability(table: DataFrame, group: list[str], beta: str) -> DataFrame:
    """ST-22: whether an effect keeps its sign over the rows of a group."""
    return table.groupBy(*group).agg((F.min(F.signum(beta)) == F.max(F.signum(beta))).alias("sign_stable"), F.count("*").alias("n"))


def heterogeneity_flags(meta: DataFrame, q: str | None = None, least_i2: float = 50.0, level: float = 0.05) -> DataFrame:
    """ST-22: ``meta`` with high_i2 (I-squared of at least ``least_i2``) and, of an interaction's ``q``, interaction_significant."""
    out = meta.withColumn("high_i2", F.col("i2") >= least_i2)
    return out.withColumn("interaction_significant", F.col(q) < level) if q else out
