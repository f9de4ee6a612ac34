"""Nested cross-validated ridge from one pass of Gram sums per dataset, repeat and fold.

A train set is a sum of folds: its moments, standardisation and normal equations follow from the
folds' sums, and a validation fold's squared error from its own, so tuning never reads a row
again. Each (dataset, repeat, outer fold) is one small task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resample import draw, numbered
from .storage import stable

#: Penalties from 1e-4 to 1e16; infinity leaves the intercept alone.
ALPHAS = [*(10.0**e for e in range(-4, 17)), float("inf")]
TIE = 1e-10


def fold_grams(df: DataFrame, keys: list[str], fold: str, features: list[str], outcome: str) -> DataFrame:
    """Per ``keys`` and fold: n, sums, and the upper triangle of the products of features and outcome."""
    cols = [F.col(c).cast("double") for c in [*features, outcome]]
    k = len(cols)
    rows = df.select(*keys, fold, F.array(*cols).alias("v")).where(~F.exists("v", lambda x: x.isNull()))

    def partial(frames):
        for f in frames:
            out = []
            for key, g in f.groupby([*keys, fold], dropna=False):
                v = np.stack(g["v"].to_numpy())
                out.append((*key, len(v), v.sum(axis=0), (v.T @ v)[np.triu_indices(k)]))
            yield pd.DataFrame(out, columns=[*keys, fold, "n", "s", "p"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, fold])
    parts = rows.mapInPandas(partial, f"{kinds}, n long, s array<double>, p array<double>")
    size = k * (k + 1) // 2
    long = parts.select(*keys, fold, "n", F.posexplode(F.concat("s", "p")).alias("at", "x"))
    summed = long.groupBy(*keys, fold, "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])  # k + size elements
    out = summed.groupBy(*keys, fold).agg(F.max("n").alias("n"), packed.alias("v"))
    return out.select(*keys, fold, "n", F.slice("v", 1, k).alias("s"), F.slice("v", k + 1, size).alias("p"))


def _full(p: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = p
    return out + np.triu(out, 1).T


def solve_ridge(n: float, s: np.ndarray, p: np.ndarray, alphas: list[float]) -> np.ndarray:
    """Coefficients on the original scale, intercept last, one row per penalty (of standardised features)."""
    k = len(s) - 1
    mean = s / n
    centred = p - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    values, vectors = np.linalg.eigh(centred[:k, :k] / np.outer(sd, sd))
    rotated = vectors.T @ (centred[:k, k] / sd)
    out = np.zeros((len(alphas), k + 1))
    for i, a in enumerate(alphas):
        if np.isfinite(a):
            out[i, :k] = vectors @ (rotated / (np.maximum(values, 0) + a)) / sd
        out[i, k] = mean[k] - out[i, :k] @ mean[:k]
    return out


def squared_error(b: np.ndarray, n: float, s: np.ndarray, p: np.ndarray) -> float:
    k = len(s) - 1
    c = np.concatenate((-b[:k], [1.0]))
    return float(c @ p @ c - 2 * b[k] * (c @ s) + n * b[k] ** 2)


def choose(folds: dict, inside: list, alphas: list[float]) -> tuple[float, bool, bool]:
    """ML-14: the penalty with the least error over ``inside`` folds, ties to the stronger, and two flags.

    The first flag tells whether it is at the grid's weak end; the second whether the greatest finite
    penalty is materially better than the intercept alone, so that the grid's end isn't resolved.
    """
    errors = np.zeros(len(alphas))
    for held in inside:
        n, s, p = (sum(folds[f][i] for f in inside if f != held) for i in range(3))
        errors += [squared_error(b, *folds[held]) for b in solve_ridge(n, s, p, alphas)]
    good = np.nonzero(errors <= errors.min() * (1 + TIE))[0]
    last = len(alphas) - 1
    unresolved = not np.isfinite(alphas[last]) and bool(good[-1] == last - 1)
    return alphas[good[-1]], bool(good[-1] == 0), unresolved


def _folds(f: pd.DataFrame, fold: str, k: int) -> dict:
    return {r[0]: (r[1], np.asarray(r[2]), _full(np.asarray(r[3]), k)) for r in zip(f[fold], f["n"], f["s"], f["p"], strict=True)}


def _fit(folds: dict, inside: list, alphas: list[float]) -> tuple[np.ndarray, float, bool, bool]:
    """Coefficients on ``inside`` folds with the penalty chosen among them, and what ``choose`` says."""
    alpha, edge, unresolved = choose(folds, inside, alphas) if len(inside) > 1 else (alphas[-1], False, False)
    n, s, p = (sum(folds[x][i] for x in inside) for i in range(3))
    return solve_ridge(n, s, p, [alpha])[0], alpha, edge, unresolved


MODEL = "alpha double, boundary boolean, unresolved boolean, coefficients array<double>"


def nested_ridge(df: DataFrame, keys: list[str], fold: str, features: list[str], outcome: str, alphas: list[float] = ALPHAS) -> DataFrame:
    """ML-13, 14, 15: keys, fold, alpha, boundary, unresolved and coefficients (intercept last) for each outer fold.

    The penalty is chosen on the other folds alone. A fold without a train set is left out. With
    ``repeated_folds`` the repeat is one of ``keys``.
    """
    k = len(features) + 1
    grams = fold_grams(df, keys, fold, features, outcome)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, fold])

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        folds, out = _folds(f, fold, k), []
        for outer in sorted(folds):
            if inside := [x for x in sorted(folds) if x != outer]:
                b, alpha, edge, unresolved = _fit(folds, inside, alphas)
                out.append((*key, outer, alpha, edge, unresolved, b))
        return pd.DataFrame(out, columns=[*keys, fold, "alpha", "boundary", "unresolved", "coefficients"])

    return grams.groupBy(*keys).applyInPandas(solve, f"{kinds}, {MODEL}")


def require_resolved(models: DataFrame) -> DataFrame:
    """ML-14: ``models``; ValueError if a penalty at the grid's strong end is materially better than none of the features."""
    if (bad := models.where("unresolved").first()) is not None:
        raise ValueError(f"the penalty isn't resolved: {bad.asDict()}")
    return models


def out_of_fold(df: DataFrame, models: DataFrame, keys: list[str], fold: str, features: list[str], out: str = "prediction") -> DataFrame:
    """ML-13: every row predicted by the model that never saw its fold."""
    joined = df.join(models.select(*keys, fold, F.col("coefficients").alias("__b")), [*keys, fold])
    x = F.array(*[F.col(f).cast("double") for f in features])
    parts = F.zip_with(x, F.slice("__b", 1, len(features)), lambda v, b: v * b)
    value = F.aggregate(parts, F.element_at("__b", -1), lambda total, p: total + p)
    return joined.withColumn(out, value).drop("__b")


def residual_models(df: DataFrame, keys: list[str], fold: str, base: list[str], added: list[str], outcome: str, alphas: list[float] = ALPHAS) -> DataFrame:
    """ML-16: per outer fold the base model plus a least-squares fit of its residuals on ``added``.

    The residuals of a train fold come from a base model, penalty included, of the folds that are
    neither it nor the outer one, so nothing that touches a fold's predictions has seen its
    outcomes. A residual is linear in outcome and features, so the second fit's sums follow from
    the same fold sums. Coefficients are those of ``base``, ``added`` and the intercept.
    """
    features, nb = [*base, *added], len(base)
    k = len(features) + 1
    grams = fold_grams(df, keys, fold, features, outcome)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, fold])
    own = [*range(nb), k - 1]
    extra = list(range(nb, k - 1))

    def second_sums(n: float, s: np.ndarray, p: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of (1, added) with themselves and with the residual of the base model ``b`` in one fold."""
        x = np.zeros((len(extra) + 1,) * 2)
        x[0, 0], x[0, 1:], x[1:, 0], x[1:, 1:] = n, s[extra], s[extra], p[np.ix_(extra, extra)]
        c = np.concatenate((-b[:nb], [1.0]))
        return x, np.concatenate(([c @ s[own] - n * b[nb]], p[np.ix_(extra, own)] @ c - b[nb] * s[extra]))

    def solve(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        whole, out = _folds(f, fold, k), []
        folds = {x: (n, s[own], p[np.ix_(own, own)]) for x, (n, s, p) in whole.items()}
        for outer in sorted(folds):
            inside = [x for x in sorted(folds) if x != outer]
            if len(inside) < 2:
                continue
            b, alpha, edge, unresolved = _fit(folds, inside, alphas)
            x, y = np.zeros((len(extra) + 1,) * 2), np.zeros(len(extra) + 1)
            for held in inside:
                nuisance = _fit(folds, [z for z in inside if z != held], alphas)
                more = second_sums(*whole[held], nuisance[0])
                x, y, edge, unresolved = x + more[0], y + more[1], edge or nuisance[2], unresolved or nuisance[3]
            g = np.linalg.pinv(x) @ y
            out.append((*key, outer, alpha, edge, unresolved, np.concatenate((b[:nb], g[1:], [b[nb] + g[0]]))))
        return pd.DataFrame(out, columns=[*keys, fold, "alpha", "boundary", "unresolved", "coefficients"])

    return grams.groupBy(*keys).applyInPandas(solve, f"{kinds}, {MODEL}")


def residual_addition(df: DataFrame, keys: list[str], fold: str, base: list[str], added: list[str], outcome: str) -> DataFrame:
    """ML-16: every row's ``prediction`` by the residual model of its fold."""
    models = residual_models(df, keys, fold, base, added, outcome)
    return out_of_fold(df, models, keys, fold, [*base, *added])


def repeated_folds(df: DataFrame, unit: str, k: int, repeats: int, seed: int) -> DataFrame:
    """ML-12, 15: ``df`` once per repeat, with folds of units dealt anew; sizes differ by one at most in each repeat."""
    spread = df.select(unit).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    dealt = numbered(spread.withColumn("__d", draw(seed, "repeat", unit)), ["__d", unit], "__i", ["repeat"])
    # Written once: the models and their predictions read the same rows.
    return stable(df.join(dealt.select(unit, "repeat", (F.col("__i") % k).cast("int").alias("fold")), unit))


def tuning_diagnostics(models: DataFrame, group: list[str]) -> DataFrame:
    """ML-17: how often each penalty was chosen, and how often at the weak end of the grid."""
    return models.groupBy(*group, "alpha").agg(F.count("*").alias("n"), F.count_if("boundary").alias("n_boundary"))
