"""Many logistic fits over one table in the rounds of the slowest: every round is one job for all that are open.

A task goes over its rows once per round and adds up loss, gradient and Hessian of every open fit;
Spark sums these by fit and place, and the driver takes the Newton steps, which need K by K systems
only. A step that raises the loss is halved in the next round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, TOLERANCE = 100, 1e-9
LEAST_SCALE = 1e-12
FOUND = "fit int, at int, value double"


@dataclass(frozen=True)
class Task:
    """A fit of a 0/1 label: its features, the column of its weights, and what it penalises.

    Rows with a null among features, label or weight, or with weight 0, take no part; nor do those
    of the fold ``left_out``. ``c`` is the inverse penalty of standardised coefficients (None: no
    penalty and no standardisation); with a penalty, weights are scaled to a mean of 1. With
    ``trials`` the label counts successes among the weight's trials instead. ``count`` names the
    column of how many rows a row stands for, whose weights its weight is the sum of (None: one).
    """

    features: tuple[str, ...]
    weight: str
    label: str
    c: float | None = None
    fold: str | None = None
    left_out: int | None = None
    trials: bool = False
    count: str | None = None

    def rows(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Features, label and weight of the rows that take part, and for how many rows they stand."""
        x, y, w = f[list(self.features)].to_numpy(float), f[self.label].to_numpy(float), f[self.weight].to_numpy(float)
        good = (w > 0) & ~np.isnan(y) & ~np.isnan(x).any(axis=1)
        if self.fold is not None:
            good &= f[self.fold].to_numpy(float) != self.left_out
        return x[good], y[good], w[good], int(good.sum() if self.count is None else f[self.count].to_numpy()[good].sum())

    @property
    def data(self) -> tuple:
        return self.features, self.weight, self.label, self.fold, self.left_out, self.count


def gather(table: DataFrame, kernel: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]], n: int) -> list[np.ndarray | None]:
    """The sums over all rows of what ``kernel`` gives per batch, a vector per number below ``n``; None for none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            for i, v in kernel(f):
                total[i] = total[i] + v if i in total else v
        parts = [pd.DataFrame({"fit": i, "at": np.arange(len(v)), "value": v}) for i, v in total.items()]
        yield pd.concat(parts) if parts else pd.DataFrame({"fit": [], "at": [], "value": []})

    out: list[np.ndarray | None] = [None] * n
    found = table.mapInPandas(run, FOUND).groupBy("fit", "at").agg(F.sum("value").alias("value")).toPandas()  # K * K numbers per fit
    for i, f in found.groupby("fit"):
        out[int(i)] = f.sort_values("at")["value"].to_numpy()
    return out


def moments(table: DataFrame, tasks: list[Task]) -> list[dict]:
    """Per task the rows, weight, and weighted means and SDs of its features (an SD of nearly 0 is 1), in one job."""
    kinds = list(dict.fromkeys(t.data for t in tasks))
    first = [next(t for t in tasks if t.data == d) for d in kinds]

    def kernel(f: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        for i, t in enumerate(first):
            x, y, w, n = t.rows(f)
            yield i, np.concatenate(([n, w.sum(), w @ y], w @ x, w @ (x * x)))

    found = dict(zip(kinds, gather(table, kernel, len(kinds)), strict=True))
    out = []
    for t in tasks:
        v, k = found[t.data], len(t.features)
        if v is None or not v[1]:
            out.append({"n": 0, "weight": 0.0, "positive": 0.0, "mean": np.zeros(k), "scale": np.ones(k)})
            continue
        mean = v[3 : 3 + k] / v[1]
        sd = np.sqrt(np.maximum(v[3 + k :] / v[1] - mean**2, 0))
        out.append({"n": int(v[0]), "weight": v[1], "positive": v[2], "mean": mean, "scale": np.where(sd > LEAST_SCALE, sd, 1.0)})
    return out


class _State:
    """Where a fit stands: the last accepted coefficients, and those to be tried."""

    def __init__(self, task: Task, of: dict):
        k = len(task.features) + 1
        self.task, self.beta, self.step, self.loss, self.open = task, np.zeros(k), np.zeros(k), math.inf, True
        penalised = task.c is not None
        self.mean, self.scale = (of["mean"], of["scale"]) if penalised else (np.zeros(k - 1), np.ones(k - 1))
        self.factor = of["n"] / of["weight"] if penalised and of["weight"] else 1.0
        self.penalty = np.concatenate(([0.0], np.full(k - 1, 1 / task.c))) if penalised else np.zeros(k)
        self.hessian = np.zeros((k, k))

    @property
    def trial(self) -> np.ndarray:
        return self.beta + self.step

    def take(self, sums: np.ndarray) -> None:
        """Accept the trial unless it raises the loss, and take the next step."""
        k = len(self.beta)
        loss = sums[0] + 0.5 * self.penalty @ self.trial**2
        if loss > self.loss + 1e-12 * abs(self.loss) and np.abs(self.step).max() > TOLERANCE:
            self.step = self.step / 2
            return
        self.beta, self.loss = self.trial, loss
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = sums[1 + k :]
        self.hessian = hessian + np.triu(hessian, 1).T + np.diag(self.penalty)
        done = np.abs(self.step).max() < TOLERANCE and self.open is not True
        self.step = -np.linalg.pinv(self.hessian, hermitian=True) @ (sums[1 : 1 + k] + self.penalty * self.beta)
        self.open = False if done or np.abs(self.step).max() < TOLERANCE else "moving"


def fit_all(table: DataFrame, tasks: list[Task], rounds: int = ROUNDS) -> list[_State]:
    """Every task at its minimum, in as many jobs as the slowest needs, and one for the moments."""
    states = [_State(t, m) for t, m in zip(tasks, moments(table, tasks), strict=True)]
    for _ in range(rounds):
        open_ = [s for s in states if s.open]
        if not open_:
            break
        now = [(s.task, s.trial, s.mean, s.scale, s.factor) for s in open_]

        def kernel(f: pd.DataFrame, now=now) -> Iterator[tuple[int, np.ndarray]]:
            held: dict[tuple, tuple] = {}
            for i, (task, beta, mean, scale, factor) in enumerate(now):
                if task.data not in held:
                    held[task.data] = task.rows(f)
                x, y, w, _ = held[task.data]
                x = np.column_stack([np.ones(len(x)), (x - mean) / scale])
                trials = w * factor
                eta = np.clip(x @ beta, -30, 30)
                p = 1 / (1 + np.exp(-eta))
                hits = y if task.trials else trials * y
                curve = np.maximum(p * (1 - p), 1e-8) * trials
                h = (x.T * curve) @ x
                yield i, np.concatenate(([(trials * np.logaddexp(0, eta) - hits * eta).sum()], x.T @ (trials * p - hits), h[np.triu_indices(len(beta))]))

        for s, sums in zip(open_, gather(table, kernel, len(now)), strict=True):
            if sums is None:
                s.open = False
            else:
                s.take(sums)
    return states


def ranker(state: _State) -> list[dict]:
    """The coefficient table of a penalised fit."""
    rows = zip(state.task.features, state.beta[1:].tolist(), state.mean.tolist(), state.scale.tolist(), strict=True)
    out = [{"feature": f, "coefficient": b, "mean": m, "scale": s} for f, b, m, s in rows]
    return [*out, {"feature": "(intercept)", "coefficient": float(state.beta[0]), "mean": 0.0, "scale": 1.0}]
