"""Batched fits against single ones: rankers, tuning, held-out targets and models per label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import fits, portability, ranks, regression, stats


def tasks(spark, n=260, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.normal(), float(rng.integers(0, 3))
        rows.append((i % 70, "xyz"[i % 3], float(a), None if i % 41 == 0 else b, 1.0, int(a + 0.5 * b + rng.normal() > 0.7), float(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "u long, t string, a double, b double, flat double, y int, alignment double")


def test_batched_rankers_equal_single_ones(spark):
    df = tasks(spark)
    asked = [(fs, c) for fs in (["a"], ["a", "b"], ["a", "b", "flat"]) for c in (0.001, 0.3, 1000.0)]
    scopes = {i: (fs, None) for i, (fs, _) in enumerate(asked)}
    table, usable = portability._scoped(df, scopes, "y", "u", "t", 5)
    got = [fits.ranker(s) for s in fits.fit_all(table, [fits.Task(tuple(fs), f"w{i}", "y", c) for i, (fs, c) in enumerate(asked)])]
    for (fs, c), model in zip(asked, got, strict=True):
        want = portability.fit_ranker(df, fs, "y", "u", c)
        for g, w in zip(model, want, strict=True):
            assert g["feature"] == w["feature"] and g["mean"] == pytest.approx(w["mean"]) and g["scale"] == pytest.approx(w["scale"])
            assert g["coefficient"] == pytest.approx(w["coefficient"], abs=2e-4)
        pdf = portability.equal_weights(df.dropna(subset=[*fs, "y"]), "u").toPandas()
        x = np.column_stack([(pdf[m["feature"]] - m["mean"]) / m["scale"] for m in model[:-1]])
        beta, w = np.array([m["coefficient"] for m in model[:-1]]), pdf["weight"].to_numpy()
        p = 1 / (1 + np.exp(-(x @ beta + model[-1]["coefficient"])))
        assert np.abs(x.T @ (w * (p - pdf["y"])) + beta / c).max() < 1e-6


def test_tuning_equals_one_fit_after_another(spark):
    df = tasks(spark)
    best, rows = portability.tune(df, ["a", "b"], "y", "u", "t", grid=(0.01, 1.0), folds=4)
    split = df.join(portability.dealt_folds(df, "u", 4, 0), "u")
    for r in rows:
        macros = []
        for f in range(4):
            model = portability.fit_ranker(split.where(F.col("fold") != f), ["a", "b"], "y", "u", r["C"])
            held = portability.with_score(split.where(F.col("fold") == f), model).where(F.col("score").isNotNull())
            macros.append(stats.macro_auroc(held, "score", "y", "t").first()["macro_auroc"])
        assert r["folds"] == 4 and r["macro_auroc"] == pytest.approx(np.mean(macros), abs=1e-6)
    assert best in (0.01, 1.0)


@pytest.mark.parametrize("c", [0.5, None])
def test_left_out_targets_equal_single_fits(spark, c):
    df = tasks(spark, 150)
    got = portability.model_comparison(df, {"one": ["a"], "two": ["a", "b"]}, "y", "u", "t", c, grid=(0.1, 10.0))
    rows = {(r["model"], r["t"]): r for r in got.collect()}
    for name, fs in (("one", ["a"]), ("two", ["a", "b"])):
        for t in "xyz":
            train = df.where(F.col("t") != t)
            best = c if c is not None else portability.tune(train, fs, "y", "u", "t", (0.1, 10.0))[0]
            held = portability.with_score(df.where(F.col("t") == t), portability.fit_ranker(train, fs, "y", "u", best))
            want = stats.auroc(held, "score", "y").first()
            assert rows[name, t]["n"] == want["n"] and rows[name, t]["auroc"] == pytest.approx(want["auroc"], abs=1e-6)
    assert len(rows) == 6
    scored = portability.leave_target_out(df.withColumn("t", F.when(F.col("u") > 3, F.col("t"))), ["a"], "y", "u", "t", 1.0)
    assert scored.count() == 150 and scored.where("t is null and score is not null").count() == 0


def test_separable_data_and_single_classes_end(spark):
    df = spark.createDataFrame([(i, float(i), int(i > 20), 1.0, 0.0) for i in range(40)], "u long, a double, y int, w double, none double")
    found = fits.fit_all(df, [fits.Task(("a",), "w", "y", 1e6), fits.Task(("a",), "none", "y", 1.0), fits.Task(("a",), "w", "w", 1.0)])
    assert found[0].beta[1] > 0 and np.isfinite(found[0].beta).all() and (found[1].beta == 0).all() and np.isfinite(found[2].beta).all()
    with pytest.raises(ValueError):
        portability.leave_target_out(df.withColumn("t", F.col("u") + F.lit(0)).union(df.withColumn("t", F.col("u") + 100)), ["a"], "y", "u", "t", 1.0)


def test_label_models_equal_models_of_their_own(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        f, g = int(rng.random() < 0.4), float(rng.integers(0, 4))
        labels = [x for x, p in (("a", 0.2 + 0.3 * f), ("b", 0.3), ("rare", 0.01), ("c", 0.2 + 0.05 * g)) if rng.random() < p]
        rows.append((f"m{i % 37}" if i % 50 else None, f if i % 60 else None, g, labels if i % 23 else None))
    df = spark.createDataFrame(rows, "m string, f int, g double, labels array<string>")
    got = regression.label_models(df, "labels", ["a", "b", "rare", "c"], ["f", "g"], "m", "f")
    assert [r["label"] for r in got] == ["a", "b", "c"]
    for r in got:
        y = F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), r["label"]).cast("int")
        want = next(w for w in regression.logistic_cluster(df.withColumn("y", y), "y", ["f", "g"], "m").rows() if w["term"] == "f")
        assert {k: r[k] for k in want} == {k: v if isinstance(v, str) else pytest.approx(v, rel=1e-6) for k, v in want.items()}
    scopes = {"all": (F.lit(True), ["f"]), "low": (F.col("g") < 2, ["f", "g"])}
    single = df.where("size(labels) = 1")
    for r in regression.single_label_models(df, "labels", ["a", "b"], scopes, "m", "f", 5):
        keep, xs = scopes[r["scope"]]
        want = regression.logistic_cluster(single.where(keep).withColumn("y", F.array_contains("labels", r["label"]).cast("int")), "y", xs, "m").rows()[1]
        assert r["beta"] == pytest.approx(want["beta"], rel=1e-6) and r["se"] == pytest.approx(want["se"], rel=1e-6) and r["n"] == want["n"]


def test_evaluation_from_one_histogram_equals_its_parts(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.integers(0, 25)), int(rng.random() < 0.3)) for i in range(500)] + [(900, None, 1), (901, 3.0, None)]
    df = spark.createDataFrame(rows, "k long, s double, y int")
    got = portability.measures(df, "s", "y").first()
    want = stats.auroc(df, "s", "y").first().asDict() | stats.average_precision(df, "s", "y").first().asDict()
    for f in (0.1, 0.2):
        top = ranks.tie_inclusive_top(df, "s", "y", f).first()
        want |= {f"precision_{f:g}": top["precision"], f"lift_{f:g}": top["lift"]}
    for k in (50, 100, 200):
        b = ranks.expected_budget(df, "s", "y", k).first()
        want |= {f"expected_{k}": b["expected_positives"], f"expected_lift_{k}": b["expected_lift"]}
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()} and got["prevalence"] == want["n_pos"] / want["n"]
    empty = portability.measures(df.limit(0), "s", "y").first()
    assert empty["n"] == 0 and empty["auroc"] is None and portability.measures(df.where("y = 1"), "s", "y").first()["auroc"] is None


def test_decision_follows_the_evaluations(spark):
    rng = np.random.default_rng(12)
    rows = [(i, float(x := rng.normal()), float(round(x)), int(x + rng.normal() > 0.8), 0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, full double, simple double, y int, flat double")
    got = portability.decide(spark, df, df.where("k < 200"), "full", "simple", "y", "k", 50).first()
    seen = {c: portability.evaluate(df, c, "y", "k", 50) for c in ("full", "simple")}
    gain = seen["full"]["auroc"] - seen["simple"]["auroc"]
    useful = seen["full"]["auroc"] >= 0.58 and seen["full"]["auroc_low"] > 0.5 and seen["full"]["lift_0.1"] >= 1.15
    ready = gain >= 0.02 and got["gain_share"] >= 0.8
    assert got["gain"] == pytest.approx(gain) and useful and got["selected"] == ("full" if ready else "full_qualified") and got["verdict"] == "EXTERNALLY_VALIDATED"
    none = portability.decide(spark, df, df, "flat", "flat", "y", "k", 20).first()
    assert (none["status"], none["selected"], none["verdict"]) == ("NO_USEFUL_RANKING", "none", None)


def test_rankers_at_a_given_penalty_need_rows_alike_only(spark, monkeypatch):
    """Without folds to deal, rows that agree in target, label and features are one row of every fit, and of the AUROC."""
    rng = np.random.default_rng(8)
    rows = [(f"u{int(u)}", "ABC"[int(t)], float(a), None if a == 3 and t == 1 else float(b), int(y)) for u, t, a, b, y in zip(rng.integers(0, 90, 400), rng.integers(0, 3, 400), rng.integers(0, 4, 400), rng.integers(0, 3, 400), rng.integers(0, 2, 400), strict=True)]
    rows += [(None, "A", 1.0, 1.0, 1), ("u1", None, 1.0, 2.0, 0), ("u2", "B", 2.0, 1.0, None)]
    df = spark.createDataFrame(rows, "unit string, target string, a double, b double, y int")
    sets = {"one": ["a"], "two": ["a", "b"]}
    monkeypatch.setattr(portability, "_scoped", None)  # no row is repeated to deal folds
    got = {(r["model"], r["target"]): r for r in portability.model_comparison(df, sets, "y", "unit", "target", c=0.1).collect()}
    assert set(got) == {(m, t) for m in sets for t in "ABC"}
    scored = portability.leave_target_out(df, sets["two"], "y", "unit", "target", c=0.1)
    assert scored.count() == len(rows)
    for t in "ABC":
        for name, features in sets.items():
            fitted = portability.fit_ranker(df.where(f"target <> '{t}' or target is null").where("unit is not null and target is not null"), features, "y", "unit", 0.1)
            want = portability.with_score(df.where(f"target = '{t}'"), fitted)
            seen = portability.auroc(want, "score", "y").first()
            assert (got[name, t]["n"], got[name, t]["n_pos"]) == (seen["n"], seen["n_pos"]) and got[name, t]["auroc"] == pytest.approx(seen["auroc"], abs=5e-3)
