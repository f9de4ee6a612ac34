import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import gates, loci, portability, ranks, regression, resample, ridge, stats
from siteweave.sources import files, ingest

#: Published effects by dataset and their meta-analysis (fixed values).
EFFECTS = {
    "BID": [(-0.043032586893586404, 0.034557715738444655), (-0.020761581897668382, 0.038209629563578276), (-0.06425887513372536, 0.03891320019522581),
            (-0.08050955305028935, 0.029060193367276627), (-0.08495915934941868, 0.03444139104890843)],
    "ELAP": [(-0.1862952599141516, 0.031993838488648986), (0.16216649515341916, 0.03602733195821473), (-0.06666956782379918, 0.0358526445166723),
             (-0.17272467788626059, 0.033454094180605694), (-0.15285897244108893, 0.03148519156901722)],
}


def test_breadth_model_gives_the_published_coefficients(spark):
    cells = [(1, 1103, 159), (2, 179, 84), (3, 49, 36)]
    rows = [(float(b), int(i < k), f"{b}-{i % 40}") for b, n, k in cells for i in range(n)]
    fit = regression.logistic_cluster(spark.createDataFrame(rows, "breadth double, y int, motif string"), "y", ["breadth"], "motif")
    assert abs(fit.beta[1] - 1.529109630715317) < 1e-9 and abs(fit.beta[0] + 3.2923359148230453) < 1e-9
    assert fit.n == 1331 and fit.table(spark).count() == 2
    with pytest.raises(ValueError):
        regression.logistic_cluster(spark.createDataFrame([(1.0, 1, "a")], "breadth double, y int, motif string"), "y", ["breadth"], "motif")


def test_robust_errors_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=200), rng.integers(0, 30, 200)
    y = 0.5 * x + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), str(k)) for a, b, k in zip(x, y, c, strict=True)], "x double, y double, c string")
    fit = regression.ols_cluster(df, "y", ["x"], "c")
    X = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ y
    r = y - X @ beta
    meat = sum(np.outer(s, s) for k in range(30) for s in [X[c == k].T @ r[c == k]])
    g = len(set(c))
    assert np.allclose(fit.beta, beta) and np.allclose(fit.cov, inv @ meat @ inv * g / (g - 1) * 199 / 198)
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = inv @ (X.T * (r / (1 - h)) ** 2) @ X @ inv
    got = regression.dataset_effects(df.withColumn("d", F.lit("a")), "d", "y", ["x"]).first()
    assert abs(got["beta"] - beta[1]) < 1e-9 and abs(got["se"] - math.sqrt(hc3[1, 1])) < 1e-9


def test_contrast_row():
    got = regression.contrast_row("c", -0.39038409989973744, 0.19384327898021925)
    assert abs(got["p"] - 0.044018343181356064) < 1e-12 and abs(got["ratio"] - 0.6767968669581851) < 1e-12 and abs(got["ci_high"] - 0.9896031516883943) < 1e-12


def test_meta_analysis_gives_the_published_values(spark):
    df = spark.createDataFrame([(f, b, s) for f, v in EFFECTS.items() for b, s in v], "f string, b double, s double")
    got = {r["f"]: r for r in regression.meta_analysis(df, ["f"], "b", "s").collect()}
    want = {"fixed_beta": -0.061676067769897897, "fixed_se": 0.015412257560246941, "q": 2.3190625605045243, "tau2": 0.0, "random_low": -0.1044673548330932, "random_p": 0.0161065742958966}
    assert all(abs(got["BID"][k] - v) < 1e-9 for k, v in want.items())
    want = {"q": 68.49195435748669, "i2": 94.15989799455508, "tau2": 0.01967931391729685, "random_beta": -0.08390302375576382, "random_high": 0.09563389190640782, "prediction_low": -0.5127787593532255}
    assert all(abs(got["ELAP"][k] - v) < 1e-6 for k, v in want.items())


def test_log_odds_give_the_published_values(spark):
    df = spark.createDataFrame([(85, 379, 20, 139)], "a long, b long, c long, d long")
    got = stats.log_odds_table(df, "a", "b", "c", "d").first()
    assert abs(got["log_or"] - 0.4273014942240877) < 1e-12 and abs(got["p"] - 0.10699925149521458) < 1e-12


def test_ranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 9.0)], "k int, v double")
    got = {r["k"]: r["percentile"] for r in ranks.percentile_ranks(df, "v").collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: None, 5: 1.0}
    assert ranks.percentile_ranks(df.limit(0), "v").count() == 0
    q = {r["k"]: r["q"] for r in ranks.bh_adjust(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "k int, p double"), "p").collect()}
    assert q[4] is None and abs(q[1] - 0.03) < 1e-12 and abs(q[2] - 0.04) < 1e-12 and abs(q[3] - 0.04) < 1e-12


def test_running_sums_over_many_partitions(spark):
    df = spark.createDataFrame([(i % 3, float(i), 1) for i in range(1000)], "g int, x double, one long")
    got = {(r["g"], r["x"]): r["cum_one"] for r in ranks.running(df, ["g"], [F.col("x")], ["one"]).collect()}
    assert all(n == int(x) // 3 + 1 for (_, x), n in got.items())


def test_single_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert stats.auroc(df, "s", "y").first()["auroc"] is None
    assert stats.auroc(spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int"), "s", "y").first()["auroc"] == 0.5


def test_union_drops_ambiguous_keys(spark):
    calls = spark.createDataFrame([("k", "A", "m"), ("k", "B", "m"), ("l", "A", "m"), ("l", "B", "n"), ("k", "A", "m")], "k string, t string, m string")
    good, bad = loci.technology_union(calls, ["k"], "t", ["A", "B"], {"m": "m"})
    assert [(r["k"], r["breadth"], r["pattern"]) for r in good.collect()] == [("k", 2, "A+B")] and [r["k"] for r in bad.collect()] == ["l"]


def test_two_technologies_and_disagreeing_motifs(spark):
    mk = lambda rows: spark.createDataFrame(rows, "l string, m string")
    got = {r["l"]: (r["class"], r["m"]) for r in loci.two_technology_union(mk([("1", "x"), ("2", "x")]), mk([("2", "y"), ("3", "z")]), "l", "m", ("A", "B")).collect()}
    assert got == {"1": ("A_exclusive_reported", "x"), "2": ("shared", None), "3": ("B_exclusive_reported", "z")}


def test_gates_of_joins(spark):
    shared = spark.createDataFrame([("shared", True), ("shared", False), ("A_exclusive_reported", None)], "class string, motifs_agree boolean")
    with pytest.raises(ValueError):
        loci.require_agreement(shared)
    assert loci.require_agreement(shared, 0.5).count() == 3
    matched = spark.createDataFrame([(1,), (None,), (0,)], "reported int")
    with pytest.raises(ValueError):
        loci.require_few_conflicts(matched)
    assert loci.require_few_conflicts(matched.where("reported is not null")).count() == 2
    pairs = spark.createDataFrame([("k", "A"), ("k", "B"), ("l", "A")], "k string, t string")
    with pytest.raises(ValueError):
        loci.complete_pairs(pairs, "k", "t", ("A", "B"), 2)
    assert loci.complete_pairs(pairs, "k", "t", ("A", "B"), 1).count() == 3


def test_checked_join(spark):
    one, two = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert loci.checked_join(two, one, ["k"]).count() == 2
    with pytest.raises(ValueError):
        loci.checked_join(one, two, ["k"])


def test_unknown_intervals_stay_null(spark):
    sites = spark.createDataFrame([(1, "c", 5, 9), (2, "c", None, None), (3, "c", 50, 51)], "k int, c string, lo long, hi long")
    hits = spark.createDataFrame([("c", 9, "+"), ("c", 5, "-"), ("c", 10, "+")], "c string, p long, s string")
    got = {r["k"]: (r["x_support"], r["x_strand_ambiguous"], r["x_strands"]) for r in loci.interval_support(sites, hits, "k", "c", "lo", "hi", "p", "s", 4, "x").collect()}
    assert got == {1: (1, 1, "+|-"), 2: (None, None, None), 3: (0, 0, None)}


def test_gene_labels(spark):
    sites = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("d",), ("d",)], "g string")
    labels = spark.createDataFrame([("a",), ("c",), ("d",), ("d",)], "g string")
    got = {r["g"]: r["mapping_status"] for r in loci.label_by_gene(sites, labels, "g").collect()}
    assert got == {"a": "resolved_assigned", "b": "resolved_not_assigned", "c": "ambiguous_duplicate_gene", "d": "resolved_all_assigned"}


#: Coefficient, mean and scale by feature of the published ranker, and its intercept (fixed values).
MODEL = [
    ("source_breadth", 0.3628898702579657, 1.081642875031305, 0.27381986047021417), ("source_BID", 0.20321107825526288, 0.26220886551465067, 0.43983562425089046),
    ("source_BACS", 0.07425061986078581, 0.39544202354119706, 0.4889454259514455), ("fp", 0.2380486481504122, 0.12054201560143397, 1.644691021989333),
    ("fp_abs", -0.16520413524666247, 1.2022263567862883, 1.128800568030483), ("fp_source_alignment", -0.24922479464669914, 0.5336621200098427, 1.3086941338205529),
    ("fp_seen", 0.057775526797865184, 0.9571750563486101, 0.20246226278653814), ("motif_-2_A", -0.05832157666659149, 0.15477084898572507, 0.361686097728352),
    ("motif_-2_C", -0.06548976112070083, 0.18256949661908345, 0.38631318321193486), ("motif_-2_G", -0.07986689897344537, 0.38842975206611574, 0.4873931470342721),
    ("motif_-1_A", -0.012887136278981104, 0.2569496619083397, 0.43695140822925566), ("motif_-1_C", 0.019780067923886663, 0.30428249436513904, 0.46010287761333146),
    ("motif_-1_G", -0.006992258961473574, 0.43876784372652156, 0.496236458795704), ("motif_+1_A", 0.033468533234959505, 0.3057851239669422, 0.4607391690831853),
    ("motif_+1_C", -0.021269363754219447, 0.2900075131480091, 0.4537655291730702), ("motif_+1_G", -0.011755682790653999, 0.4042073628850489, 0.4907379857669094),
    ("motif_+2_A", -0.015455970776906771, 0.2479338842975207, 0.4318132389293597), ("motif_+2_C", -0.18845955810643789, 0.23365890308039072, 0.4231576775761718),
    ("motif_+2_G", 0.11147150418593357, 0.3110443275732533, 0.46292089373645257), ("(intercept)", -2.1418846075475266, 0.0, 1.0),
]


def test_scorer_gives_the_published_scores(spark):
    model = [dict(zip(("feature", "coefficient", "mean", "scale"), r, strict=True)) for r in MODEL]
    sites = spark.createDataFrame([("1", "AGUAC", "BID"), ("2", "GAΨCG", "bacs"), ("3", "ACTGA", "ELAP"), ("4", "AUUAG", "BID")], "site_id string, motif string, source_assay string")
    prints = spark.createDataFrame([("AGUAC", 0.23147377744815234), ("GAUCG", 0.23147377744815323), ("ACUGA", 1.3300860661162623)], "motif string, log_ratio double")
    reference = spark.createDataFrame([(-3.0 + i / 20, "BID", 1) for i in range(40)], "score double, source_pattern string, source_breadth int")
    out = portability.score_sites(sites, model, prints, reference, ["BID", "BACS", "ELAP"], ("ELAP", "BID"))
    got = {r["site_id"]: r for r in out.collect()}
    want = {"1": -2.0419292141285528, "2": -1.8475356295452217, "3": -2.4330438850522054}
    assert all(abs(got[k]["score"] - v) < 1e-9 for k, v in want.items()) and got["4"]["score"] is None
    assert got["1"]["reference_used"] == "same_source_pattern" and got["2"]["reference_used"] == "same_source_breadth" and got["4"]["reference_percentile"] is None
    with pytest.raises(ValueError):
        portability.score_sites(sites.withColumn("source_assay", F.lit("XYZ")), model, prints, reference, ["BID", "BACS", "ELAP"], ("ELAP", "BID"))


def test_ranker_is_at_the_minimum(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 60, float(rng.normal()), float(rng.normal()), int(rng.random() < 0.4)) for i in range(150)]
    df = spark.createDataFrame(rows, "u int, a double, b double, y int")
    model = portability.fit_ranker(df, ["a", "b"], "y", "u", 0.3)
    pdf = portability.equal_weights(df, "u").toPandas()
    X = np.column_stack([(pdf[m["feature"]] - m["mean"]) / m["scale"] for m in model[:2]])
    b = np.array([m["coefficient"] for m in model[:2]])
    p = 1 / (1 + np.exp(-(X @ b + model[2]["coefficient"])))
    w = pdf["weight"].to_numpy()
    assert abs(w.mean() - 1) < 1e-9
    assert np.abs(X.T @ (w * (p - pdf["y"])) + b / 0.3).max() < 1e-3 and abs((w * (p - pdf["y"])).sum()) < 1e-3


def test_folds_keep_units_and_balance(spark):
    df = spark.createDataFrame([(i % 23,) for i in range(200)], "u long")
    folds = portability.grouped_folds(df, "u", 5)
    assert folds.groupBy("u").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["count"] for r in portability.dealt_folds(df, "u", 5, 3).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 23


def test_ridge_equals_a_direct_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.0] + rng.normal(size=120)
    df = spark.createDataFrame([("d", i % 4, float(y[i]), *map(float, x[i])) for i in range(120)], "d string, fold int, y double, a double, b double, c double")
    models = ridge.nested_ridge(df, ["d"], "fold", ["a", "b", "c"], "y")
    for r in models.collect():
        train = np.array([i for i in range(120) if i % 4 != r["fold"]])
        xs, ys = x[train], y[train]
        z = (xs - xs.mean(0)) / xs.std(0)
        beta = np.linalg.solve(z.T @ z + r["alpha"] * np.eye(3), z.T @ (ys - ys.mean())) / xs.std(0)
        assert np.allclose(r["coefficients"][:3], beta, atol=1e-8) and abs(r["coefficients"][3] - (ys.mean() - beta @ xs.mean(0))) < 1e-8
    assert ridge.out_of_fold(df, models, ["d"], "fold", ["a", "b", "c"]).count() == 120


def _ridge_rows(spark, y, x, n_folds=4):
    cols = [f"c{j}" for j in range(x.shape[1])]
    rows = [("d", i % n_folds, i, float(y[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "d string, fold int, i int, y double, " + ", ".join(f"{c} double" for c in cols)), cols


def _direct_ridge(x, y, alpha):
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    b = np.zeros(x.shape[1]) if alpha == float("inf") else np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return b, y.mean() - b @ mean


def _direct_alpha(x, y, fold, inside):
    errors = []
    for a in ridge.ALPHAS:
        e = 0.0
        for held in inside:
            tr, va = np.isin(fold, [f for f in inside if f != held]), fold == held
            b, c = _direct_ridge(x[tr], y[tr], a)
            e += ((y[va] - x[va] @ b - c) ** 2).sum()
        errors.append(e)
    good = [i for i, e in enumerate(errors) if e <= min(errors) * (1 + 1e-9)]
    return ridge.ALPHAS[good[-1]]


def test_residual_addition_equals_a_direct_computation_and_never_leaks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 5))
    y = x @ [1.0, -2.0, 0.5, 0.8, -0.6] + rng.normal(size=160)
    fold = np.arange(160) % 4
    df, cols = _ridge_rows(spark, y, x)
    predict = lambda frame: {r["i"]: r["prediction"] for r in ridge.residual_addition(frame, ["d"], "fold", cols[:3], cols[3:], "y").collect()}
    got = predict(df)
    for outer in range(4):
        inside = [f for f in range(4) if f != outer]
        tr, te = fold != outer, fold == outer
        b, c = _direct_ridge(x[tr][:, :3], y[tr], _direct_alpha(x[:, :3], y, fold, inside))
        resid = np.empty(160)
        for held in inside:
            rest = [f for f in inside if f != held]
            bb, cc = _direct_ridge(x[np.isin(fold, rest)][:, :3], y[np.isin(fold, rest)], _direct_alpha(x[:, :3], y, fold, rest))
            resid[fold == held] = y[fold == held] - x[fold == held][:, :3] @ bb - cc
        z = np.column_stack([np.ones(tr.sum()), x[tr][:, 3:]])
        g = np.linalg.lstsq(z, resid[tr], rcond=None)[0]
        want = x[te][:, :3] @ b + c + g[0] + x[te][:, 3:] @ g[1:]
        assert np.allclose([got[i] for i in np.nonzero(te)[0]], want, atol=1e-8)
    for outer in (0, 2):
        other = predict(df.withColumn("y", F.when(F.col("fold") == outer, F.col("y") * -3 + F.col("i")).otherwise(F.col("y"))))
        assert all(abs(other[i] - got[i]) < 1e-12 for i in range(160) if fold[i] == outer)
        assert any(abs(other[i] - got[i]) > 1e-3 for i in range(160) if fold[i] != outer)


def test_repeated_folds_and_tuning_flags(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "u long")
    dealt = ridge.repeated_folds(df, "u", 5, 2, 3)
    sizes = [r["count"] for r in dealt.groupBy("repeat", "fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    assert dealt.groupBy("u").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() > 0
    models = spark.createDataFrame([(1, False), (2, True)], "fold int, unresolved boolean")
    with pytest.raises(ValueError):
        ridge.require_resolved(models)
    assert ridge.require_resolved(models.where("fold = 1")).count() == 1


def test_fixed_effects_and_interaction_equal_a_direct_solution(spark):
    rng = np.random.default_rng(4)
    n = 240
    gene, ds = np.arange(n) // 3, np.arange(n) % 3
    x, w = rng.normal(size=n // 3)[gene], rng.normal(size=n // 3)[gene]
    y = 0.4 * x * (ds + 1) - 0.3 * w + 0.2 * ds + rng.normal(size=n)
    df = spark.createDataFrame([(str(g), f"s{d}", float(a), float(b), float(c)) for g, d, a, b, c in zip(gene, ds, x, w, y, strict=True)], "g string, d string, x double, w double, y double")

    def direct(X):
        inv = np.linalg.inv(X.T @ X)
        beta = inv @ X.T @ y
        r = y - X @ beta
        meat = sum(np.outer(s, s) for k in range(n // 3) for s in [X[gene == k].T @ r[gene == k]])
        k = n // 3
        return beta, inv @ meat @ inv * k / (k - 1) * (n - 1) / (n - X.shape[1])

    flags = [ds == 1, ds == 2]
    beta, cov = direct(np.column_stack([np.ones(n), x, w, *flags]))
    fit = regression.fixed_effects_ols(df, "y", ["x", "w"], "d", "g")
    assert fit.terms == ["intercept", "x", "w", "dataset::s1", "dataset::s2"] and np.allclose(fit.beta, beta) and np.allclose(fit.cov, cov)
    beta, cov = direct(np.column_stack([np.ones(n), x, w, *flags, *[x * f for f in flags]]))
    got = regression.interaction_test(df, "y", "x", ["w"], "d", "g")
    assert got["df"] == 2 and abs(got["chi2"] - beta[5:] @ np.linalg.inv(cov[5:, 5:]) @ beta[5:]) < 1e-8
    assert np.allclose([got["slopes"][s] for s in ("s0", "s1", "s2")], [beta[1], beta[1] + beta[5], beta[1] + beta[6]])
    with pytest.raises(ValueError):
        regression.interaction_test(df.where("d = 's0'"), "y", "x", ["w"], "d", "g")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(g, None if i % 17 == 0 else float(rng.integers(0, 9))) for g in ("a", "b") for i in range(1, 90)] + [("c", 3.0), ("d", None)]
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"lo": 0.1, "mid": 0.5, "hi": 0.975}).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0.1, 0.5, 0.975]))
    assert "d" not in got


def test_tuning_takes_the_least_of_equal_penalties(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 50, "t", float(v := rng.normal()), int(v + rng.normal() > 0)) for i in range(120)]
    best, table = portability.tune(spark.createDataFrame(rows, "u long, t string, a double, y int"), ["a"], "y", "u", "t", grid=(0.1, 1.0), folds=3)
    assert best == 0.1 and [r["C"] for r in table] == [0.1, 1.0] and all(r["folds"] == 3 and abs(r["macro_auroc"] - table[0]["macro_auroc"]) < 1e-12 for r in table)


def test_evaluation_agrees_with_its_parts(spark):
    rows = [(i, float(i % 7), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, s double, y int")
    got = portability.evaluate(df, "s", "y", "k", replicates=50)
    assert got["auroc"] == stats.auroc(df, "s", "y").first()["auroc"] and got["auroc_low"] <= got["auroc"] <= got["auroc_high"] and got["lift_low"] <= got["lift_high"]
    boot = resample.row_bootstrap(df, ["s"], "y", "k", 4, 1, by_row=True).collect()
    idx = sorted(rows, key=lambda r: (r[1], r[2]))
    import hashlib

    for r in boot:
        drawn = [idx[int(hashlib.md5(f"1|{r['rep']}|{i}".encode()).hexdigest()[:12], 16) % 90] for i in range(90)]
        pos, neg = [s for _, s, y in drawn if y], [s for _, s, y in drawn if not y]
        assert abs(r["auroc_s"] - np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])) < 1e-12


def test_checks_can_warn(spark):
    df = spark.createDataFrame([(1,), (3,)], "k int")
    qc = gates.checks(spark, df, "d", {"n": (F.count("*"), "==", 2), "few": (F.count("*"), ">=", 5, "WARN")})
    assert gates.run_status(qc) == "WARN" and {r["check_id"]: r["status"] for r in qc.collect()} == {"n": "PASS", "few": "WARN"}
    assert gates.replicates_agree(df.selectExpr("k as a", "-k as b"), "a", "b").first()["status"] == "FAIL"


def test_gates_fire(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    qc = gates.checks(spark, df, "d", {"unique": (gates.unique("k"), "==", 0), "n": (F.count("*"), "==", 3)})
    assert gates.run_status(qc) == "FAIL"
    with pytest.raises(gates.GateError):
        gates.require(qc)
    with pytest.raises(gates.GateError):
        gates.require_columns(df, ["x"], "d")
    with pytest.raises(gates.GateError):
        gates.require_frozen(spark.createDataFrame([("OPEN",)], "status string"))


def test_cell_tables(spark):
    rows = [["Title", "", ""], ["chr", "Motif Ψ", "Motif Ψ"], ["chr1", "AAUGC", "3"], ["", "", ""], ["chr2", "AAUGG", "4"]]
    cells = spark.createDataFrame([("f", "s", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)], "file string, sheet string, row int, col int, value string")
    head = ingest.header_rows(cells, ["chr", "motif"])
    assert head.first()["header_row"] == 1
    assert [r["name"] for r in ingest.column_names(cells, head).orderBy("col").collect()] == ["chr", "Motif_psi", "Motif_psi__dup2"]
    assert {r["row"]: dict(r["raw"]) for r in ingest.records(cells, head).collect()} == {
        2: {"chr": "chr1", "Motif_psi": "AAUGC", "Motif_psi__dup2": "3"}, 4: {"chr": "chr2", "Motif_psi": "AAUGG", "Motif_psi__dup2": "4"},
    }


def test_matrix_of_contexts(spark):
    pairs = [a + b for a in "ACGU" for b in "ACGU"]
    cells = [("f", "s", 0, j + 1, p) for j, p in enumerate(pairs)] + [("f", "s", i + 1, 0, p) for i, p in enumerate(pairs)]
    cells += [("f", "s", i + 1, j + 1, str(i + j / 100)) for i in range(16) for j in range(16)]
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    got = {r["motif"]: r["response"] for r in ingest.matrix_long(df).collect()}
    assert len(got) == 256 and abs(got["ACUGU"] - (1 + 11 / 100)) < 1e-9


def test_normalised_calls(spark):
    df = spark.createDataFrame([("1", "+", "5", "A", "C", "T", "G", "C", "7%"), ("MT", ".", "x", "A", "C", "T", "G", "N", None)], "chr string, strand string, pos string, b0 string, b1 string, b2 string, b3 string, b4 string, level string")
    assert ingest.base_window(df.limit(1), ["chr", "strand", "pos", "b0", "b1", "b2", "b3", "b4"]) == ["b0", "b1", "b2", "b3", "b4"]
    out = ingest.normalise_calls(df, "d", "BID", "HeLa", {"chrom": "chr", "strand": "strand", "pos": "pos", "signal": "level"}, ["b0", "b1", "b2", "b3", "b4"]).collect()
    assert (out[0]["base_locus_id"], out[0]["motif"], out[0]["signal"]) == ("chr1:+:5", "ACUGC", 7.0)
    assert (out[1]["base_locus_id"], out[1]["motif"], out[1]["signal"], out[1]["chrom"]) == (None, None, None, "chrM")


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">NM_1.2 one\nacgu\nAC\n>NM_9.1 two\nGG\n")
    wanted = spark.createDataFrame([("NM_1",)], "accession string")
    assert [tuple(r) for r in files.read_fasta(spark, str(tmp_path / "x.fa"), wanted).collect()] == [("NM_1.2", "ACGTAC")]
    (tmp_path / "x.gtf").write_text('# c\nchr1\ts\texon\t5\t9\t.\t+\t.\tgene "X";\nchr1\ts\texon\tx\t9\t.\t+\t.\tgene "X";\nchr1\ts\texon\n')
    assert [(r["start"], r["end"]) for r in files.read_annotation(spark, str(tmp_path / "x.gtf")).collect()] == [(5, 9)]
    found = files.manifest(spark, str(tmp_path / "x.fa"))
    assert found.first()["bytes"] == (tmp_path / "x.fa").stat().st_size
    df = spark.createDataFrame([("a", None), ("b", 2.5)], "k string, v double")
    files.write_table(df, str(tmp_path / "t"))
    assert {tuple(r) for r in files.read_table(spark, str(tmp_path / "t"), "k string, v double").collect()} == {("a", None), ("b", 2.5)}


def test_no_dataset_or_stratum_is_one_task(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(resample, "RUN", 7)
    data = [(ds, i, float((i * 7 + len(ds)) % 11), float((i * 5) % 7)) for ds, n in (("a", 40), ("bb", 7), ("c", 15)) for i in range(n)]
    out = resample.r2_bootstrap(spark.createDataFrame(data, "ds string, u long, y double, p double").repartition(3), "ds", "u", "y", ["p"], 4, 9, by_row=True)
    got = {(r["rep"], r["ds"]): r["r2_p"] for r in out.collect()}
    want = {}
    for rep in range(4):
        for ds in ("a", "bb", "c"):
            rows = [r for r in data if r[0] == ds]
            picks = [rows[int(hashlib.md5(f"9|{ds}|{rep}|{i}".encode()).hexdigest()[:12], 16) % len(rows)] for i in range(len(rows))]
            mean = sum(r[2] for r in picks) / len(picks)
            want[rep, ds] = 1 - sum((r[2] - r[3]) ** 2 for r in picks) / sum((r[2] - mean) ** 2 for r in picks)
    assert got == pytest.approx(want)
    strata = spark.createDataFrame([("m", i, float(i), i % 2) for i in range(40)], "s string, k long, v double, y int")
    for df in (out, *[resample.stratified_permutation(strata, "v", "y", "s", "k", 2, 1, by_row=b) for b in (False, True)]):
        assert "row_number" not in df._jdf.queryExecution().toString()


def test_replicates_agree_on_levels_whose_last_digits_vary(spark):
    """Each evaluation of an average may add partial sums in another order; ranks belong to one evaluation."""

    def level(k):
        import random

        return k * (1 + random.random() * 1e-13)

    wobbling = F.udf(level, "double").asNondeterministic()
    df = spark.range(1, 41).select(wobbling("id").alias("a"), wobbling("id").alias("b"))
    n, spearman, status = gates.replicates_agree(df, "a", "b").first()
    assert (n, status) == (40, "PASS") and spearman == pytest.approx(1)


def test_annotation_counts_by_key(spark, monkeypatch):
    """Keys of several places, genes of several intervals, equal intervals, and rows without a place or an end."""
    rng = np.random.default_rng(4)
    points = [(f"k{int(k)}", int(c), int(p)) for k, c, p in zip(rng.integers(0, 150, 200), rng.integers(0, 3, 200), rng.integers(0, 60, 200), strict=True)]
    points += [("none", 1, None), ("none", None, 4), ("k1", 1, None), ("far", 0, 500)]
    starts = rng.integers(0, 60, 60)
    spans = [(int(c), int(s), int(s + n), f"g{i if i < 50 else i % 5}") for i, (c, s, n) in enumerate(zip(rng.integers(0, 3, 60), starts, rng.integers(0, 5, 60), strict=True))]
    spans += [(1, int(s), int(s), f"h{s}{x}") for s in range(0, 60, 9) for x in "ab"] + [(1, 2, None, "x"), (1, 9, 3, "x"), (None, 0, 60, "x"), (2, 0, 60, None)]
    want = {}
    for k in {p[0] for p in points}:
        held = {g for c, s, e, g in spans for q, d, p in points if q == k and None not in (c, e, g, d, p) and c == d and s <= p <= e}
        status = "no_exon" if not held else "unique_gene" if len(held) == 1 else "multi_gene_ambiguous"
        want[k] = len(held), min(held) if len(held) == 1 else None, status
    a = spark.createDataFrame(points, "k string, c int, p int")
    b = spark.createDataFrame(spans, "c int, s int, e int, g string")
    for few in (loci.FEW_PLACES, 0):
        monkeypatch.setattr(loci, "FEW_PLACES", few)
        assert {r[0]: tuple(r)[1:] for r in loci.annotation_counts(a, b, "k", ["c"], "p", "s", "e", "g", 2).collect()} == want
