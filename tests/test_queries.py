import pytest

from siteweave.plans import queries as plans

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, data, con, name):
    same(plans.queries()[name](spark, data), con, plans.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, data, name):
    assert plans.queries()[name](spark, data).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_range_join_is_no_nested_loop(spark, data):
    plan = plans.interval_annotation(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_that_many_points_share_are_counted_once(spark, tmp_path):
    """2,000 lines and 2,000 orders of one day: no join has a row for each pair."""
    day = "timestamp'1995-01-01' as"
    spark.range(2000).selectExpr("id as o_orderkey", "7L as o_custkey", f"{day} o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(2000).selectExpr("id as l_orderkey", "7L as l_partkey", "cast(1 as int) as l_linenumber", f"{day} l_shipdate", "'A' as l_returnflag")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = plans.interval_annotation(spark, str(tmp_path))
    assert {tuple(r)[1:] for r in out.collect()} == {(2000, None, "multi_gene_ambiguous")}
    assert "collect_set" not in out._jdf.queryExecution().toString()
    same(out, connect(str(tmp_path)), plans.oracle_sql()["interval_annotation"])


def test_values_of_queries_without_sql(spark, data):
    """Minima of fits, held-out AUROC and the evaluation record, by plain means on the same rows."""
    import numpy as np

    from siteweave.operators import portability, stats
    from siteweave.plans import mapping
    from siteweave.plans import queries as registered

    u = mapping.union(spark, data).where("cell = 'F'").toPandas()
    x = np.column_stack([np.ones(len(u)), *[u[f"{t}_support"] for t in mapping.TECHNOLOGIES]]).astype(float)
    beta = {r["term"]: r["beta"] for r in registered.QUERIES["logit_technologies"].build(spark, data).collect()}
    b = np.array([beta["intercept"], *[beta[f"{t}_support"] for t in mapping.TECHNOLOGIES]])
    assert np.abs(x.T @ (u["y"] - 1 / (1 + np.exp(-x @ b)))).max() < 1e-5

    tasks = registered._tasks(spark, data)
    model = [r.asDict() for r in registered.QUERIES["ranker_coefficients"].build(spark, data).collect()]
    features = [m["feature"] for m in model[:-1]]
    rows = portability.equal_weights(tasks.dropna(subset=[*features, "target_reported"]), "locus").toPandas()
    z = np.column_stack([np.ones(len(rows)), *[(rows[m["feature"]].astype(float) - m["mean"]) / m["scale"] for m in model[:-1]]])
    b, w = np.array([model[-1]["coefficient"], *[m["coefficient"] for m in model[:-1]]]), rows["weight"].to_numpy()
    p = 1 / (1 + np.exp(-z @ b))
    assert np.abs(z.T @ (w * (p - rows["target_reported"])) + np.r_[0, b[1:]] / 0.1).max() < 1e-2

    got = {(r["model"], r["target"]): r for r in registered.QUERIES["loto_metrics"].build(spark, data).collect()}
    assert set(got) == {(m, t) for m in registered.FEATURE_SETS for t in mapping.TECHNOLOGIES}
    for t in mapping.TECHNOLOGIES:
        fitted = portability.fit_ranker(tasks.where(f"target <> '{t}'"), registered.FEATURE_SETS["context"], "target_reported", "locus", 0.1)
        want = stats.auroc(portability.with_score(tasks.where(f"target = '{t}'"), fitted), "score", "target_reported").first()
        assert got["context", t]["n"] == want["n"] and got["context", t]["auroc"] == pytest.approx(want["auroc"], abs=2e-3)

    record = {r["metric"]: r["value"] for r in registered.QUERIES["ranker_evaluation"].build(spark, data).collect()}
    held = registered.QUERIES["evaluation_measures"].build(spark, data).where("cell = 'F'").first()
    for name in ("n", "n_pos", "prevalence", "auroc", "average_precision", "expected_50", "expected_lift_200"):
        assert record[name] == pytest.approx(held[name])
    assert record["auroc_low"] <= record["auroc"] <= record["auroc_high"]


def test_values_of_burden_and_effects_without_sql(spark, data):
    """The joint test of slopes by one least-squares solution, and random effects by a fine grid of variances."""
    import numpy as np

    from siteweave.plans import queries as registered

    rows = registered._burdens(spark, data).selectExpr("cast(dataset as string) as dataset", "gene", "z", "x", "l").dropna().toPandas()
    levels = sorted(rows["dataset"].unique())
    flags = np.column_stack([rows["dataset"] == d for d in levels[1:]]).astype(float)
    burden = rows["x"].to_numpy(float)
    x = np.column_stack([np.ones(len(rows)), burden, rows["l"].to_numpy(float), flags, flags * burden[:, None]])
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ rows["z"].to_numpy(float)
    resid = rows["z"].to_numpy(float) - x @ beta
    sums = np.stack([(x * resid[:, None])[i].sum(axis=0) for i in rows.groupby("gene").indices.values()])
    g, n, k, last = len(sums), len(rows), x.shape[1], len(levels) - 1
    cov = inv @ sums.T @ sums @ inv * g / (g - 1) * (n - 1) / (n - k)
    chi2 = beta[-last:] @ np.linalg.solve(cov[-last:, -last:], beta[-last:])
    got = {r["dataset"]: r for r in registered.QUERIES["burden_by_dataset"].build(spark, data).collect()}
    assert sorted(got) == levels and last > 0
    for d, more in zip(levels, [0.0, *beta[-last:]], strict=True):
        assert got[d]["slope"] == pytest.approx(beta[1] + more, rel=1e-6, abs=1e-9)
        assert (got[d]["n"], got[d]["n_clusters"], got[d]["df"]) == (n, g, last) and got[d]["chi2"] == pytest.approx(chi2, rel=1e-5)

    effects = registered._effects(spark, data).select("beta", "se").dropna().toPandas()
    y, v = effects["beta"].to_numpy(float), effects["se"].to_numpy(float) ** 2
    w = 1 / (v + np.linspace(0, 4 * np.var(y) + 1e-9, 400_001)[:, None])
    mean = (w * y).sum(axis=1) / w.sum(axis=1)
    best = int(np.argmin(-np.log(w).sum(axis=1) + np.log(w.sum(axis=1)) + (w * (y - mean[:, None]) ** 2).sum(axis=1)))
    found = registered.QUERIES["random_effects_meta"].build(spark, data).first()
    assert found["k"] == len(y) > 1
    assert found["tau2"] == pytest.approx(1 / w[best, 0] - v[0], rel=1e-3, abs=1e-5 * np.var(y))
    assert found["random_beta"] == pytest.approx(mean[best], rel=1e-3, abs=1e-6)
    spread = np.sqrt(max(1.0, (w[best] * (y - mean[best]) ** 2).sum() / (len(y) - 1)) / w[best].sum())
    assert found["random_se"] == pytest.approx(spread, rel=1e-3)


def test_values_of_ridge_queries_row_by_row(spark, data):
    """Every train set standardised and solved on its own rows, penalties by plain inner cross-validation."""
    import numpy as np

    from siteweave.operators.ridge import ALPHAS
    from siteweave.plans import modelled
    from siteweave.plans import queries as registered

    def solve(x, y, alphas):
        """Intercept and coefficients of each penalty."""
        mean, sd = x.mean(axis=0), x.std(axis=0)
        sd = np.where(sd > 1e-12, sd, 1.0)
        z, out = (x - mean) / sd, []
        for a in alphas:
            b = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd if np.isfinite(a) else np.zeros(x.shape[1])
            out.append((y.mean() - mean @ b, b))
        return out

    def fit(x, y, folds, inside):
        errors = np.zeros(len(ALPHAS))
        for held in inside:
            train, test = np.isin(folds, [f for f in inside if f != held]), folds == held
            errors += [((y[test] - c - x[test] @ b) ** 2).sum() for c, b in solve(x[train], y[train], ALPHAS)]
        alpha = ALPHAS[np.nonzero(errors <= errors.min() * (1 + 1e-10))[0][-1]]
        train = np.isin(folds, inside)
        return alpha, solve(x[train], y[train], [alpha])[0]

    def nested(x, y, folds):
        out, chosen = np.zeros(len(y)), []
        for outer in np.unique(folds):
            alpha, (c, b) = fit(x, y, folds, [f for f in np.unique(folds) if f != outer])
            out[folds == outer] = c + x[folds == outer] @ b
            chosen.append(alpha)
        return out, chosen

    def added(x, y, folds, extra):
        """The base model's fit plus one of its cross-fitted residuals."""
        out = np.zeros(len(y))
        for outer in np.unique(folds):
            inside, at = [f for f in np.unique(folds) if f != outer], folds == outer
            c, b = fit(x, y, folds, inside)[1]
            resid = y.copy()
            for held in inside:
                c2, b2 = fit(x, y, folds, [f for f in inside if f != held])[1]
                resid[folds == held] -= c2 + x[folds == held] @ b2
            design = np.column_stack([np.ones(len(y)), extra])
            g = np.linalg.lstsq(design[~at], resid[~at], rcond=None)[0]
            out[at] = c + x[at] @ b + design[at] @ g
        return out

    def check(query, want):
        """``want``: (y, prediction) by dataset."""
        got = {r["ds"]: r for r in registered.QUERIES[query].build(spark, data).collect()}
        assert set(got) == set(want) and want
        for d, (y, p) in want.items():
            e2, total = ((y - p) ** 2).sum(), ((y - y.mean()) ** 2).sum()
            assert got[d]["n"] == len(y) and got[d]["rmse"] == pytest.approx(np.sqrt(e2 / len(y)), rel=1e-6)
            assert got[d]["r2"] == pytest.approx(1 - e2 / total, abs=1e-6)

    rows, names = registered._dense(spark, data)
    frame = rows.toPandas().dropna(subset=[*names, "y"])
    weak, plain, more, chosen = 1e8, {}, {}, []
    for d, f in frame.groupby("ds"):
        x, y, folds = f[names].to_numpy(float), f["y"].to_numpy(float), f["fold"].to_numpy()
        p, alphas = nested(x, y, folds)
        plain[d], chosen = (y, p), chosen + alphas
        more[d] = (y, added(x[:, :60], y, folds, x[:, 60:]))
    check("ridge_nested_cv", plain)
    check("residual_addition", more)
    told: dict[float, int] = {}
    for r in registered.QUERIES["ridge_tuning"].build(spark, data).collect():
        told[min(r["alpha"], weak)] = told.get(min(r["alpha"], weak), 0) + r["n"]
    assert told == {a: sum(min(c, weak) == a for c in chosen) for a in {min(c, weak) for c in chosen}}

    frame = modelled._repeated(spark, data)[0].toPandas().dropna(subset=[*names, "y"])
    want = {}
    for d, f in frame.groupby("ds"):
        f = f.assign(prediction=0.0)
        for _, part in f.groupby("repeat"):
            f.loc[part.index, "prediction"] = nested(part[names].to_numpy(float), part["y"].to_numpy(float), part["fold"].to_numpy())[0]
        mean = f.groupby("vec_id")[["y", "prediction"]].mean()
        want[d] = (mean["y"].to_numpy(), mean["prediction"].to_numpy())
    check("repeated_nested_ridge", want)


def test_gene_disjoint_leaves_no_gene_of_the_training_cell(spark, tmp_path):
    """A gene that one technology alone reports in the training cell is no new gene either; high tax is held out, no call."""
    rows = [
        (1, 1, "O", "A", 0.0), (1, 2, "F", "A", 0.0),  # one technology in the other cell, at another locus
        (2, 1, "O", "A", 0.0), (2, 1, "F", "A", 0.0), (2, 1, "F", "N", 0.0),  # two technologies there
        (3, 1, "O", "R", 0.0), (3, 1, "O", "R", 0.08), (3, 2, "O", "N", 0.0),  # in no other cell
        (4, 5, "O", "N", 0.05), (4, 5, "F", "N", 0.06),  # held out only
        (5, 1, "F", "A", 0.0),
    ]
    lines = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_tax double")
    lines.selectExpr("*", "1.0d as l_quantity", "2.0d as l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 6).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    got = plans.queries()["gene_disjoint"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("3:1", 3, 1), ("3:2", 3, 0), ("4:5", 4, 0)]
    same(got, connect(str(tmp_path)), plans.oracle_sql()["gene_disjoint"])
