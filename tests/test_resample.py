"""Counts drawn for cells and chunks against exact distributions; interval joins of any length."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import draws, loci, resample

N = 3000


def frequencies(values):
    counts = Counter(values)
    return {k: n / sum(counts.values()) for k, n in counts.items()}


def close(found, want):
    """Frequencies of ``N`` replicates within five standard errors of their probabilities, and none impossible."""
    assert set(found) <= set(want)
    for k, p in want.items():
        assert abs(found.get(k, 0) - p) <= 5 * math.sqrt(p * (1 - p) / N) + 1e-12, (k, found.get(k), p)


def test_counts_of_three_rows_have_the_exact_distribution(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 2)], "c string, size long")
    got = draws.cell_counts(cells, "size", ["c"], N, 5).groupBy("rep").pivot("c", ["a", "b"]).sum("m").fillna(0).collect()
    assert len(got) == N and all(r["a"] + r["b"] == 3 for r in got)
    close(frequencies(r["a"] for r in got), {k: math.comb(3, k) * (1 / 3) ** k * (2 / 3) ** (3 - k) for k in range(4)})


def test_counts_over_many_chunks_keep_totals_means_and_covariances(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 3)
    sizes = [1, 7, 2, 30, 4, 4, 11, 1]
    cells = spark.createDataFrame(list(enumerate(sizes)), "c long, size long")
    got = draws.cell_counts(cells.repartition(3), "size", ["c"], N, 6)
    again = draws.cell_counts(cells.repartition(1), "size", ["c"], N, 6)
    assert got.exceptAll(again).isEmpty() and again.exceptAll(got).isEmpty()
    m = np.zeros((N, 8))
    for r in got.collect():
        m[r["rep"], r["c"]] = r["m"]
    n, p = sum(sizes), np.array(sizes) / sum(sizes)
    assert (m.sum(axis=1) == n).all()
    cov = n * (np.diag(p) - np.outer(p, p))
    assert np.allclose(m.mean(axis=0), n * p, atol=5 * np.sqrt(cov.diagonal().max() / N))
    assert np.allclose(np.cov(m.T), cov, atol=0.15 * cov.max())
    assert draws.cell_counts(cells.limit(0), "size", ["c"], 4, 1).count() == 0


def test_bootstrap_of_tiny_tables(spark):
    one = spark.createDataFrame([(1.0, 1, "k")], "s double, y int, k string")
    for by_row in (False, True):
        got = resample.row_bootstrap(one, ["s"], "y", "k", 4, 1, 0.1, by_row=by_row).collect()
        assert sorted(r["rep"] for r in got) == [0, 1, 2, 3] and all(r["auroc_s"] is None and r["lift_s"] == 1.0 for r in got)
        assert resample.row_bootstrap(one.limit(0), ["s"], "y", "k", 4, 1, 0.1, by_row=by_row).count() == 0
    two = spark.createDataFrame([(1.0, 0, "k"), (2.0, 1, "l")], "s double, y int, k string")
    got = resample.row_bootstrap(two, ["s"], "y", "k", N, 2).collect()
    close(frequencies(r["auroc_s"] for r in got), {None: 0.5, 1.0: 0.5})


def test_both_kinds_of_draws_have_one_distribution(spark):
    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 12)), int(rng.random() < 0.4), str(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "s double, y int, k string").withColumn("t", F.col("s") % 5)
    sides = [np.array([(r["auroc_s"], r["auroc_t"]) for r in resample.row_bootstrap(df, ["s", "t"], "y", "k", 400, 4, by_row=b).collect()]) for b in (False, True)]
    for a, b in zip(sides[0].T, sides[1].T, strict=True):
        assert abs(a.mean() - b.mean()) < 5 * b.std() * math.sqrt(2 / 400) and 0.8 < a.std() / b.std() < 1.25
    assert abs(np.corrcoef(sides[0].T)[0, 1] - np.corrcoef(sides[1].T)[0, 1]) < 0.2


def test_permutation_of_a_small_table_has_the_exact_distribution(spark):
    data = [("s", 1.0, 1), ("s", 1.0, 0), ("s", 4.0, 0), ("s", 9.0, 1), ("t", 2.0, 0), ("t", 3.0, 1), ("u", 5.0, 0)]
    rows = [(s, i, v, y) for i, (s, v, y) in enumerate(data)] + [("s", 99, None, 1), (None, 98, 1.0, 1)]
    df = spark.createDataFrame(rows, "stratum string, k int, v double, y int")
    want = Counter()
    for a, b in itertools.product(itertools.combinations(range(4), 2), [(4,), (5,)]):
        ones = {*a, *b}
        mean = lambda side: sum(data[i][1] for i in side) / len(side)
        want[round(mean(ones) - mean(set(range(7)) - ones), 9)] += 1
    got = resample.stratified_permutation(df.repartition(3), "v", "y", "stratum", "k", N, 7)
    assert got.count() == N
    close(frequencies(round(r["difference"], 9) for r in got.collect()), {k: n / sum(want.values()) for k, n in want.items()})
    again = resample.stratified_permutation(df.repartition(1), "v", "y", "stratum", "k", N, 7)
    assert got.exceptAll(again).isEmpty()


def test_permutation_over_chunks_keeps_its_moments(spark, monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 5)
    rng = np.random.default_rng(4)
    v, y = rng.normal(size=60).round(2), (np.arange(60) % 3 == 0).astype(int)
    df = spark.createDataFrame([("s", i, float(a), int(b)) for i, (a, b) in enumerate(zip(v, y, strict=True))], "g string, k int, v double, y int")
    d = np.array([r["difference"] for r in resample.stratified_permutation(df, "v", "y", "g", "k", N, 8).collect()])
    sd = math.sqrt(v.var(ddof=1) * 60 / (20 * 40))
    assert abs(d.mean()) < 5 * sd / math.sqrt(N) and 0.93 < d.std() / sd < 1.07


def test_no_row_is_repeated_for_a_replicate(spark):
    """The plans without ``by_row`` explode replicates over groups and chunks only."""
    df = spark.range(2000).selectExpr("id as k", "cast(id % 7 as double) as v", "cast(id % 2 as int) as y", "'s' as g")
    plan = resample.stratified_permutation(df, "v", "y", "g", "k", 500, 1)._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan


def test_r_squared_of_chunks_and_of_single_draws_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.normal(size=300)
    rows = [("a" if i < 200 else "b", i, float(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)]
    rows += [("one", 1000, 1.0, 1.0, 1.0), ("b", 1001, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ds string, u long, y double, p double, q double")
    sides = []
    for by_row, size in ((True, 1), (False, 2048), (False, 16)):
        monkeypatch.setattr(resample, "CHUNK_ROWS", size)
        got = resample.r2_bootstrap(df.repartition(3), "ds", "u", "y", ["p", "q"], 300, 9, by_row=by_row)
        assert got.columns == ["rep", "ds", "times", "r2_p", "r2_q"] and got.count() == 900
        sides.append({d: np.array([(r["r2_p"], r["r2_q"]) for r in got.where(F.col("ds") == d).collect()]) for d in ("a", "b")})
        assert got.where("ds = 'one' and r2_p is not null").count() == 0
    for other in sides[1:]:
        for d in ("a", "b"):
            a, b = other[d], sides[0][d]
            assert (abs(a.mean(axis=0) - b.mean(axis=0)) < 5 * b.std(axis=0) * math.sqrt(2 / 300)).all() and (abs(np.log(a.std(axis=0) / b.std(axis=0))) < 0.25).all()
    both = resample.r2_bootstrap(df, "ds", "u", "y", ["p"], 50, 9, hierarchical=True)
    assert {r["n"] for r in both.groupBy("rep").agg(F.sum("times").alias("n")).collect()} == {3}
    assert resample.r2_bootstrap(df.limit(0), "ds", "u", "y", ["p"], 5, 9).count() == 0


def test_random_sets_are_the_smallest_draws_with_and_without_the_bound(spark):
    df = spark.range(5000).selectExpr("id as k", "cast(id as double) as v")
    got = {r["rep"]: r["mean"] for r in resample.random_sets(df, "k", "v", 3, 30, 2).collect()}
    ranked = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("d", resample.draw(2, "rep", "k")).toPandas().sort_values(["rep", "d", "k"])
    assert got == {r: float(f["v"].head(3).mean()) for r, f in ranked.groupby("rep")}
    few = resample.random_sets(df.limit(2), "k", "v", 3, 4, 2).collect()
    assert len(few) == 4 and len({r["mean"] for r in few}) == 1 and resample.random_sets(df.limit(0), "k", "v", 3, 4, 2).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_of_any_length_meet_their_points(spark, how):
    rng = np.random.default_rng(6)
    intervals = [(f"c{i % 2}", int(s), int(s + 10 ** rng.uniform(0, 8)), i) for i, s in enumerate(rng.integers(0, 10**8, 150))]
    intervals += [("c0", 5, 5, 1000), ("c0", 9, 3, 1001), ("c1", None, 7, 1002), ("c0", 0, 10**8, 1003), ("c0", 64, 127, 1004), ("c0", 63, 127, 1005)]
    points = [(f"c{i % 2}", int(p), i) for i, p in enumerate(rng.integers(0, 10**8, 150))] + [("c0", 5, 500), ("c0", 5, 500), ("c0", None, 501), ("c0", 127, 502), ("c0", 128, 503), (None, 5, 504)]
    iv = spark.createDataFrame(intervals, "chrom string, lo long, hi long, name int")
    pt = spark.createDataFrame(points, "chrom string, pos long, id int")
    want = []
    for c, p, i in points:
        held = [n for d, lo, hi, n in intervals if c is not None and c == d and p is not None and lo is not None and lo <= p <= hi]
        want += [(i, n) for n in held] or ([(i, None)] if how == "left" else [])
    got = [(r["id"], r["name"]) for r in loci.within(pt, iv, ["chrom"], "pos", "lo", "hi", 32, how).collect()]
    key = lambda x: (x[0], x[1] or -1)
    assert sorted(got, key=key) == sorted(want, key=key)
    spread = iv.where("lo <= hi").withColumn("level", loci._level("lo", "hi", 32))
    bins = F.sequence(loci._bin(F.col("lo"), F.col("level"), 32), loci._bin(F.col("hi"), F.col("level"), 32))
    assert spread.select(F.max(F.size(bins))).first()[0] <= 2
    assert loci.within(pt, iv.limit(0), ["chrom"], "pos", "lo", "hi", 32, how).count() == (len(points) if how == "left" else 0)


def test_draws_in_batches_are_those_of_sql(spark):
    tails = ["", "7", "12:5", "é" * 30, "x" * 44, "x" * 45, "x" * 46, "x" * 200, *map(str, range(300))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tails)], "i int, t string")
    for seed, rep in ((3, 0), (15, 10), (-4, 1999), (10**60, 5)):
        want = [r["d"] for r in df.select("i", resample.draw(seed, F.lit(rep), "t").alias("d")).orderBy("i").collect()]
        assert next(draws.text_draws([f"{seed}|{rep}|".encode()], [t.encode() for t in tails])).tolist() == want


def test_drawn_rows_are_counted_by_cell_inside_tasks(spark, monkeypatch):
    """Draws of few cells never leave a task, and are those that are joined to the bounds of many."""
    monkeypatch.setattr(resample, "BATCH", 64)
    df = spark.range(500).selectExpr("id as k", "cast(id * 7 % 11 as double) as s", "cast(id % 3 as double) as t", "cast(id % 5 < 2 as int) as y")
    few = resample.row_bootstrap(df, ["s", "t"], "y", "k", 30, 9, by_row=True)
    cells = df.groupBy("s", "t", "y").agg(F.count("*").alias("size"))
    counted = resample._hashed_counts(cells, ["s", "t"], 30, 9)
    assert "md5" not in counted._jdf.queryExecution().toString()
    assert {r[1] for r in counted.groupBy("rep").agg(F.sum("m")).collect()} == {500}
    monkeypatch.setattr(resample, "MOST_CELLS", 3)
    many = resample.row_bootstrap(df, ["s", "t"], "y", "k", 30, 9, by_row=True)
    assert few.count() == 30 and few.exceptAll(many).isEmpty()


def test_smallest_hashes_of_a_stratum_are_found_near_their_place(spark, monkeypatch):
    """Label 1 goes to the smallest hashes, whether these are sought in a band, in one that misses them, or tie."""
    import hashlib

    data = [(s, f"{s}:{i}", float(i * 7 % 13), int(i % m == 0)) for s, n, m in (("a", 3000, 3), ("b", 400, 50), ("c", 30, 1), ("d", 1, 2), ("e", 60, 99)) for i in range(n)]
    data += [("t", "twin", float(v), int(v < 3)) for v in (5, 5, 5, 5, 5)]
    df = spark.createDataFrame(data, "s string, k string, v double, y int").repartition(3)
    want = {}
    for rep in range(6):
        ones = []
        for s in "abcdet":
            own = sorted((hashlib.md5(f"9|{rep}|{k}".encode()).hexdigest()[:12], k, v) for t, k, v, _ in data if t == s)
            ones += [v for _, _, v in own[: sum(y for t, _, _, y in data if t == s)]]
        rest = sum(v for _, _, v, _ in data) - sum(ones)
        want[rep] = sum(ones) / len(ones) - rest / (len(data) - len(ones))
    for band, batch in ((resample.BAND, resample.BATCH), (0.0, 100), (-1.0, 7)):
        monkeypatch.setattr(resample, "BAND", band)
        monkeypatch.setattr(resample, "BATCH", batch)
        got = resample.stratified_permutation(df, "v", "y", "s", "k", 6, 9, by_row=True)
        assert {r["rep"]: r["difference"] for r in got.collect()} == pytest.approx(want)
    assert "md5" not in resample.stratified_permutation(df.where("s = 'c'"), "v", "y", "s", "k", 6, 9, by_row=True)._jdf.queryExecution().toString()


def test_draws_of_r_squared_stay_in_tasks_or_are_merged(spark, monkeypatch):
    """Draws of datasets that tasks hold, and of larger ones, are the same; the latter are never broadcast."""
    monkeypatch.setattr(resample, "CHUNK_ROWS", 16)
    monkeypatch.setattr(resample, "BATCH", 64)
    df = spark.range(300).selectExpr("if(id < 190, 'a', if(id < 299, 'bé', 'one')) as ds", "id as u", "cast(id * 7 % 11 as double) as y", "cast(id * 5 % 7 as double) as p", "cast(id % 4 as double) as q")
    for hierarchical in (False, True):
        found = []
        for held in (1 << 22, 400, 0):
            monkeypatch.setattr(resample, "MOST_HELD", held)
            out = resample.r2_bootstrap(df.repartition(3), "ds", "u", "y", ["p", "q"], 20, 9, hierarchical=hierarchical, by_row=True)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert ("sequence(first" in plan) == (held < 1 << 22) and not any("BroadcastHashJoin" in x and "idx" in x for x in plan.splitlines())
            found.append({(r["rep"], r["ds"]): (r["times"], r["r2_p"], r["r2_q"]) for r in out.collect()})
        assert {k[1] for k in found[0]} == {"a", "bé", "one"} and found[0].keys() == found[1].keys() == found[2].keys()
        for k, (times, p, q) in found[0].items():
            for other in found[1:]:
                assert (other[k][0], *other[k][1:]) == (times, *([None, None] if k[1] == "one" else [pytest.approx(p), pytest.approx(q)]))


def test_drawn_units_are_summed_where_their_rows_are(spark, monkeypatch):
    """Sums over hashed draws, whatever the chunks, shares and runs; none of the draws is a row."""
    import hashlib

    for name, value in (("MOST_HELD", 60), ("CHUNK_ROWS", 7), ("BATCH", 32), ("RUN_DRAWS", 50), ("RUN_REPLICATES", 3)):
        monkeypatch.setattr(resample, name, value)
    rows = [(i, [1.0, float(i * i % 17)]) for i in range(130)]
    df = spark.createDataFrame(rows, "idx long, v array<double>").repartition(3)
    out = resample._drawn_sums(df, len(rows), 2, 8, 5)
    assert "md5" not in out._jdf.queryExecution().toString()
    got = {r["rep"]: r["g"] for r in out.collect()}
    for rep in range(8):
        picks = [int(hashlib.md5(f"5|{rep}|{i}".encode()).hexdigest()[:12], 16) % 130 for i in range(130)]
        assert got[rep] == [130.0, sum(rows[p][1][1] for p in picks)]
    assert len(got) == 8 and resample._drawn_sums(df.limit(0), 0, 2, 8, 5).count() == 0
