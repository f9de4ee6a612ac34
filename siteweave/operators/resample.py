"""Bootstrap and permutation tests whose draws any partitioning repeats.

Replicates meet aggregates (clusters, cells of equal rows), never rows. A replicate's statistic is
the grouped form of the statistic itself. Where rows are what is drawn, counts are drawn for their
cells (``draws``), or, for R-squared, for chunks of rows and then inside the chunk.

``by_row=True`` draws every row by a hash instead, rows times replicates: SQL can repeat these
draws, so the statistics are held to SQL with them. Both kinds have the same distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import BATCH, cell_counts, chunked, drawn_chunks, split, stream, text_draws
from .ranks import bh_adjust, histogram, running, with_totals
from .stats import auroc_of
from .storage import stable

#: Draws from one dataset that one row of a plan stands for.
RUN = 10000


def draw(seed: int, *parts) -> Column:
    """48 random bits from a seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def numbered(df: DataFrame, order: list[str], out: str = "idx", group: list[str] = ()) -> DataFrame:
    """``df`` with a number from 0 along an order that is total (within each ``group``)."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return running(one, list(group), [F.col(c) for c in order], ["__one"]).withColumn(out, F.col("cum___one") - 1).drop("__one", "cum___one")


def multiplicities(spark, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, idx, m): how often each of n things is drawn in n draws with replacement, by replicate."""
    draws = spark.range(n * replicates).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("i"))
    return draws.groupBy("rep", (draw(seed, "rep", "i") % n).alias("idx")).agg(F.count("*").alias("m"))


def interval(values: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of replicates: ci_low, ci_high, n_boot."""
    tail = (1 - level) / 2
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    return values.agg(q(tail).alias("ci_low"), q(1 - tail).alias("ci_high"), F.count(value).alias("n_boot"))


def cluster_bootstrap_auroc(df: DataFrame, score: str, label: str, cluster: str, replicates: int, seed: int, least: int = 5) -> DataFrame:
    """RS-01: (rep, auroc) with clusters drawn with replacement; no rows below ``least`` clusters."""
    spark = df.sparkSession
    names = numbered(df.where(F.col(cluster).isNotNull()).select(cluster).distinct(), [cluster])
    n = names.count()
    hist = histogram(df, [cluster], score, label).join(names, cluster)
    if n < least:
        return spark.createDataFrame([], "rep long, auroc double")
    drawn = hist.join(multiplicities(spark, n, replicates, seed), "idx")
    weighted = drawn.groupBy("rep", score).agg(F.sum(F.col("m") * F.col("pos")).alias("pos"), F.sum(F.col("m") * F.col("neg")).alias("neg"))
    return auroc_of(weighted, score, ["rep"]).select("rep", "auroc")


def row_bootstrap(df: DataFrame, scores: list[str], label: str, key: str, replicates: int, seed: int, fraction: float | None = None, by_row: bool = False) -> DataFrame:
    """RS-02, 06: (rep, auroc_<score>, ...) of rows drawn with replacement; several scores share the draws.

    With ``fraction`` also lift_<score> of that top share, ties at its edge included. Rows of equal
    scores and label are one cell, and a replicate is a count per cell (``draws.cell_counts``). With
    ``by_row``, rows are numbered cell by cell (``key`` orders nothing but equal cells) and each draw
    is a hash that falls into a cell's run of numbers. Rows with a null score or label take no part.
    """
    y, scores = F.col(label).cast("long"), list(dict.fromkeys(scores))
    known = df.where(y.isNotNull())
    for s in scores:
        known = known.where(F.col(s).isNotNull())
    cells = known.groupBy(*scores, y.alias("y")).agg(F.count("*").alias("size"))
    counted = _hashed_counts(cells, scores, replicates, seed) if by_row else cell_counts(cells, "size", [*scores, "y"], replicates, seed)
    cell = stable(counted.groupBy("rep", *scores).agg(F.sum(F.col("m") * F.col("y")).alias("pos"), F.sum(F.col("m") * (1 - F.col("y"))).alias("neg")))
    out = None
    for s in scores:
        hist = cell.groupBy("rep", s).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
        part = auroc_of(hist, s, ["rep"]).select("rep", F.col("auroc").alias(f"auroc_{s}"))
        if fraction is not None:
            top = running(with_totals(hist, ["rep"], ["n", "pos"]), ["rep"], [F.col(s).desc()], ["n"])
            inside = F.col("cum_n") - F.col("n") < F.greatest(F.ceil(F.lit(fraction) * F.col("total_n")), F.lit(1))
            rate = lambda p, q: F.try_divide(F.sum(F.when(inside, F.col(p))), F.sum(F.when(inside, F.col(q))))
            lift = F.try_divide(rate("pos", "n"), F.max("total_pos") / F.max("total_n"))
            part = part.join(top.groupBy("rep").agg(lift.alias(f"lift_{s}")), "rep")
        out = part if out is None else out.join(part, "rep")
    return out


#: Cells whose bounds every task of hashed draws holds; the draws of more are joined to them instead.
MOST_CELLS = 1 << 16


def _hashed_counts(cells: DataFrame, scores: list[str], replicates: int, seed: int) -> DataFrame:
    """(rep, <scores>, y, m) of cells, a hash per draw."""
    cells = running(cells, [], [*[F.col(s) for s in scores], F.col("y")], ["size"])
    cells = stable(cells.select(*scores, "y", (F.col("cum_size") - F.col("size")).alias("first"), (F.col("cum_size") - 1).alias("last")))
    last, many = cells.agg(F.max("last"), F.count("*")).first()
    n = 0 if last is None else last + 1
    if n and many <= MOST_CELLS:
        hit = _cell_draws(cells, n, replicates, seed).join(F.broadcast(cells), "first")  # ``MOST_CELLS`` at most
        return hit.select("rep", *scores, "y", "m")
    width = max(1, n // 1000)
    drawn = multiplicities(cells.sparkSession, n, replicates, seed) if n else cells.select(F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("m")).limit(0)
    spread = cells.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    hit = drawn.withColumn("bin", F.floor(F.col("idx") / width)).join(spread, "bin").where(F.col("idx").between(F.col("first"), F.col("last")))
    return hit.select("rep", *scores, "y", "m")


def _cell_draws(cells: DataFrame, n: int, replicates: int, seed: int) -> DataFrame:
    """(rep, first, m): how many of a replicate's n draws fall into the cell that begins at ``first``.

    Tasks hash runs of draws for a share of the replicates and count them by cell, so no draw leaves a task.
    """
    spark = cells.sparkSession
    firsts = np.array(sorted(r["first"] for r in cells.select("first").collect()), np.int64)  # ``MOST_CELLS`` at most
    share = min(replicates, max(1, (1 << 22) // len(firsts)))  # counts that a task holds
    runs = -(-n // BATCH)
    work = runs * -(-replicates // share)
    parts = min(work, max(int(spark.conf.get("spark.sql.shuffle.partitions")), work * share // 4096))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(part: int, m: np.ndarray) -> pd.DataFrame:
            rep, at = np.nonzero(m)
            return pd.DataFrame({"rep": rep + part * share, "first": firsts[at], "m": m[rep, at]})

        now, held = None, None
        for part, run in (divmod(int(w), runs) for f in frames for w in f["id"]):
            reps = range(part * share, min((part + 1) * share, replicates))
            if part != now:
                if held is not None:
                    yield told(now, held)
                now, held = part, np.zeros((len(reps), len(firsts)), np.int64)
            tails = [b"%d" % i for i in range(run * BATCH, min((run + 1) * BATCH, n))]
            for m, drawn in zip(held, text_draws([b"%d|%d|" % (seed, r) for r in reps], tails), strict=True):
                m += np.bincount(np.searchsorted(firsts, drawn % n, "right") - 1, minlength=len(firsts))
        if held is not None:
            yield told(now, held)

    counted = spark.range(0, work, 1, parts).mapInPandas(count, "rep long, first long, m long")
    return counted.groupBy("rep", "first").agg(F.sum("m").alias("m"))


def paired_difference(df: DataFrame, scores: tuple[str, str], label: str, key: str, replicates: int, seed: int, by_row: bool = False) -> DataFrame:
    """RS-06: interval of AUROC(second) - AUROC(first) over shared draws, and the share of replicates above 0."""
    both = row_bootstrap(df, list(scores), label, key, replicates, seed, by_row=by_row)
    diffs = both.withColumn("delta", F.col(f"auroc_{scores[1]}") - F.col(f"auroc_{scores[0]}"))
    q = lambda p: F.percentile(F.col("delta"), F.lit(p))
    return diffs.agg(q(0.025).alias("ci_low"), q(0.975).alias("ci_high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_above_0"), F.count("delta").alias("n_boot"))


def mapping_permutation(df: DataFrame, category: str, score: str, label: str, replicates: int, seed: int) -> DataFrame:
    """RS-03: (rep, auroc) with the categories' scores dealt to the categories anew in each replicate."""
    cells = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(category).agg(
        F.min(score).alias("score"), F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    cells = numbered(cells, [category])
    reps = cells.select(category, "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    w = Window.partitionBy("rep").orderBy(draw(seed, "rep", category), category)
    dealt = reps.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).join(cells.select("idx", "score"), "idx")
    hist = dealt.groupBy("rep", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auroc_of(hist, "score", ["rep"]).select("rep", "auroc")


def permutation_p(replicates: DataFrame, value: str, observed: float) -> DataFrame:
    """Upper, lower and two-sided p, (count + 1) / (n + 1)."""
    n = F.count(value)
    upper = (F.count_if(F.col(value) >= observed) + 1) / (n + 1)
    lower = (F.count_if(F.col(value) <= observed) + 1) / (n + 1)
    return replicates.agg(
        n.alias("permutations"), upper.alias("p_upper"), lower.alias("p_lower"), F.least(F.lit(1.0), 2 * F.least(upper, lower)).alias("p_two_sided")
    )


def stratified_permutation(df: DataFrame, value: str, label: str, stratum: str, key: str, replicates: int, seed: int, by_row: bool = False) -> DataFrame:
    """RS-04: (rep, difference) of mean value between labels, which are dealt anew inside each stratum.

    Rows of one value and stratum are one cell; a replicate's labels 1 are a multivariate
    hypergeometric count per cell, so no row is repeated. With ``by_row`` every row is ranked by a
    hash instead. Rows with a null take no part; with one label only, the difference is null.
    """
    rows = df.select(stratum, key, F.col(value).cast("double").alias("v"), F.col(label).cast("long").alias("y")).dropna()
    if by_row:
        return _hashed_permutation(rows, stratum, key, replicates, seed)
    cells = rows.groupBy(F.col(stratum).alias("__stratum"), "v").agg(F.count("*").alias("size"))
    chunks = chunked(cells, ["__stratum"], ["v"], "size", ["v"])
    ones = rows.groupBy(F.col(stratum).alias("__stratum")).agg(F.sum("y").alias("n"))
    reps = ones.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    asked = drawn_chunks(chunks, ["__stratum"], reps, seed, False).withColumn("__g", F.xxhash64("__stratum", "chunk")).select("rep", "__g", "n", "sizes", "v")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums = [float(split(np.asarray(s, np.int64), int(n), False, stream(seed, r, g, 1)) @ np.asarray(v)) for r, g, n, s, v in zip(f["rep"], f["__g"], f["n"], f["sizes"], f["v"], strict=True)]
            yield pd.DataFrame({"rep": f["rep"], "v1": sums}).groupby("rep", as_index=False).sum()

    dealt = asked.mapInPandas(deal, "rep long, v1 double").groupBy("rep").agg(F.sum("v1").alias("v1"))
    return _differences(rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1"), F.sum("v").alias("v")), dealt, replicates)


def _differences(all_: DataFrame, dealt: DataFrame, replicates: int) -> DataFrame:
    """(rep, difference) from ``dealt``, the sum v1 of the values with label 1 by replicate (none: 0); ``all_`` is one row, n, n1 and v of all."""
    both = all_.sparkSession.range(replicates).select(F.col("id").alias("rep")).join(dealt, "rep", "left").crossJoin(all_).where("n > 0")
    v1 = F.coalesce("v1", F.lit(0.0))
    return both.select("rep", (F.try_divide(v1, F.col("n1")) - F.try_divide(F.col("v") - v1, F.col("n") - F.col("n1"))).alias("difference"))


#: Half the width, in standard errors of a rank, of the draws among which a stratum's last label 1 is sought.
BAND = 4.5
#: Strata that are broadcast to their rows, and rows of one stratum, about, that one task hashes.
FEW_STRATA, STRATUM_ROWS = 100_000, 1 << 15


def _hashed_permutation(rows: DataFrame, stratum: str, key: str, replicates: int, seed: int) -> DataFrame:
    """The ``ones`` smallest hashes of a stratum have label 1, ties by ``key``; rows are hashed inside tasks.

    Of n hashes the k smallest lie under about k / n of their range. What is surely below leaves its
    task as a sum; only hashes near that place leave it themselves, some square root of n. Where the
    last label 1 isn't among these, or hangs on a tie, the stratum is ranked row by row instead.
    """
    per = rows.groupBy(stratum).agg(F.sum("y").alias("ones"), F.count("*").alias("__n"), F.sum("v").alias("__v"))
    half = F.lit(BAND) * F.sqrt(F.col("ones") * (1 - F.col("ones") / F.col("__n"))) + 4
    edge = lambda k: F.floor(F.least(F.greatest(k / F.col("__n"), F.lit(0.0)), F.lit(1.0)) * F.lit(float(1 << 48))).cast("long")
    per = stable(per.select(stratum, "ones", "__n", "__v", edge(F.col("ones") - half).alias("__lo"), edge(F.col("ones") + half).alias("__hi"), F.ceil(F.col("__n") / STRATUM_ROWS).alias("__parts")))
    few = per.drop("__n", "__v")
    few = F.broadcast(few) if per.count() <= FEW_STRATA else few
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(few, stratum).select(
        F.col(stratum).alias("__s"), "ones", "__lo", "__hi", F.encode(F.col(key).cast("string"), "utf-8").alias("__k"), "v", F.pmod(F.xxhash64(F.lit("part"), key), "__parts").alias("__part")
    )
    placed = placed.repartition(spread, "__s", "__part").sortWithinPartitions("__s").drop("__part")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def hashed(f: pd.DataFrame) -> pd.DataFrame:
            name, ones, lo, hi = f[["__s", "ones", "__lo", "__hi"]].iloc[0]
            v, out = f["v"].to_numpy(float), []
            for rep, d in enumerate(text_draws([b"%d|%d|" % (seed, r) for r in range(replicates)], f["__k"].tolist())):
                below = d < lo
                at = np.nonzero((d < hi) & ~below)[0]
                out.append((rep, name, ones, np.count_nonzero(below), v[below].sum(), d[at], v[at]))
            return pd.DataFrame(out, columns=["rep", "__s", "ones", "below", "sum", "d", "v"])

        held: list[pd.DataFrame] = []
        for f in frames:
            for _, own in f.groupby((f["__s"] != f["__s"].shift()).cumsum(), sort=False):
                if held and (held[0]["__s"].iloc[0] != own["__s"].iloc[0] or sum(map(len, held)) >= BATCH):
                    yield hashed(pd.concat(held))
                    held = []
                held.append(own)
        if held:
            yield hashed(pd.concat(held))

    kind = rows.schema[stratum].dataType.simpleString()
    found = placed.mapInPandas(near, f"rep int, __s {kind}, ones long, below long, sum double, d array<long>, v array<double>")
    joint = found.groupBy("rep", "__s", "ones").agg(
        F.sum("below").alias("below"), F.sum("sum").alias("sum"), F.flatten(F.collect_list("d")).alias("d"), F.flatten(F.collect_list("v")).alias("v")
    )

    def last(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: list[float | None] = []
            for ones, below, total, d, v in zip(f["ones"], f["below"], f["sum"], f["d"], f["v"], strict=True):
                k, order = ones - below, np.argsort(d)
                sure = 0 <= k <= len(d) and (k in (0, len(d)) or d[order[k - 1]] < d[order[k]])
                sums.append(total + np.asarray(v, float)[order[:k]].sum() if sure else None)
            yield pd.DataFrame({"rep": f["rep"], "__s": f["__s"], "v1": sums})

    sums = stable(joint.mapInPandas(last, f"rep int, __s {kind}, v1 double"))
    unsure = sums.where(F.col("v1").isNull()).select("rep", F.col("__s").alias(stratum))
    if not unsure.isEmpty():
        drawn = rows.join(per.select(stratum, "ones"), stratum).join(unsure, stratum).withColumn("__draw", draw(seed, "rep", key)).withColumn("__one", F.lit(1).cast("long"))
        ranked = running(drawn, ["rep", stratum], [F.col("__draw"), F.col(key)], ["__one"])
        sums = sums.select("rep", "v1").unionByName(ranked.where(F.col("cum___one") <= F.col("ones")).select("rep", F.col("v").alias("v1")))
    all_ = per.agg(F.sum("__n").alias("n"), F.sum("ones").alias("n1"), F.sum("__v").alias("v"))
    return _differences(all_, sums.groupBy("rep").agg(F.sum("v1").alias("v1")), replicates).withColumn("rep", F.col("rep").cast("int"))


def random_sets(df: DataFrame, key: str, value: str, k: int, replicates: int, seed: int) -> DataFrame:
    """RS-05: (rep, mean) of ``k`` distinct rows drawn in each replicate: those with the smallest draws.

    Of n rows the k smallest draws lie under about k / n of their range, so only rows under a bound
    somewhat above leave the scan, a few more than k per replicate. A replicate with fewer than k
    under it, which hardly ever occurs, is drawn again without the bound.
    """
    rows = df.select(key, value)
    bound = int(min(1.0, (k + 8 * k**0.5 + 16) / max(rows.count(), 1)) * (1 << 48))

    def drawn(reps: DataFrame | None, most: int) -> DataFrame:
        spread = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)) if reps is None else F.array(*[F.lit(r) for r in reps])))
        return spread.withColumn("__draw", draw(seed, "rep", key)).where(F.col("__draw") <= most)

    near = stable(drawn(None, bound))
    full = {r["rep"] for r in near.groupBy("rep").count().where(F.col("count") >= k).collect()}  # a row per replicate
    short = sorted(set(range(replicates)) - full)
    found = near if not short or bound >= 1 << 48 else near.where(~F.col("rep").isin(short)).unionByName(drawn(short, 1 << 48))
    w = Window.partitionBy("rep").orderBy("__draw", key)
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("rep").agg(F.avg(value).alias("mean"))


def slope_differences(df: DataFrame, unit: str, outcome: str, slopes: dict[str, list[str]], replicates: int, seed: int) -> DataFrame:
    """RS-07: (rep, slope name, beta): the first predictor's coefficient of each model, units drawn with replacement.

    ``slopes`` maps a name to its model's predictors. Each unit's Gram sums are gathered once and
    weighted by its multiplicity; a replicate's small systems are solved in one row.
    """
    import numpy as np
    import pandas as pd

    used = sorted({p for ps in slopes.values() for p in ps})
    rows = df.select(unit, outcome, *used).dropna()
    names = ["__one", *used, outcome]
    cols = {"__one": F.lit(1.0)} | {c: F.col(c).cast("double") for c in [*used, outcome]}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy(unit).agg(*[F.sum(cols[a] * cols[b]).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    units = numbered(sums, [unit]).select("idx", F.array(*[F.col(f"s{i}") for i in range(len(pairs))]).alias("v"))
    grams = _drawn_sums(units, units.count(), len(pairs), replicates, seed)
    place = {p: i for i, p in enumerate(pairs)}
    at = lambda a, b: place.get((a, b), place.get((b, a)))

    def solve(frames):
        for f in frames:
            out = []
            for rep, g in zip(f["rep"], f["g"], strict=True):
                for name, ps in slopes.items():
                    xs = ["__one", *ps]
                    h = np.array([[g[at(a, b)] for b in xs] for a in xs])
                    out.append((rep, name, float((np.linalg.pinv(h) @ [g[at(a, outcome)] for a in xs])[1])))
            yield pd.DataFrame(out, columns=["rep", "name", "beta"])

    return grams.mapInPandas(solve, "rep long, name string, beta double")


#: Numbers hashed at a time whose draws leave together, and replicates that a task hashes them for at once.
RUN_DRAWS, RUN_REPLICATES = 1 << 16, 64


def _drawn_sums(rows: DataFrame, n: int, width: int, replicates: int, seed: int) -> DataFrame:
    """(rep, g): sums of the arrays ``v`` (``width`` numbers) of ``n`` rows numbered by ``idx`` over n hashed draws.

    Draws go to the chunk of rows that they fall into, 4 bytes each and sorted; a task holds a chunk of
    up to ``MOST_HELD`` numbers and adds up a share of the replicates.
    """
    spark = rows.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, MOST_HELD // width)
    chunks, runs = -(-n // size), -(-n // RUN_DRAWS)
    shares = max(1, min(MOST_SHARES, replicates, spread // max(chunks, 1)))

    def draws(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in (int(w) for f in frames for w in f["id"]):
            for first in range(0, replicates, RUN_REPLICATES):
                reps = range(first, min(first + RUN_REPLICATES, replicates))
                found: list[list[np.ndarray]] = [[] for _ in reps]
                for i in range(run * RUN_DRAWS, min((run + 1) * RUN_DRAWS, n), BATCH):
                    tails = [b"%d" % j for j in range(i, min(i + BATCH, (run + 1) * RUN_DRAWS, n))]
                    for held, d in zip(found, text_draws([b"%d|%d|" % (seed, r) for r in reps], tails), strict=True):
                        held.append(d % n)
                out = []
                for rep, held in zip(reps, found, strict=True):
                    idx = np.sort(np.concatenate(held))
                    cut = np.searchsorted(idx, np.arange(chunks + 1) * size)
                    out += [(c, rep % shares, rep, (idx[a:b] - c * size).astype("<u4").tobytes()) for c, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                yield pd.DataFrame(out, columns=["chunk", "share", "rep", "at"])

    drawn = spark.range(0, runs, 1, max(1, min(runs, spread))).mapInPandas(draws, "chunk long, share int, rep long, at binary")
    drawn = drawn.select("chunk", "share", "rep", F.lit(0).cast("long").alias("part"), F.lit(None).cast("array<double>").alias("values"), "at")
    placed = rows.select(F.call_function("div", F.col("idx"), F.lit(size)).alias("chunk"), F.call_function("div", F.col("idx"), F.lit(CHUNK_ROWS)).alias("part"), F.struct("idx", "v").alias("r"))
    packed = placed.groupBy("chunk", "part").agg(F.flatten(F.sort_array(F.collect_list("r")).getField("v")).alias("values"))  # ``CHUNK_ROWS`` at most
    packed = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    packed = packed.select("chunk", "share", F.lit(-1).cast("long").alias("rep"), "part", "values", F.lit(None).cast("binary").alias("at"))
    both = packed.unionByName(drawn).repartition(spread, "chunk", "share").sortWithinPartitions("chunk", "share", "rep", "part")  # rows come before their draws

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, v, sums = None, [], None, {}
        for f in frames:
            for chunk, share, rep, values, at in zip(f["chunk"], f["share"], f["rep"], f["values"], f["at"], strict=True):
                if (chunk, share) != now:
                    if sums:
                        yield pd.DataFrame({"rep": list(sums), "g": list(sums.values())})
                    now, parts, v, sums = (chunk, share), [], None, {}
                if rep < 0:
                    parts.append(np.asarray(values, float))
                    continue
                if v is None:
                    v, parts = np.concatenate(parts).reshape(-1, width), []
                sums[rep] = sums.get(rep, 0) + v[np.frombuffer(at, "<u4")].sum(axis=0)
        if sums:
            yield pd.DataFrame({"rep": list(sums), "g": list(sums.values())})

    found = both.mapInPandas(add, "rep long, g array<double>")
    return found.groupBy("rep").agg(F.array(*[F.sum(F.col("g")[i]) for i in range(width)]).alias("g"))


def slope_contrasts(replicates: DataFrame, observed: DataFrame) -> DataFrame:
    """RS-07: per pair of models the observed difference, its interval, a two-sided p and its BH q.

    ``replicates`` has rep, name and beta; ``observed`` has name and beta.
    """
    pair = lambda df, on: df.alias("a").join(df.alias("b"), on=[F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [F.col("a.name") < F.col("b.name")])
    diff = F.col("a.beta") - F.col("b.beta")
    drawn = pair(replicates, ["rep"]).select(F.col("a.name").alias("map_a"), F.col("b.name").alias("map_b"), diff.alias("d"))
    share = lambda c: (F.count_if(c) + 1) / (F.count("d") + 1)
    low, high = share(F.col("d") <= 0), share(F.col("d") >= 0)
    told = drawn.groupBy("map_a", "map_b").agg(
        F.percentile("d", F.lit(0.025)).alias("ci_low"), F.percentile("d", F.lit(0.975)).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"), F.count("d").alias("n_boot"),
    )
    named = observed.select("name", "beta")
    seen = named.alias("a").join(named.alias("b"), F.col("a.name") < F.col("b.name")).select(
        F.col("a.name").alias("map_a"), F.col("b.name").alias("map_b"), diff.alias("difference")
    )  # a handful of models
    return bh_adjust(told.join(seen, ["map_a", "map_b"]), "p")


#: Rows of a dataset, about, that share one random stream and one row of sums.
CHUNK_ROWS = 2048


def r2_bootstrap(paired: DataFrame, dataset: str, unit: str, y: str, models: list[str], replicates: int, seed: int, hierarchical: bool = False, by_row: bool = False) -> DataFrame:
    """RS-08, 09: (rep, dataset, times, r2_<model>): units drawn within datasets; datasets drawn first if ``hierarchical``.

    A hierarchical replicate has a row per dataset drawn, with its multiplicity ``times``; macro
    values are weighted means over them. Rows are dealt once into chunks of about ``CHUNK_ROWS`` by
    a hash of the unit; a replicate's draws are split over a dataset's chunks, drawn inside the
    chunk, and leave it as sums. With ``by_row`` every draw is a hash of its number instead. Rows
    with a null take no part.
    """
    values = F.array(F.col(y).cast("double"), *[F.col(m).cast("double") for m in models])
    rows = paired.select(dataset, unit, F.col(y).cast("double").alias("y"), *models).dropna()
    if by_row:
        return _hashed_r2(paired, rows, dataset, unit, models, replicates, seed, hierarchical)
    packed = paired.select(dataset, F.col(unit).alias("__u"), values.alias("__v")).where(F.col(dataset).isNotNull() & F.col("__u").isNotNull())
    packed = packed.where(F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x)))
    sizes = packed.groupBy(dataset).agg(F.count("*").alias("n"))
    reps = _replicates(paired, sizes, dataset, replicates, seed, hierarchical)
    count = F.ceil(F.col("n") / CHUNK_ROWS)
    placed = packed.join(sizes, dataset).select(dataset, F.pmod(F.xxhash64(F.lit("chunk"), "__u"), count).alias("chunk"), "__u", "__v")
    held = placed.groupBy(dataset, "chunk").agg(F.sort_array(F.collect_list(F.struct("__u", "__v"))).alias("__r"))  # about ``CHUNK_ROWS``
    chunks = stable(held.select(dataset, "chunk", F.size("__r").cast("long").alias("size"), F.flatten("__r.__v").alias("values")))
    asked = drawn_chunks(chunks, [dataset], reps, seed, True).withColumn("__g", F.xxhash64(dataset, "chunk"))
    width = 1 + len(models)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rep, name, g, n, size, values in zip(f["rep"], f[dataset], f["__g"], f["n"], f["size"], f["values"], strict=True):
                v = np.asarray(values, dtype=float).reshape(size, width)
                m = np.bincount(stream(seed, rep, g, 1).integers(0, size, int(n)), minlength=size)
                out.append((rep, name, n, m @ v[:, 0], m @ v[:, 0] ** 2, *(m @ (v[:, :1] - v[:, 1:]) ** 2)))
            names = ["rep", dataset, "n", "s", "ss", *[f"e{i}" for i in range(len(models))]]
            yield pd.DataFrame(out, columns=names).groupby(["rep", dataset], as_index=False).sum()

    kinds = ", ".join(["rep long", f"`{dataset}` {paired.schema[dataset].dataType.simpleString()}", "n long", "s double", "ss double", *[f"e{i} double" for i in range(len(models))]])
    total = F.sum("ss") - F.sum("s") ** 2 / F.sum("n")
    found = asked.select("rep", dataset, "__g", "n", "size", "values").mapInPandas(sums, kinds).groupBy("rep", dataset).agg(
        *[(1 - F.try_divide(F.sum(f"e{i}"), total)).alias(f"r2_{m}") for i, m in enumerate(models)]
    )
    return reps.select("rep", dataset, "times").join(stable(found), ["rep", dataset])  # many models make long plans


def _replicates(paired: DataFrame, sizes: DataFrame, dataset: str, replicates: int, seed: int, hierarchical: bool) -> DataFrame:
    """(rep, dataset, n, times): which datasets are in which replicate."""
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))))
    if not hierarchical:
        return reps.withColumn("times", F.lit(1).cast("long"))
    named = numbered(sizes.select(dataset), [dataset], "d")
    drawn = multiplicities(paired.sparkSession, named.count(), replicates, seed + 1).withColumnRenamed("idx", "d").withColumnRenamed("m", "times")
    return reps.join(named, dataset).join(drawn, ["rep", "d"]).drop("d")


#: Numbers of one dataset that a task holds to draw from, and tasks that share a dataset's replicates at most.
MOST_HELD, MOST_SHARES = 1 << 22, 8


def _hashed_r2(paired: DataFrame, rows: DataFrame, dataset: str, unit: str, models: list[str], replicates: int, seed: int, hierarchical: bool) -> DataFrame:
    """A hash per draw, made and added up inside tasks that hold a dataset; for datasets of more than ``MOST_HELD``
    numbers, draws are made in runs of ``RUN``, which are dealt to all tasks, and joined to the rows."""
    rows = numbered(rows, [unit], group=[dataset])
    sizes = stable(rows.groupBy(dataset).agg(F.count("*").alias("n")))
    reps = _replicates(paired, sizes, dataset, replicates, seed, hierarchical)
    fits = F.col("n") * (1 + len(models)) <= MOST_HELD
    large = sizes.where(~fits).select(dataset)
    some = not large.isEmpty()
    held = _held_r2(rows.join(large, dataset, "left_anti") if some else rows, sizes.count(), dataset, models, replicates, seed)
    out = reps.select("rep", dataset, "times").join(stable(held), ["rep", dataset])
    return out.unionByName(_joined_r2(rows, reps.where(~fits), dataset, models, seed)) if some else out


def _held_r2(rows: DataFrame, datasets: int, dataset: str, models: list[str], replicates: int, seed: int) -> DataFrame:
    """(rep, dataset, r2_<model>...): tasks hold the numbered rows of a dataset for a share of the replicates."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = -(-replicates // max(1, min(MOST_SHARES, replicates, spread // max(datasets, 1))))
    values = F.array("y", *[F.col(m).cast("double") for m in models])
    packed = rows.select(dataset, F.col(dataset).cast("string").alias("__t"), F.call_function("div", F.col("idx"), F.lit(CHUNK_ROWS)).alias("__c"), F.struct("idx", values.alias("v")).alias("__v"))
    packed = packed.groupBy(dataset, "__t", "__c").agg(F.flatten(F.sort_array(F.collect_list("__v")).getField("v")).alias("values"))  # ``CHUNK_ROWS`` at most
    shares = packed.withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(share))))
    placed = shares.repartition(spread, dataset, "__first").sortWithinPartitions(dataset, "__first", "__c")

    def r2(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def drawn(name, text: str, first: int, parts: list[np.ndarray]) -> pd.DataFrame:
            v = np.concatenate(parts).reshape(-1, 1 + len(models))
            n, y = len(v), v[:, :1]
            terms = np.hstack([y, y**2, (y - v[:, 1:]) ** 2])
            mine = range(first, min(first + share, replicates))
            sums = np.zeros((len(mine), terms.shape[1]))
            heads = [f"{seed}|{text}|{rep}|".encode() for rep in mine]
            for i in range(0, n, BATCH):
                for s, d in zip(sums, text_draws(heads, [b"%d" % j for j in range(i, min(i + BATCH, n))]), strict=True):
                    s += terms[d % n].sum(axis=0)
            total = sums[:, 1] - sums[:, 0] ** 2 / n
            out = {"rep": mine, dataset: [name] * len(mine)}
            for k, m in enumerate(models):
                out[f"r2_{m}"] = [1 - e / t if t else None for e, t in zip(sums[:, 2 + k], total, strict=True)]
            return pd.DataFrame(out)

        now, held = None, []
        for f in frames:
            for name, text, first, values in zip(f[dataset], f["__t"], f["__first"], f["values"], strict=True):
                if now is not None and now[1:] != (text, first):
                    yield drawn(*now, held)
                    held = []
                now = name, text, first
                held.append(np.asarray(values, float))
        if now is not None:
            yield drawn(*now, held)

    kinds = ", ".join(["rep long", f"`{dataset}` {rows.schema[dataset].dataType.simpleString()}", *[f"`r2_{m}` double" for m in models]])
    return placed.mapInPandas(r2, kinds)


def _joined_r2(rows: DataFrame, reps: DataFrame, dataset: str, models: list[str], seed: int) -> DataFrame:
    """(rep, dataset, times, r2_<model>...) by draws that are joined to their rows."""
    runs = reps.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(spread, "rep", dataset, "first")
    draws = runs.withColumn("i", F.explode(F.sequence("first", F.least(F.col("first") + RUN, F.col("n")) - 1)))
    picks = draws.groupBy("rep", dataset, "times", (draw(seed, dataset, "rep", "i") % F.col("n")).alias("idx")).agg(F.count("*").alias("m"))
    m = F.col("m")
    total = F.sum(m * F.col("y") ** 2) - F.sum(m * F.col("y")) ** 2 / F.sum(m)
    # Spark takes exploded rows for as few as there were before, and would broadcast them.
    return picks.hint("merge").join(rows, [dataset, "idx"]).groupBy("rep", dataset, "times").agg(
        *[(1 - F.try_divide(F.sum(m * (F.col("y") - F.col(c)) ** 2), total)).alias(f"r2_{c}") for c in models]
    )
