"""Queries of models, resampling, decision rules, the scorer and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits, gates, loci, portability, ranks, regression, ridge, stats
from .ingested import _SOURCE, _normalised
from .mapping import TECHNOLOGIES, calls, lines, table, union
from .more import _MOTIFS, _motifs
from .queries import (
    _AUC, _DRAW, _EFFECTS, _FUNCTIONAL, _I2, _MAPPING, _META, _OBSERVED, _RANKED, FEATURE_SETS, FIT, REPLICATES, _dense, _effects, _functional, _tasks, query, sql_bh, sql_saturated,
)

CELLS = "multi::int + 2 * (cell = 'O')::int"
INTERACTION = {"intercept": [1, 0, 0, 0], "multi": [-1, 1, 0, 0], "cell_o": [-1, 0, 1, 0], "multi_x_cell_o": [1, -1, -1, 1]}
_POOLED = sql_saturated("(select y, motif as g, cell, breadth >= 2 as multi from u)", CELLS, INTERACTION, 4)


def _pooled(spark, sf):
    rows = union(spark, sf).withColumn("multi", (F.col("breadth") >= 2).cast("int"))
    rows = regression.with_interaction(rows, "multi", "cell", "O", "cell_o")
    return regression.logistic_cluster(rows, "y", ["multi", "cell_o", "multi_x_cell_o"], "motif")


@query(f"with {_POOLED} select * from ft", FIT)
def pooled_interaction(spark, sf):
    """ST-13: pooled logistic model with the interaction of evidence and cell."""
    return _pooled(spark, sf).table(spark)


_CONTRAST = sql_saturated("(select y, motif as g, cell, breadth >= 2 as multi from u)", CELLS, {"multi_minus_cell_o": [0, 1, -1, 0]}, 4)


@query(f"""with {_CONTRAST} select term as contrast, beta as beta_difference, se, z, p, odds_ratio as ratio, ci_low, ci_high from ft""",
       "beta_difference se z p ratio ci_low ci_high")
def coefficient_contrast(spark, sf):
    """ST-14: the difference of two coefficients from their covariance."""
    row = _pooled(spark, sf).contrast("multi", "cell_o")
    kinds = ", ".join(f"{k} {'string' if k == 'contrast' else 'double'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], kinds)


#: Declared labels of a locus: the datasets of its small lines (four of the five).
LABELS = ["0", "1", "2", "3"]
_LABELLED = """lx as (select gene, motif, coalesce(list(distinct dataset::varchar) filter (where l_quantity <= 10), []) as labels, max((tech = 'A' and l_tax < .02)::int) as f, max((tech = 'R' and l_tax < .02)::int) as s from ln where cell = 'F' group by 1, 2)"""


def _labelled(spark, sf):
    rows = lines(spark, sf).where("cell = 'F'").groupBy("gene", "motif")
    flag = lambda t: F.max(((F.col("tech") == t) & (F.col("l_tax") < 0.02)).cast("int"))
    return rows.agg(F.sort_array(F.collect_set(F.when(F.col("l_quantity") <= 10, F.col("dataset").cast("string")))).alias("labels"), flag("A").alias("f"), flag("R").alias("s"))


_ROW = "beta double, se double, z double, p double, odds_ratio double, ci_low double, ci_high double, n long, n_clusters long, q double"


def _label_query(name: str, keep: str, label: str) -> str:
    """One label's row as a subquery of its own."""
    fit = sql_saturated(f"(select list_contains(labels, '{label}')::int as y, motif as g, f from lx where {keep})", "f", {"f": [-1, 1]}, 2)
    cases = f"(select count(*) from lx where {keep} and list_contains(labels, '{label}'))"
    return f"(with {fit} select '{name}' as scope, '{label}' as label, {cases} as cases, * from ft)"


def _labels_sql(scopes: dict[str, str], least: int) -> str:
    rows = " union all ".join(f"select * from {_label_query(s, keep, v)} where cases >= {least}" for s, keep in scopes.items() for v in LABELS)
    return f"with {_LABELLED}, al as ({rows}) " + sql_bh("al", "scope")


@query(f"with {_LABELLED} select * exclude (scope) from ({_labels_sql({'all': 'true'}, 20).replace(f'with {_LABELLED},', 'with')})", FIT + " q")
def label_models(spark, sf):
    """ST-15: the effect of one technology in a model per declared label, with q across labels."""
    got = regression.label_models(_labelled(spark, sf), "labels", LABELS, ["f"], "motif", "f")
    return spark.createDataFrame([tuple(r.values()) for r in got], f"label string, cases long, term string, {_ROW}")


@query(_labels_sql({"all": "len(labels) = 1", "without_r": "len(labels) = 1 and s = 0"}, 10), FIT + " q")
def single_label_models(spark, sf):
    """ST-28: which label a row has, among rows with exactly one, in two scopes."""
    got = regression.single_label_models(
        _labelled(spark, sf), "labels", LABELS, {"all": (F.lit(True), ["f"]), "without_r": (F.col("s") == 0, ["f"])}, "motif", "f"
    )
    return spark.createDataFrame([tuple(r.values()) for r in got], f"scope string, label string, cases long, term string, {_ROW}")


_GUARD = """g as (select breadth, count(*) as n, sum(y)::bigint as positives from u where score >= 10 group by 1),
 r as (select *, n >= 100 and positives between 1 and n - 1 as enough from g)"""


@query(f"""with {_GUARD} select breadth, n, positives, case when enough then ln(positives / (n - positives)) end as log_odds, case when enough then 'RUN'
    else 'NOT_RUN' end as status from r""", "log_odds")
def guarded_sensitivity(spark, sf):
    """ST-29: a sensitivity analysis by breadth that is only run with enough rows and both classes."""
    rows = union(spark, sf).where("score >= 10").groupBy("breadth").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    odds = rows.withColumn("log_odds", F.log(F.try_divide(F.col("positives"), F.col("n") - F.col("positives"))))
    return stats.guarded(odds, (F.col("n") >= 100) & F.col("positives").between(1, F.col("n") - 1), ["log_odds"])


_FIXED_P = f"""with {_FUNCTIONAL}, s as (
  select dataset, count(*) as n, sum(z) as y, sum(z * z) as yy, sum(burden) as x, sum(burden * burden) as xx, sum(burden * z) as xy, sum(len) as l,
    sum(len * len) as ll, sum(len * z) as ly from fx where z is not null group by 1),
 r as (select dataset, (xy - x * y / n) ** 2 / ((xx - x * x / n) * (yy - y * y / n)) as a, (ly - l * y / n) ** 2 / ((ll - l * l / n) * (yy - y * y / n)) as b from s)"""


@query(f"{_FIXED_P} select dataset, b - a as size_minus_burden from r", "size_minus_burden")
def r2_increments(spark, sf):
    """ST-24: R-squared of one model less that of another, by dataset."""
    rows = _functional(spark, sf)
    one = lambda x, name: rows.groupBy("dataset").agg((F.corr(x, "z") ** 2).alias("r2")).withColumn("model", F.lit(name))
    both = one(F.col("burden").cast("double"), "burden").unionByName(one(F.col("len").cast("double"), "size"))
    return stats.r2_increments(both, ["dataset"], "model", "r2", [("burden", "size")])


@query(_MAPPING.replace("{seed}", "18") + _OBSERVED + f""", f2 as (select * from u where cell = 'O'), sc as (select motif, s from o),
 cl as (select motif, row_number() over (order by motif) - 1 as idx from (select distinct motif from f2)), cg as (select count(*) as k from cl),
 bd as (select rep, {_DRAW.format(parts="'17', rep, i")} % cg.k as idx, count(*) as w from range({REPLICATES}) a(rep), cg, (select unnest(range(k)) as i from cg) group by 1, 2),
 bh as (select rep, s, sum(w * p) as p, sum(w * q) as q from bd join cl using (idx) join o using (motif) group by 1, 2), br as (select *, sum(q) over (partition by rep order by s) as cq from bh),
 ba as (select sum(p * (cq - q / 2.0)) / nullif(sum(p)::double * sum(q), 0) as auroc from br group by rep)
 select 'F' as train, 'O' as test, (select count(*) from u where cell = 'F') as n_train, seen.n::bigint as n, seen.n_pos::bigint as n_pos,
  (select count(*) from f2 where motif not in (select motif from u where cell = 'F')) as n_unseen, seen.auroc, (select quantile_cont(auroc, .025)
    from ba) as ci_low, (select quantile_cont(auroc, .975) from ba) as ci_high,
  (select (count_if(m.auroc >= seen.auroc) + 1) / (count(*) + 1) from m) as p_upper from seen""", "auroc ci_low ci_high p_upper")
def transfer_test(spark, sf):
    """ST-06: the transfer between cells with its interval and permutation p."""
    return stats.transfer_test(union(spark, sf), "cell", "F", "O", "motif", "y", REPLICATES, 17)


@query("""with c as (select motif, count(*) as w, avg(score) as x, ln((sum(y) + .5) / (count(*) - sum(y) + .5)) as v from u where cell = 'F' group by 1),
 s as (select sum(w) as sw, sum(w * x) as sx, sum(w * v) as sv, sum(w * x * x) as sxx, sum(w * x * v) as sxv from c),
 l as (select (sxv - sx * sv / sw) / (sxx - sx * sx / sw) as b, (sv - (sxv - sx * sv / sw) / (sxx - sx * sx / sw) * sx) / sw as a from s)
 select motif, w, x, v, a + b * x as component, v - a - b * x as residual from c, l""", "x v component residual")
def decomposed_scores(spark, sf):
    """ST-08: the part of a motif's log odds that a weighted line explains, and the rest."""
    odds = F.log((F.sum("y") + 0.5) / (F.count("*") - F.sum("y") + 0.5))
    c = union(spark, sf).where("cell = 'F'").groupBy("motif").agg(F.count("*").alias("w"), F.avg("score").alias("x"), odds.alias("v"))
    return stats.decomposed(c, "x", "v", "w")


@query("""with p as (select distinct l_orderkey * 10 + l_linenumber as k, l_partkey * 10 % 7000 as pos, l_suppkey % 3 as chrom from lineitem),
 f as (select distinct l_suppkey % 3 as chrom, l_partkey * 10 % 7000 as s, l_partkey * 10 % 7000 + 12 as e, 'g' || (l_partkey % 40) as gene, 't' || (l_partkey % 80) as tx,
  case l_partkey % 4 when 0 then 'CDS' when 1 then '5UTR' when 2 then '3UTR' else 'EXON_OTHER' end as region from lineitem),
 h as (select k, list_sort(list(distinct gene)) as g, list_sort(list(distinct tx)) as t, list_sort(list(distinct region)) as r from p join f on p.chrom = f.chrom and pos between s and e group by 1)
 select p.k, coalesce(len(g), 0)::int as n_genes, array_to_string(g, '|') as genes, case when len(g) = 1 then g[1] end as unique_gene, case
    when g is null then 'no_exon' when len(g) = 1 then 'unique_gene' else 'multi_gene_ambiguous' end as gene_status,
  array_to_string(t, '|') as transcripts, array_to_string(r, '|') as regions, case when r is null then 'UNANNOTATED' when list_contains(r, 'CDS') then 'CDS'
    when list_contains(r, '5UTR') and not list_contains(r, '3UTR') then '5UTR'
  when list_contains(r, '3UTR') and not list_contains(r, '5UTR') then '3UTR' when list_contains(r, 'EXON_OTHER') then 'EXON_OTHER'
    else 'MULTI' end as primary_region from p left join h on p.k = h.k""", mapped=False)
def region_annotation(spark, sf):
    """JN-11: genes, transcripts, regions and the primary region of points."""
    n, p = F.col("l_suppkey") % 3, F.col("l_partkey")
    rows = table(spark, sf, "lineitem")
    points = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (p * 10 % 7000).alias("pos"), n.alias("chrom")).distinct()
    region = F.when(p % 4 == 0, "CDS").when(p % 4 == 1, "5UTR").when(p % 4 == 2, "3UTR").otherwise("EXON_OTHER")
    name = lambda x, m: F.concat(F.lit(x), (p % m).cast("string"))
    exons = rows.select(
        n.alias("chrom"), (p * 10 % 7000).alias("start"), (p * 10 % 7000 + 12).alias("end"), name("g", 40).alias("gene"), name("t", 80).alias("tx"), region.alias("region")
    ).distinct()
    return loci.annotate(points, exons, "k", ["chrom"], "pos", "start", "end", "gene", 32, "tx", "region").drop("pos", "chrom")


@query("""with s as (select motif, avg(y) as r from u group by 1) select motif, r, row_number() over (order by r desc, motif) as rank from s""", "r")
def ordered_results(spark, sf):
    """WIN-11: a result table in its deterministic order."""
    r = union(spark, sf).groupBy("motif").agg(F.avg("y").alias("r"))
    ranked = ranks.running(r.withColumn("one", F.lit(1).cast("long")), [], [F.desc("r"), F.col("motif")], ["one"])
    return ranked.select("motif", "r", F.col("cum_one").alias("rank"))


@query()
def tuned_ranker(spark, sf):
    """ML-04: mean macro AUROC of each C on grouped folds of the tasks, and which one is chosen."""
    tasks = _tasks(spark, sf)
    best, rows = portability.tune(tasks, FEATURE_SETS["provenance"], "target_reported", "locus", "target")
    return spark.createDataFrame([(r["C"], r["macro_auroc"], r["folds"], r["C"] == best) for r in rows], "c double, macro_auroc double, folds long, chosen boolean")


@query()
def ranker_coefficients(spark, sf):
    """ML-06: coefficient table of the full ranker."""
    model = portability.fit_ranker(_tasks(spark, sf), FEATURE_SETS["full"], "target_reported", "locus", 0.1)
    return spark.createDataFrame([tuple(r.values()) for r in model], "feature string, coefficient double, mean double, scale double")


_MEASURES = """mm as (
  select motif, count(*) as n, count_if(y = 1)::bigint as n_pos, avg(y) + .4 as a, avg(y) + .3 as low, avg(y) * 6 as l10, avg(y) * 5 as l20, .7 + avg(y) as above, .02 * (count(*) % 3) as gain, .79 + .01 * (count(*) % 3) as share from u group by 1),
 mu as (select *, a >= .58 and low > .5 and l10 >= 1.15 as f, a - .02 >= .58 and low - .02 > .5 and l10 - .1 >= 1.15 as s, gain >= .02 and share >= .8 as g from mm)"""


@query(f"""with {_MEASURES} select motif, case when f and g then 'READY_FOR_LOCKBOX' when f then 'USEFUL_WITH_MODEST_GAIN' when s then 'SIMPLE_MODEL_ONLY' else 'NO_USEFUL_RANKING' end as status,
 case when f and g then 'full' when f then 'full_qualified' when s then 'simple' else 'none' end as selected,
 case when n_pos < 10 then 'INCONCLUSIVE_LOW_POWER' when n_pos >= 15 and a >= .6 and low > .5 and l20 >= 1.2 then 'EXTERNALLY_VALIDATED'
    when a >= .55 and above >= .9 and (l10 >= 1.15 or l20 >= 1.15) then 'EXTERNALLY_SUPPORTED' else 'NOT_CONFIRMED' end as verdict from mu""")
def decision_rules(spark, sf):
    """ML-10: the development choice and the lockbox verdict, over a table of measures."""
    y = F.avg("y")
    m = union(spark, sf).groupBy("motif").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"), (y + 0.4).alias("a"), (y + 0.3).alias("low"), (y * 6).alias("l10"), (y * 5).alias("l20"), (y + 0.7).alias("above"),
        (F.count("*") % 3 * 0.02).alias("gain"), (F.count("*") % 3 * 0.01 + 0.79).alias("share"),
    )
    c = F.col
    both = lambda x, less: {"full": c(x), "simple": c(x) - less}
    choice = portability.development_choice(both("a", 0.02), both("low", 0.02), both("l10", 0.1), c("gain"), c("share"))
    return m.select("motif", *choice, portability.lockbox_verdict(c("n_pos"), c("a"), c("low"), c("above"), c("l10"), c("l20")).alias("verdict"))


def _repeated(spark, sf, repeats=3):
    rows, features = _dense(spark, sf)
    return ridge.repeated_folds(rows.drop("fold"), "vec_id", 5, repeats, 41), features


@query("""with d as (select vec_id, repeat, ('0x' || substr(md5(concat_ws('|', '41', repeat, vec_id)), 1, 12))::bigint as d from embeddings, range(3) r(repeat))
 select vec_id, repeat::int as repeat, ((row_number() over (partition by repeat order by d, vec_id) - 1) % 5)::int as fold from d""", mapped=False)
def repeated_folds(spark, sf):
    """ML-03, 12: balanced folds, dealt anew in each repeat."""
    return _repeated(spark, sf)[0].select("vec_id", "repeat", "fold")


@query()
def repeated_nested_ridge(spark, sf):
    """ML-13, 14, 15, AGG-16: nested ridge over repeated folds; fit of the predictions averaged over repeats."""
    rows, features = _repeated(spark, sf)
    models = ridge.require_resolved(ridge.nested_ridge(rows, ["ds", "repeat"], "fold", features, "y"))
    predicted = ridge.out_of_fold(rows, models, ["ds", "repeat"], "fold", features)
    return stats.fit_scores(loci.average_repeats(predicted, ["ds", "vec_id"], "y", "prediction"), ["ds"], "y", "prediction")


#: A frozen ranker of three features (ML-18).
SCORER = [
    {"feature": "source_breadth", "coefficient": 0.36, "mean": 1.08, "scale": 0.27}, {"feature": "fp", "coefficient": 0.24, "mean": 0.12, "scale": 1.64},
    {"feature": "motif_+1_G", "coefficient": -0.2, "mean": 0.4, "scale": 0.49}, {"feature": "(intercept)", "coefficient": -2.1, "mean": 0.0, "scale": 1.0},
]

_SITES = f"""{_MOTIFS}, si as (select distinct id, motif, case strand when '+' then 'A' when '-' then 'N' else 'R' end as pattern from m),
 fp as (select motif, round(avg(pos) / 10 - .5, 6) as lr from m where substr(motif, 1, 1) <> 'A' group by 1),
 rf as (select -3.0 + (l_partkey % 60) / 20.0 as score, l_returnflag as pattern from lineitem where l_returnflag <> 'R' or l_partkey % 50 = 0),
 sc as (select id, si.motif, pattern, coalesce(lr, 0.0) as fp, substr(si.motif, 2, 1) <> 'U' and substr(si.motif, 4, 1) <> 'U' as dom from si left join fp on si.motif = fp.motif),
 sd as (select *, case when dom then round(-2.1 + (1 - 1.08) / .27 * .36 + (fp - .12) / 1.64 * .24 + ((substr(motif, 4, 1) = 'G')::int - .4) / .49 * -.2, 9) end as score from sc),
 rh as (select pattern, score, count(*) as n from rf group by 1, 2), ds as (select distinct score from sd where score is not null)"""


def _scored(spark, sf):
    m = _motifs(spark, sf)
    assay = F.when(F.col("strand") == "+", "A").when(F.col("strand") == "-", "N").otherwise("R")
    sites = m.select("id", "motif", assay.alias("source_assay")).distinct()
    prints = m.where(F.substring("motif", 1, 1) != "A").groupBy("motif").agg(F.round(F.avg("pos") / 10 - 0.5, 6).alias("log_ratio"))
    rows = table(spark, sf, "lineitem").where("l_returnflag <> 'R' or l_partkey % 50 = 0")
    reference = rows.select((-3.0 + F.col("l_partkey") % 60 / 20.0).alias("score"), F.col("l_returnflag").alias("source_pattern"), F.lit(1).alias("source_breadth"))
    return portability.score_sites(sites, SCORER, prints, reference, TECHNOLOGIES, ("A", "N"))


@query(f"""with {_SITES}, pp as (
  select pattern, d.score, sum(case when rh.score < d.score - 1e-9 then n else 0 end) / sum(n)::double as p, sum(n) as np from ds d, rh group by 1, 2),
 pa as (select d.score, sum(case when rh.score < d.score - 1e-9 then n else 0 end) / sum(n)::double as p from ds d, rh group by 1),
 x as (
  select sd.id, sd.motif, sd.pattern as source_pattern, sd.score, case when np >= 20 then pp.p end as pattern_percentile, pa.p as breadth_percentile, case
    when sd.score is not null then case when np >= 20 then 'same_source_pattern' else 'same_source_breadth' end end as reference_used,
   case when sd.score is not null then (rank() over (partition by sd.pattern order by sd.score nulls last) + (count(*) over (partition by sd.pattern, sd.score) - 1) / 2.0) / count(sd.score) over (partition by sd.pattern) end as within_input_percentile
  from sd left join pp on sd.pattern = pp.pattern and sd.score = pp.score left join pa on sd.score = pa.score)
 select *, coalesce(pattern_percentile, breadth_percentile) as reference_percentile, case when score is null then 'out_of_validated_domain' else 'single_source_ranked' end as evidence_layer,
  case when coalesce(pattern_percentile, breadth_percentile) >= .9 then 'high_validation_priority' when coalesce(pattern_percentile, breadth_percentile) >= .75 then 'elevated_validation_priority'
   when coalesce(pattern_percentile, breadth_percentile) >= .25 then 'intermediate_validation_priority' when
    coalesce(pattern_percentile, breadth_percentile) is not null then 'lower_validation_priority' end as priority from x""",
       "score pattern_percentile breadth_percentile within_input_percentile reference_percentile", mapped=False)
def scored_sites(spark, sf):
    """ML-18: sites scored by a frozen ranker, with percentiles and labels."""
    return _scored(spark, sf).select(
        "id", "motif", "source_pattern", "score", "pattern_percentile", "breadth_percentile", "reference_used", "within_input_percentile", "reference_percentile", "evidence_layer", "priority"
    )


@query(f"""with {_SOURCE}, r as (select avg((motif is not null)::int) as k, avg((source_end - source_start = 1)::int) as o, avg((motif[3] = 'U')::int) as c from nc)
 select 'calls' as dataset, 'centre_u' as check_id, case when c >= 1 then 'PASS' else 'FAIL' end as status from r union all select 'calls', 'one_base', case
    when o >= .9 then 'PASS' else 'WARN' end from r
 union all select 'calls', 'motif_known', case when k >= .95 then 'PASS' else 'REVIEW' end from r""", mapped=False)
def source_gates(spark, sf):
    """QC-01, 03, 04: middle letters, one-base intervals and coverage of a source; misses that only warn or ask for review."""
    return gates.checks(spark, _normalised(spark, sf), "calls", {
        "centre_u": (gates.centre_u("motif"), ">=", 1.0), "one_base": (gates.one_base("source_start", "source_end"), ">=", 0.9, "WARN"),
        "motif_known": (F.avg(F.col("motif").isNotNull().cast("double")), ">=", 0.95, "REVIEW"),
    }).select("dataset", "check_id", "status")


@query("""with m as (select motif, avg(l_extendedprice) filter (where slot % 2 = 0) as a, avg(l_extendedprice) filter (where slot % 2 = 1) as b from ln group by 1),
 k as (select * from m where a is not null and b is not null),
 r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from k)
 select count(*) as n, corr(ra, rb) as spearman, case when corr(ra, rb) >= .85 then 'PASS' else 'FAIL' end as status from r""", "spearman")
def replicate_gate(spark, sf):
    """QC-05: rank correlation of a motif's level in the lines of even and of odd slots against its least value."""
    half = lambda i: F.avg(F.when(F.col("slot") % 2 == i, F.col("l_extendedprice")))
    return gates.replicates_agree(lines(spark, sf).groupBy("motif").agg(half(0).alias("a"), half(1).alias("b")), "a", "b")


@query("""with e as (select tech, count(*) + (tech = 'R')::int as expected_n from calls group by 1), o as (select tech, count(*) as observed_n from calls group by 1)
 select tech, observed_n, expected_n, case when observed_n = expected_n then 'PASS' else 'FAIL' end as status from o join e using (tech) union all select 'X', null, 5, 'FAIL'""")
def expected_counts(spark, sf):
    """QC-02, 06: counts against a frozen table of them; one differs and one is missing."""
    c = calls(spark, sf)
    expected = c.groupBy("tech").agg((F.count("*") + F.max((F.col("tech") == "R").cast("long"))).alias("expected_n"))
    expected = expected.unionByName(spark.createDataFrame([("X", 5)], "tech string, expected_n long"))
    return gates.expected_counts(c, "tech", expected)


@query(f"""with a as (select motif, count(*) as n, sum(y) as k from u
    group by 1), r as (select cell, y, {_RANKED.format(g='cell').replace('order by s', 'order by score').replace(', s)', ', score)')} from u),
 s as (select cell, {_AUC} as auroc from r group by 1) select cell, auroc, abs(auroc - .5) <= .035 as reproduced from s""", "auroc")
def frozen_auroc(spark, sf):
    """QC-06: whether the AUROC of each cell is within the tolerance of its frozen value."""
    found = stats.auroc(union(spark, sf), "score", "y", ["cell"]).select("cell", "auroc").collect()  # two cells
    return spark.createDataFrame([(r["cell"], r["auroc"], gates.reproduced(r["auroc"], 0.5)) for r in found], "cell string, auroc double, reproduced boolean")


@query("""with g as (select cell, breadth, count(*) as n, sum(y)::double as k from u group by 1, 2),
 r as (select cell, breadth, k / n as rate, (k / n + 1.959963984540054 ** 2 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ** 2 / n) as low from g),
 l as (select *, rate >= lag(rate) over (partition by cell order by breadth) as rises from r)
 select cell, min(sign(rate - .5)) = max(sign(rate - .5)) as direction_consistent, bool_and(low > .5) as interval_above_half, bool_and(coalesce(rises, true)) as monotone from l group by 1""")
def direction_flags(spark, sf):
    """QC-08: direction, intervals and monotone rates over the breadth of evidence."""
    rates = loci.rate_table(union(spark, sf), ["cell", "breadth"], "y")
    return gates.direction_flags(rates, "breadth", "rate", "ci_low", ["cell"])


@query("""with need(label, col) as (values ('calls', 'l_orderkey'), ('calls', 'l_tax'), ('orders', 'o_orderkey'), ('orders', 'l_tax')),
 have as (select 'calls' as label, column_name as col from (describe lineitem) union all select 'orders', column_name from (describe orders)),
 miss as (select label, string_agg(need.col, ',' order by need.col) filter (where have.col is null) as missing from need left join have using (label, col) group by 1),
 n as (select 'calls' as label, count(*) as n from lineitem where l_orderkey is not null and l_tax is not null union all select 'orders', count(*) from orders where o_orderkey is not null)
 select label, case when missing is null then 'READY' else 'MISSING' end as status, missing, n from miss join n using (label)""", mapped=False)
def required_columns(spark, sf):
    """QC-09: inputs checked for the columns that a stage needs, with the rows that have all those there are."""
    out = None
    for label, name, wanted in (("calls", "lineitem", ["l_orderkey", "l_tax"]), ("orders", "orders", ["o_orderkey", "l_tax"])):
        df = table(spark, sf, name)
        try:
            gates.require_columns(df, wanted, label)
            missing = None
        except gates.GateError:
            missing = ",".join(c for c in wanted if c not in df.columns)
        known = df.dropna(subset=[c for c in wanted if c in df.columns]).agg(F.count("*").alias("n"))
        part = known.select(F.lit(label).alias("label"), F.lit("MISSING" if missing else "READY").alias("status"), F.lit(missing).cast("string").alias("missing"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""with k as (select c_mktsegment || (c_nationkey % 2) as name, count(distinct md5((c_nationkey // 24)::varchar)) as n from customer group by 1)
 select case when bool_and(n = 1) then 'READY' else 'BLOCKED' end as stage, count_if(n = 1)::bigint as frozen, count_if(n > 1)::bigint as conflicts from k""", mapped=False)
def frozen_status(spark, sf):
    """QC-10: a stage that starts only if every reference of the earlier one is frozen."""
    from .more import reference_freeze

    contract = reference_freeze(spark, sf)
    try:
        gates.require_frozen(contract)
        stage = "READY"
    except gates.GateError:
        stage = "BLOCKED"
    return contract.agg(F.lit(stage).alias("stage"), F.count_if(F.col("status") == "FROZEN").alias("frozen"), F.count_if(F.col("status") != "FROZEN").alias("conflicts"))


@query("""with e as (select motif, cell, avg(y) - .19 as d from u group by 1, 2), f as (select motif, min(d) as low, max(d) as high, count(*) as k from e group by 1)
 select motif, 100 * abs(high - low) as i2, 100 * abs(high - low) >= 50 as high_i2, least(1.0, abs(low)) as q, least(1.0, abs(low)) < .05 as interaction_significant from f""", "i2 q")
def heterogeneity_flags(spark, sf):
    """ST-22: flags of heterogeneity over a table of effects."""
    e = union(spark, sf).groupBy("motif", "cell").agg((F.avg("y") - 0.19).alias("d"))
    f = e.groupBy("motif").agg((100 * F.abs(F.max("d") - F.min("d"))).alias("i2"), F.least(F.lit(1.0), F.abs(F.min("d"))).alias("q"))
    return regression.heterogeneity_flags(f, "q")


@query(f"""with {_EFFECTS}, m1 as (select o.dataset as omitted, {_META} from ef join (select dataset from ef) o on ef.dataset <> o.dataset group by 1), m2 as (select *, {_I2} from m1)
 select *, i2 >= 50 as high_i2 from m2""", "fixed_beta fixed_se q i2")
def meta_flags(spark, sf):
    """ST-22: heterogeneity of the datasets' effects, with each left out in turn."""
    meta = regression.fixed_effect(ranks.leave_one_out(_effects(spark, sf), "dataset"), ["omitted"], "beta", "se")
    return regression.heterogeneity_flags(meta)


def _top(f: float) -> str:
    inside = f"filter (where cn - n < greatest(ceil({f} * tn), 1))"
    precision = f"sum(pos) {inside} / sum(n) {inside}"
    return f"{precision} as precision_{f * 100:.0f}, {precision} / (max(tp) / max(tn)) as lift_{f * 100:.0f}"


def _budget(k: int) -> str:
    expected = f"sum(least(n, least({k}, tn) - (cn - n)) * pos / n) filter (where cn - n < least({k}, tn))"
    return f"{expected} as expected_{k}, {expected} / max(least({k}, tn)) / (max(tp) / max(tn)) as expected_lift_{k}"


_NAMES = ["prevalence", "auroc", "average_precision", "precision_10", "lift_10", "precision_20", "lift_20", *[f"expected_{x}{k}" for k in (50, 100, 200) for x in ("", "lift_")]]


@query(f"""with h as (select cell, score, count(*) as n, sum(y) as pos from u group by 1, 2),
 c as (
  select *, sum(n) over w as cn, sum(pos) over w as cp, sum(n) over (partition by cell) as tn, sum(pos) over (partition by cell) as tp
  from h window w as (partition by cell order by score desc))
 select cell, sum(n)::bigint as n, sum(pos)::bigint as n_pos, max(tp) / max(tn) as prevalence,
  sum(pos * (tn - tp - (cn - cp) + (n - pos) / 2.0)) / nullif(sum(pos)::double * sum(n - pos), 0) as auroc, sum(pos * cp / cn) / nullif(sum(pos), 0) as average_precision,
  {_top(0.1)}, {_top(0.2)}, {_budget(50)}, {_budget(100)}, {_budget(200)} from c group by 1""", " ".join(_NAMES))
def evaluation_measures(spark, sf):
    """ML-08: every measure of a score by cell, from one histogram."""
    found = portability.measures(union(spark, sf), "score", "y", group=["cell"])
    return found.toDF(*[c.replace("0.1", "10").replace("0.2", "20") for c in found.columns])


@query()
def development_decision(spark, sf):
    """ML-10: a ranker of score and breadth against breadth alone: chosen in one cell, judged in the other."""
    u = union(spark, sf)
    rows = portability.equal_weights(u.where("cell = 'F'"), "locus")
    models = {"full": ("score", "breadth"), "simple": ("breadth",)}
    fitted = fits.fit_all(rows, [fits.Task(features, "weight", "y", 1.0) for features in models.values()])
    for name, state in zip(models, fitted, strict=True):
        u = portability.with_score(u, fits.ranker(state), name)
    return portability.decide(spark, u.where("cell = 'F'"), u.where("cell = 'O'"), "full", "simple", "y", "locus", REPLICATES)
