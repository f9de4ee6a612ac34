"""Joins of call tables on exact loci and on intervals. A call is evidence; its absence is never a negative."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import primary_region
from ..functions.special import wilson
from .storage import stable


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", one_left: bool = False) -> DataFrame:
    """JN-16: a join whose right side (and left, if ``one_left``) has each key once; ValueError if not."""
    for side, df, check in (("right", right, True), ("left", left, one_left)):
        if check and (twice := df.groupBy(*on).count().where("count > 1").first()) is not None:
            raise ValueError(f"the {side} side has a key {twice['count']} times: {twice.asDict()}")
    return left.join(right, on, how)


def two_technology_union(a: DataFrame, b: DataFrame, key: str, motif: str, names: tuple[str, str], fields: tuple[str, ...] = ()) -> DataFrame:
    """JN-01, 02: every locus of either table with its class and the motif both agree on (null if they don't).

    ``fields`` are taken from the first table, and from the second where the first lacks them.
    """
    side = lambda df, tag: df.select(key, F.col(motif).alias(f"__{tag}"), F.lit(True).alias(f"__in_{tag}"), *[F.col(c).alias(f"__{tag}_{c}") for c in fields])
    both = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    kind = F.when(both, "shared").when(F.col("__in_a").isNotNull(), f"{names[0]}_exclusive_reported").otherwise(f"{names[1]}_exclusive_reported")
    agreed = F.when(both, F.when(F.col("__a") == F.col("__b"), F.col("__a"))).otherwise(F.coalesce("__a", "__b"))
    filled = [F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in fields]
    joined = side(a, "a").join(side(b, "b"), key, "full_outer")
    return joined.select(key, kind.alias("class"), agreed.alias(motif), F.when(both, F.col("__a") == F.col("__b")).alias("motifs_agree"), *filled)


def require_agreement(union: DataFrame, least: float = 0.999) -> DataFrame:
    """JN-02: ``union``; ValueError if fewer than ``least`` of the shared loci agree on their motif."""
    share = union.where("class = 'shared'").agg(F.avg(F.coalesce("motifs_agree", F.lit(False)).cast("double")).alias("s")).first()["s"]
    if share is not None and share < least:
        raise ValueError(f"{share:.4f} of the shared loci agree on their motif; at least {least} must")
    return union


def technology_union(calls: DataFrame, key: list[str], technology: str, technologies: list[str], single: dict[str, str] = {}) -> tuple[DataFrame, DataFrame]:
    """JN-03: support flags, breadth and pattern per key, and the keys left out as ambiguous.

    ``single`` maps each output column to the input column that must have one value per key.
    """
    flags = [F.max((F.col(technology) == t).cast("int")).alias(f"{t}_support") for t in technologies]
    held = [x for out, c in single.items() for x in (F.min(c).alias(out), (F.min(c) != F.max(c)).alias(f"__{out}_many"))]
    grouped = calls.groupBy(*key).agg(*flags, *held)
    many = reduce(lambda p, q: p | q, [F.coalesce(F.col(f"__{o}_many"), F.lit(False)) for o in single], F.lit(False))
    support = [F.col(f"{t}_support") for t in technologies]
    pattern = F.concat_ws("+", *[F.when(s == 1, F.lit(t)) for s, t in zip(support, technologies, strict=True)])
    named = grouped.select(
        *key, *single, *support, sum(support, F.lit(0)).alias("breadth"), pattern.alias("pattern"), many.alias("__ambiguous")
    )
    return named.where("not __ambiguous").drop("__ambiguous"), named.where("__ambiguous").drop("__ambiguous")


def attach_heldout(union: DataFrame, heldout: DataFrame, on: list[str], value: str, out: str = "heldout") -> DataFrame:
    """JN-08: <out>_present and <out>_support (0 where not reported) from the greatest value of each key."""
    best = heldout.groupBy(*on).agg(F.max(F.col(value).cast("int")).alias("__best"))
    joined = union.join(best, on, "left")
    return joined.select(*union.columns, F.col("__best").isNotNull().cast("int").alias(f"{out}_present"), F.coalesce("__best", F.lit(0)).alias(f"{out}_support"))


def three_valued_match(sites: DataFrame, heldout: DataFrame, coordinate: list[str], motif: str, out: str = "reported") -> DataFrame:
    """JN-09: 1 for the same coordinate and motif, null for the coordinate with other motifs only, else 0."""
    found = heldout.select(*coordinate, F.col(motif).alias("__m")).distinct()
    per = found.groupBy(*coordinate).agg(F.collect_set("__m").alias("__motifs"))  # a coordinate has a handful of motifs
    joined = sites.join(per, coordinate, "left")
    said = F.when(F.col("__motifs").isNull(), 0).when(F.array_contains("__motifs", F.col(motif)), 1)
    return joined.select(*sites.columns, said.alias(out))


def require_few_conflicts(matched: DataFrame, column: str = "reported", most: float = 0.01) -> DataFrame:
    """JN-09: ``matched`` (of ``three_valued_match``); ValueError if more than ``most`` of its rows are null."""
    share = matched.agg(F.avg(F.col(column).isNull().cast("double")).alias("s")).first()["s"]
    if share is not None and share > most:
        raise ValueError(f"{share:.2%} of the rows have another motif at their coordinate; at most {most:.2%} may")
    return matched


def group_disjoint(df: DataFrame, key: str, group: str) -> DataFrame:
    """JN-04: rows whose key is in one group only; a key of several groups leaves all of them."""
    single = df.groupBy(key).agg(F.count_distinct(group).alias("__n")).where("__n > 1").select(key)
    return df.join(single, key, "left_anti")


def absent_from(test: DataFrame, train: DataFrame, key: str, single: str | None = None) -> DataFrame:
    """JN-05: test rows whose key (and only one, if ``single`` counts them) isn't in ``train``."""
    rows = test if single is None else test.where(F.col(single) == 1)
    return rows.where(F.col(key).isNotNull()).join(train.select(key).distinct(), key, "left_anti")


def run_matches(sites: DataFrame, external: DataFrame, locus: list[str], run: list[str], complete: str, out: str) -> DataFrame:
    """JN-06: whether a site is in ``external`` by locus, or by an identical complete run; and by which."""
    exact = external.select(*locus).distinct().withColumn("__exact", F.lit(1))
    runs = external.where(F.col(complete)).select(*run).distinct().withColumn("__run", F.lit(1))
    joined = sites.join(exact, locus, "left").join(runs, run, "left")
    by_run = F.col(complete) & F.col("__run").isNotNull()
    mode = F.when(F.col("__exact").isNotNull(), "exact").when(by_run, "complete_U_run").otherwise("none")
    return joined.select(*sites.columns, (mode != "none").cast("int").alias(f"{out}_support"), mode.alias(f"{out}_mode"))


def _level(start: str, end: str, width: int) -> Column:
    """0 up to ``width``, and one more for each doubling of the length."""
    size = F.col(end) - F.col(start) + 1
    return F.greatest(F.ceil(F.log2(size / F.lit(float(width)))), F.lit(0)).cast("int")


def _bin(position: Column, level: Column, width: int) -> Column:
    return F.floor(position / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))


def within(points: DataFrame, intervals: DataFrame, on: list[str], pos: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points joined with the closed intervals that hold them, through bins as wide as the intervals.

    An interval's level is its length in doublings of ``width``, and its bins are as wide as that, so
    it falls into one or two of them however long it is. A point falls into one bin of each level
    that occurs (64 at most). The join is a hash or merge join on ``on``, level and bin, never a nested
    loop. Interval columns besides ``on`` come along; with ``how='left'`` a point outside all
    intervals, or without a position, stays. Intervals without an end, or that end before they
    start, hold nothing.
    """
    known = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    known = known.withColumn("__level", _level(start, end, width))
    levels = sorted(r["__level"] for r in known.select("__level").distinct().collect())
    at = lambda c: _bin(F.col(c), F.col("__level"), width)
    spread = known.withColumn("__bin", F.explode(F.sequence(at(start), at(end))))
    probed = points if how == "inner" else points.select(*on, pos).where(F.col(pos).isNotNull()).distinct()
    placed = probed.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", at(pos))
    cond = reduce(lambda a, b: a & b, [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*on, "__level", "__bin"]])
    cond = cond & F.col(f"p.{pos}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    more = [c for c in intervals.columns if c not in on]
    joined = placed.alias("p").join(spread.alias("i"), cond)
    if how == "inner":
        return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in more])
    held = joined.select(*[F.col(f"p.{c}").alias(f"__{c}") for c in [*on, pos]], *[F.col(f"i.{c}") for c in more])
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}") == F.col(f"h.__{c}") for c in [*on, pos]])
    return points.alias("a").join(held.alias("h"), same, how).select("a.*", *[F.col(f"h.{c}") for c in more])


def interval_support(sites: DataFrame, calls: DataFrame, key: str, chrom: str, lo: str, hi: str, pos: str, strand: str, width: int, out: str) -> DataFrame:
    """JN-07, 10: support of [lo, hi] by calls inside, whether strands differ, and the strands; null where lo or hi is."""
    spans = sites.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(key, chrom, lo, hi).distinct()
    hits = within(calls.select(chrom, pos, strand).distinct(), spans, [chrom], pos, lo, hi, width)
    seen = hits.groupBy(key).agg(F.sort_array(F.collect_set(strand)).alias("__strands"))
    joined = sites.join(seen, key, "left")
    usable = F.col(lo).isNotNull() & F.col(hi).isNotNull()
    n = F.coalesce(F.size("__strands"), F.lit(0))
    return joined.select(
        *sites.columns, F.when(usable, (n > 0).cast("int")).alias(f"{out}_support"),
        F.when(usable, (n > 1).cast("int")).alias(f"{out}_strand_ambiguous"), F.when(usable, F.array_join("__strands", "|")).alias(f"{out}_strands"),
    )


def annotate(points: DataFrame, features: DataFrame, key: str, on: list[str], pos: str, start: str, end: str, gene: str, width: int,
             transcript: str | None = None, region: str | None = None) -> DataFrame:
    """JN-11, 12: genes that hold each point and unique_gene, multi_gene_ambiguous or no_exon.

    With ``transcript`` and ``region`` also the transcripts, the set of regions and the primary region
    (FN-20). Features that overlap a point are few, so their sets stay small.
    """
    more = [c for c in (transcript, region) if c]
    hits = within(points.select(key, *on, pos).distinct(), features.select(*on, start, end, gene, *more), on, pos, start, end, width)
    sets = {"genes": gene} | ({"transcripts": transcript} if transcript else {}) | ({"regions": region} if region else {})
    seen = hits.groupBy(key).agg(*[F.sort_array(F.collect_set(c)).alias(name) for name, c in sets.items()])
    joined = points.join(seen, key, "left")
    n = F.coalesce(F.size("genes"), F.lit(0))
    status = F.when(n == 0, "no_exon").when(n == 1, "unique_gene").otherwise("multi_gene_ambiguous")
    extra = [F.array_join(c, "|").alias(c) for c in sets if c != "genes"] + ([primary_region(F.col("regions")).alias("primary_region")] if region else [])
    return joined.select(
        *points.columns, n.alias("n_genes"), F.array_join("genes", "|").alias("genes"), F.when(n == 1, F.col("genes")[0]).alias("unique_gene"), status.alias("gene_status"), *extra
    )


#: Places that are broadcast to their points; more are shuffled.
FEW_PLACES = 250_000


def annotation_counts(points: DataFrame, features: DataFrame, key: str, on: list[str], pos: str, start: str, end: str, gene: str, width: int) -> DataFrame:
    """JN-11 by key, without the genes' names: (key, n_genes, unique_gene, gene_status), however many features hold a point.

    Genes of a single interval are counted per distinct interval before anything meets them, others
    keep their name. Every distinct place is counted once and handed to the keys that lie there; only
    keys with several places meet the intervals themselves, as their places may share genes.
    """
    span = [*on, start, end]
    known = features.where(F.col(gene).isNotNull() & (F.col(start) <= F.col(end))).select(*span, gene).repartition(gene).distinct()
    own = F.when(F.count("*").over(Window.partitionBy(gene)) > 1, F.col(gene))
    spans = stable(known.withColumn("__own", own).groupBy(*span, "__own").agg(F.count("*").alias("__n"), F.min(gene).alias(gene)))

    def counted(at: DataFrame, by: list[str]) -> DataFrame:
        alike = [F.when(F.col("__own").isNull(), F.col(c)).alias(f"__a_{c}") for c in span]  # a gene with a name counts once
        each = within(at, spans, on, pos, start, end, width).groupBy(*by, *alike, "__own").agg(F.max("__n").alias("__n"), F.min(gene).alias(gene))
        return each.groupBy(*by).agg(F.sum("__n").alias("__n"), F.min(gene).alias(gene))

    place = [*on, pos]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [key, *place]])
    held = stable(counted(points.where(whole).select(*place).distinct(), place))
    held = F.broadcast(held) if held.count() <= FEW_PLACES else held
    lies = points.select(key, *[F.when(whole, F.col(c)).alias(c) for c in place]).repartition(key).distinct()
    lies = lies.withColumn("__places", F.count("*").over(Window.partitionBy(key)))
    one, several = lies.where("__places = 1"), lies.where("__places > 1").select(key, *place)
    found = one.join(held, place, "left").select(key, "__n", gene).unionByName(several.select(key).distinct().join(counted(several, [key]), key, "left"))
    n = F.coalesce("__n", F.lit(0)).cast("int")
    status = F.when(n == 0, "no_exon").when(n == 1, "unique_gene").otherwise("multi_gene_ambiguous")
    return found.select(key, n.alias("n_genes"), F.when(n == 1, F.col(gene)).alias("unique_gene"), status.alias("gene_status"))



def attach(df: DataFrame, values: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    """JN-13, 14: a left join, and the share of rows that found a value as an aggregate expression."""
    found = values.withColumn("__found", F.lit(1))
    joined = df.join(found, on, "left")
    return joined.withColumn("attached", F.col("__found").isNotNull()).drop("__found"), F.avg(F.col("attached").cast("double"))


#: How a gene's labels map to its loci (fixed values).
ONE_ASSIGNED, ONE_NOT, ONE_INVALID = "resolved_assigned", "resolved_not_assigned", "invalid_multiplicity"
ALL_ASSIGNED, ALL_NOT, AMBIGUOUS = "resolved_all_assigned", "resolved_all_not_assigned", "ambiguous_duplicate_gene"


def label_by_gene(sites: DataFrame, labels: DataFrame, gene: str) -> DataFrame:
    """JN-15: per gene of ``sites`` the loci, the labels, and whether their numbers say which loci are labelled."""
    n_sites = sites.groupBy(gene).agg(F.count("*").alias("n_loci"))
    n_labels = labels.groupBy(gene).agg(F.count("*").alias("n_labels"))
    per = n_sites.join(n_labels, gene, "left").fillna(0, ["n_labels"])
    loci, given = F.col("n_loci"), F.col("n_labels")
    single = F.when(given == 1, ONE_ASSIGNED).when(given == 0, ONE_NOT).otherwise(ONE_INVALID)
    several = F.when(given == 0, ALL_NOT).when(given == loci, ALL_ASSIGNED).otherwise(AMBIGUOUS)
    return per.withColumn("mapping_status", F.when(loci == 1, single).otherwise(several))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """JN-17: whether two frames hold the same rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def replicated(effects: DataFrame, on: list[str], group: str, groups: tuple[str, str], effect: str, q: str | None = None, level: float = 0.05) -> DataFrame:
    """JN-19: effects with one sign in both groups: both values, the smaller magnitude, and whether both pass ``level``."""
    sides = [
        effects.where(F.col(group) == g).select(*on, F.col(effect).alias(f"{effect}_{g}"), *([F.col(q).alias(f"{q}_{g}")] if q else []))
        for g in groups
    ]
    a, b = (F.col(f"{effect}_{g}") for g in groups)
    out = sides[0].join(sides[1], on).where(F.signum(a) == F.signum(b)).withColumn("min_abs", F.least(F.abs(a), F.abs(b)))
    if q:
        out = out.withColumn("both_significant", (F.col(f"{q}_{groups[0]}") < level) & (F.col(f"{q}_{groups[1]}") < level))
    return out


def loto_tasks(union: DataFrame, technologies: list[str]) -> DataFrame:
    """JN-20: a row per locus and left-out technology with at least one other source; the target's flag is masked to 0."""
    rows = union.withColumn("target", F.explode(F.array(*[F.lit(t) for t in technologies])))
    sources = {t: F.when(F.col("target") == t, 0).otherwise(F.col(f"{t}_support")) for t in technologies}
    reported = F.coalesce(*[F.when(F.col("target") == t, F.col(f"{t}_support")) for t in technologies])
    rows = rows.withColumns({"target_reported": reported} | {f"source_{t}": c for t, c in sources.items()})
    breadth = sum((F.col(f"source_{t}") for t in technologies), F.lit(0))
    pattern = F.concat_ws("+", *[F.when(F.col(f"source_{t}") == 1, F.lit(t)) for t in technologies])
    rows = rows.withColumns({"source_breadth": breadth, "source_pattern": pattern}).where("source_breadth >= 1")
    return rows.drop("breadth", "pattern", *[f"{t}_support" for t in technologies])


def largest_difference(a: DataFrame, b: DataFrame, on: list[str], column: str) -> DataFrame:
    """JN-21: one row: matched keys, and the largest absolute difference of a column."""
    joined = a.select(*on, F.col(column).alias("__a")).join(b.select(*on, F.col(column).alias("__b")), on)
    return joined.agg(F.count("*").alias("n"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_difference"))


def rate_table(df: DataFrame, group: list[str], outcome: str) -> DataFrame:
    """AGG-02, 03: n, positives, rate and Wilson interval by group."""
    out = df.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.withColumns({"rate": F.col("k") / F.col("n"), "ci_low": low, "ci_high": high})


def class_counts(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """AGG-01: negatives and positives of a 0/1 label by group, zero-filled."""
    return df.groupBy(*group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))


def continuum(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """AGG-04: n, mean, median and quartiles by class."""
    from .ranks import quantiles

    means = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    at = quantiles(df, group, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    joined = means.alias("l").join(at.alias("r"), reduce(lambda p, q: p & q, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group]), "left")
    return joined.select("l.*", "q25", "median", "q75")


def ordered_as(summary: DataFrame, group: str, order: list[str], value: str = "median") -> bool:
    """AGG-04: whether the values rise in the declared order of groups; False if one is missing."""
    found = {r[group]: r[value] for r in summary.where(F.col(group).isin(order)).select(group, value).collect()}
    values = [found.get(g) for g in order]
    return None not in values and all(a < b for a, b in zip(values, values[1:], strict=False))


def collapse(df: DataFrame, key: list[str], first: dict[str, str], means: list[str] = (), maxima: list[str] = (), sets: list[str] = ()) -> DataFrame:
    """AGG-05, 14: one row per key; ``first`` maps a column to the one whose least value picks it; sets are joined by |."""
    return df.groupBy(*key).agg(
        *[F.min_by(c, by).alias(c) for c, by in first.items()], *[F.avg(c).alias(f"mean_{c}") for c in means],
        *[F.max(c).alias(f"max_{c}") for c in maxima], *[F.array_join(F.sort_array(F.collect_set(c)), "|").alias(c) for c in sets],
        F.count("*").alias("n_records"),
    )


def agreeing_collapse(df: DataFrame, key: list[str], agree: str) -> DataFrame:
    """AGG-06: one row per key; ValueError if duplicates differ in ``agree``."""
    per = df.groupBy(*key).agg(F.min(agree).alias(agree), F.max(agree).alias("__other"))
    if (bad := per.where(F.col(agree) != F.col("__other")).first()) is not None:
        raise ValueError(f"duplicates disagree: {bad.asDict()}")
    return per.drop("__other")


def representative(exons: DataFrame, gene: str, transcript: str, start: str, end: str) -> DataFrame:
    """AGG-07: the longest transcript of each gene by summed exon length; ties go to the smaller id."""
    lengths = exons.groupBy(gene, transcript).agg(F.sum(F.col(end) - F.col(start) + 1).alias("transcript_length"), F.count("*").alias("n_exons"))
    best = F.min_by(F.struct(transcript, "transcript_length", "n_exons"), F.struct(-F.col("transcript_length"), F.col(transcript))).alias("best")
    return lengths.groupBy(gene).agg(best).select(gene, "best.*")


def burden(genes: DataFrame, annotated: DataFrame, gene: str, technology: str, technologies: list[str], length: str | None = None) -> DataFrame:
    """AGG-08: calls per gene and technology, zero for genes without, and densities per kb of ``length``."""
    counts = annotated.where(F.col(gene).isNotNull()).groupBy(gene).agg(*[F.count_if(F.col(technology) == t).alias(f"{t}_count") for t in technologies])
    out = genes.join(counts, gene, "left").fillna(0, [f"{t}_count" for t in technologies])
    if length:
        out = out.withColumns({f"{t}_per_kb": F.try_divide(F.col(f"{t}_count") * 1000.0, F.col(length)) for t in technologies})
    return out


def breadth_burden(genes: DataFrame, union: DataFrame, gene: str, breadth: str = "breadth") -> DataFrame:
    """AGG-09: loci per gene at all, at breadth 2 or more and 3, and the sum of breadths, with zeros."""
    b = F.col(breadth)
    counts = union.where(F.col(gene).isNotNull()).groupBy(gene).agg(
        F.count("*").alias("naive"), F.count_if(b >= 2).alias("breadth_2plus"), F.count_if(b == 3).alias("breadth_3"), F.sum(b).alias("breadth_sum")
    )
    return genes.join(counts, gene, "left").fillna(0, ["naive", "breadth_2plus", "breadth_3", "breadth_sum"])


def outcome_z(df: DataFrame, gene: str, dataset: str, value: str) -> DataFrame:
    """AGG-10: median of log10 of positive values by gene and dataset, and its z within the dataset (population SD)."""
    per = df.where(F.col(value) > 0).groupBy(gene, dataset).agg(F.percentile(F.log10(value), F.lit(0.5)).alias("log_value"))
    stats = per.groupBy(dataset).agg(F.avg("log_value").alias("__m"), F.stddev_pop("log_value").alias("__s"))
    return per.join(stats, dataset).select(gene, dataset, "log_value", F.try_divide(F.col("log_value") - F.col("__m"), F.col("__s")).alias("z"))


def pivoted_contrast(df: DataFrame, key: str, column: str, pair: tuple[str, str], value: str) -> DataFrame:
    """AGG-11, 17: a column per member of the pair and their difference; rows need both."""
    wide = df.groupBy(key).pivot(column, list(pair)).agg(F.min(value)).dropna(subset=list(pair))
    return wide.withColumn("contrast", F.col(pair[0]) - F.col(pair[1]))


def complete_pairs(df: DataFrame, key: str, column: str, pair: tuple[str, str], universe: int) -> DataFrame:
    """AGG-11: ``df``; ValueError unless each of ``universe`` keys has both members of the pair."""
    n = df.where(F.col(column).isin(*pair)).groupBy(key).agg(F.count_distinct(column).alias("n")).where("n = 2").count()
    if n != universe:
        raise ValueError(f"{n} keys of {universe} have both of {pair}")
    return df


def macro_support(deltas: DataFrame, group: list[str], value: str) -> DataFrame:
    """AGG-15: mean over datasets, positive datasets, and whether the mean and most datasets are positive."""
    out = deltas.groupBy(*group).agg(F.avg(value).alias("macro"), F.count_if(F.col(value) > 0).alias("n_positive"), F.count(value).alias("n"))
    return out.withColumn("supported", (F.col("macro") > 0) & (F.col("n_positive") * 2 > F.col("n")))


def average_repeats(predictions: DataFrame, key: list[str], y: str, prediction: str) -> DataFrame:
    """AGG-16: mean and SD of predictions over repeats; ``constant_y`` tells whether the outcome stayed the same."""
    return predictions.groupBy(*key).agg(
        F.min(y).alias(y), F.avg(prediction).alias(prediction), F.stddev_samp(prediction).alias("sd"), F.count("*").alias("n_repeats"),
        (F.min(y) == F.max(y)).alias("constant_y"),
    )


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """AGG-20: the columns that aren't constant, from one aggregate."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]
