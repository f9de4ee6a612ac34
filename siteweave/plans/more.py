"""Further queries and SQL: scalars, sequence features, ingest, and the remaining joins and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import sequence as sq
from ..operators import loci, portability, ranks, regression, resample, stats
from ..sources import files, ingest
from .mapping import TECHNOLOGIES, calls, heldout, lines, table, union
from .queries import _DRAW, _EFFECTS, _TASKS, REPLICATES, _cells, _dense, _effects, query

_WORDS = "w as (select doc_id, unnest(string_split(text, ' ')) as raw from documents)"


@query(f"""with {_WORDS}, m as (
  select doc_id, regexp_replace(translate(upper(trim(raw)), 'ΨT', 'UU'), '[^ACGU]', '', 'g') as m from w),
 s as (
  select doc_id, m, case when length(m) <> 5 then 'out_of_validated_domain_invalid_length' when substr(m, 3, 1) <> 'U' then 'out_of_validated_domain_center_not_U'
   when substr(m, 2, 1) = 'U' or substr(m, 4, 1) = 'U' then 'out_of_validated_domain_consecutive_U' else 'in_validated_domain' end as status
  from m)
 select doc_id, m as motif, status, count(*) as n from s group by all""", mapped=False)
def motif_domain(spark, sf):
    """The motifs that are left of each document's words, and their status."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("raw")).select("doc_id", fn.rna("raw").alias("motif"))
    return words.groupBy("doc_id", "motif", fn.domain_status(F.col("motif")).alias("status")).agg(F.count("*").alias("n"))


_MOTIFS = """m as (select l_orderkey * 10 + l_linenumber as id, l_suppkey as pos, case l_returnflag when 'A' then '+' when 'N' then '-' else '.' end as strand,
 substr('ACGU', 1 + (l_partkey % 4)::int, 1) || substr('ACGUU', 1 + (l_suppkey % 5)::int, 1) || 'U' || substr('UUCGA', 1 + ((l_partkey // 4) % 5)::int, 1) || substr('ACGU', 1 + (l_orderkey % 4)::int, 1) as motif from lineitem),
 r as (select *, length(regexp_extract(substr(motif, 1, 2), '(U*)$', 1)) as lf, length(regexp_extract(substr(motif, 4, 2), '^(U*)', 1)) as rt from m)"""


def _motifs(spark, sf):
    pick = lambda letters, c: F.substr(F.lit(letters), (1 + c).cast("int"), F.lit(1))
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    motif = F.concat(pick("ACGU", p % 4), pick("ACGUU", s % 5), F.lit("U"), pick("UUCGA", F.floor(p / 4) % 5), pick("ACGU", o % 4))
    strand = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "N", "-").otherwise(".")
    return table(spark, sf, "lineitem").select(
        (o * 10 + F.col("l_linenumber")).alias("id"), s.alias("pos"), strand.alias("strand"), motif.alias("motif"),
        F.col("l_linestatus").alias("side"), F.col("l_linenumber").alias("line"),
    )


@query(f"""with {_MOTIFS} select distinct id, motif, lf + rt + 1 as run_length, case when strand = '+' then pos - lf when strand = '-' then pos - rt end as run_start,
 case when strand = '+' then pos + rt when strand = '-' then pos + lf end as run_end, case when strand in ('+', '-') then lf < 2 and rt < 2 end as complete from r""", mapped=False)
def u_run_intervals(spark, sf):
    m = _motifs(spark, sf).withColumn("r", fn.u_run_interval(F.col("pos"), F.col("strand"), F.col("motif")))
    return m.select(
        "id", "motif", fn.u_run_length(F.col("motif")).alias("run_length"), F.col("r.start").alias("run_start"), F.col("r.end").alias("run_end"), F.col("r.complete").alias("complete")
    ).distinct()


_FLANKS = ", ".join(f"(substr(motif, {off + 3}, 1) = '{b}')::int as \"motif_{off:+d}_{b}\"" for off in (-2, -1, 1, 2) for b in fn.BASES)


@query(f"""with {_MOTIFS} select motif, count(*) as n, regexp_full_match(motif, 'U[ACGU]UA[AG]') as pus7, regexp_full_match(motif, 'U[CG]UAG') as pus7_strict,
 regexp_full_match(motif, 'GUUC[ACGU]') as trub1, regexp_full_match(motif, '...U.') as plus1_u, {_FLANKS},
 regexp_full_match(motif, '.[ACG]U[ACG].') as single_u from m group by motif""", mapped=False)
def motif_flags(spark, sf):
    counts = _motifs(spark, sf).groupBy("motif").agg(F.count("*").alias("n"))
    m = F.col("motif")
    return counts.select("motif", "n", *fn.motif_classes(m), *fn.flank_onehot(m), fn.single_u(m).alias("single_u"))


@query("""with x as (select l_orderkey * 10 + l_linenumber as id, l_linestatus as side, l_suppkey + 100 * l_linenumber as pos,
  case l_returnflag when 'A' then '+' when 'N' then '-' else '.' end as strand,
  substr('ACGU', 1 + (l_partkey % 4)::int, 1) || substr('ACGUU', 1 + (l_suppkey % 5)::int, 1) || 'U' || substr('UUCGA', 1 + ((l_partkey // 4) % 5)::int, 1)
   || substr('ACGU', 1 + (l_orderkey % 4)::int, 1) as motif from lineitem),
 r as (select *, length(regexp_extract(substr(motif, 1, 2), '(U*)$', 1)) as lf, length(regexp_extract(substr(motif, 4, 2), '^(U*)', 1)) as rt from x),
 q as (
  select id, side, strand, pos, case when strand = '+' then pos - lf when strand = '-' then pos - rt end as s,
   case when strand = '+' then pos + rt when strand = '-' then pos + lf end as e, coalesce(strand in ('+', '-') and lf < 2 and rt < 2, false) as c
  from r),
 a as (select distinct id, strand, pos, s, e, c from q where side = 'F'), y as (select distinct strand, pos from q where side = 'O'),
 z as (select distinct strand, s, e from q where side = 'O' and c)
 select a.id, a.pos, a.strand, case when y.pos is not null then 'exact' when a.c and z.s is not null then 'complete_U_run' else 'none' end as x_mode,
  (y.pos is not null or (a.c and z.s is not null))::int as x_support
 from a left join y on a.strand = y.strand and a.pos = y.pos left join z on a.strand = z.strand and a.s = z.s and a.e = z.e""", mapped=False)
def run_matches(spark, sf):
    m = _motifs(spark, sf).withColumn("pos", F.col("pos") + 100 * F.col("line"))
    m = m.withColumn("r", fn.u_run_interval(F.col("pos"), F.col("strand"), F.col("motif")))
    m = m.select("id", "side", "strand", "pos", F.col("r.start").alias("s"), F.col("r.end").alias("e"), F.coalesce("r.complete", F.lit(False)).alias("c")).distinct()
    found = loci.run_matches(m.where("side = 'F'"), m.where("side = 'O'"), ["strand", "pos"], ["strand", "s", "e"], "c", "x")
    return found.select("id", "pos", "strand", "x_mode", "x_support")


@query(r"""with s as (select o_orderkey as k, o_custkey % 9 as c from orders)
 select k, case k % 5 when 0 then 'chr' || c when 1 then 'chrUn_x_v1' when 2 then 'chr2' end as chrom, case k % 5 when 0 then k when 1 then k when 2 then k end as lo,
  case k % 5 when 0 then k + 3 when 1 then k when 2 then k + 5 end as hi, case k % 5 when 0 then 1 when 1 then 0 when 2 then 1 end as interval,
  case k % 5 when 3 then 'unparsed' when 4 then 'missing' else 'tail_pattern_1' end as mode,
  case when k % 5 = 0 then 'chr' || c end as strict_chrom, case when k % 5 = 0 then k::varchar end as strict_first, case when k % 5 = 0 then (k + 3)::varchar end as strict_second
 from s""", mapped=False)
def site_strings(spark, sf):
    rows = site_texts(spark, sf).select("k", fn.parse_site("site").alias("f"), fn.parse_site_strict("site").alias("s"))
    return rows.select("k", "f.*", F.col("s.chrom").alias("strict_chrom"), F.col("s.first").alias("strict_first"), F.col("s.second").alias("strict_second"))


def site_texts(spark, sf):
    """Orders as site strings: ranges in two spellings, a contig with underscores, a word and a blank."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *p: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in p])
    site = (
        F.when(k % 5 == 0, text("chr", c % 9, "_", k, "-", k + 3)).when(k % 5 == 1, text("chrUn_x_v1_", k))
        .when(k % 5 == 2, text("chr2:", k + 5, "-", k)).when(k % 5 == 3, "none").otherwise("")
    )
    return table(spark, sf, "orders").select(k.alias("k"), site.alias("site"))


@query("""select event_id, event_id % 100 as n, event_type as symbol, case event_id % 3 when 2 then null else 'NM_' || (event_id % 7) || '.1' end as transcript,
 case event_id % 3 when 0 then 'MANE Select' end as tag from events""", mapped=False)
def annotation_attributes(spark, sf):
    """Attributes in quoted, assigned and bare form."""
    e = table(spark, sf, "events")
    n, kind, tx = (F.col("event_id") % 100).cast("string"), F.col("event_type"), (F.col("event_id") % 7).cast("string")
    quoted = F.concat(F.lit('gene "'), kind, F.lit('"; db_xref "X:1"; db_xref "GeneID:'), n, F.lit('"; transcript_id "NM_'), tx, F.lit('.1"; tag "MANE Select";'))
    assigned = F.concat(F.lit("gene="), kind, F.lit(";Dbxref=A:2,GeneID:"), n, F.lit(";Parent=rna-NM_"), tx, F.lit(".1"))
    bare = F.concat(F.lit("gene_name "), kind, F.lit("; gene_id gene-"), n)
    a = fn.attributes(F.when(F.col("event_id") % 3 == 0, quoted).when(F.col("event_id") % 3 == 1, assigned).otherwise(bare))
    return e.select(
        "event_id", fn.gene_id(a).cast("bigint").alias("n"), fn.gene_symbol(a).alias("symbol"), fn.transcript_id(a).alias("transcript"), fn.attribute(a, "tag").alias("tag")
    )


_SEQ = "s as (select doc_id, regexp_replace(translate(lower(text), 'ehtns', 'AATGC'), '[^ACGT]', '', 'g') as s from documents)"


def _sequences(spark, sf):
    """A nucleotide string made of the letters of each whole document."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.translate(F.lower("text"), "ehtns", "AATGC"), "[^ACGT]", "").alias("s"))


@query(f"""with {_SEQ}, p as (select doc_id, i, substr(s, i, 3) as c from (select doc_id, s, unnest(range(1, greatest(length(s) - 1, 1))) as i from s)),
 z as (select doc_id, i % 3 as f, max(i) as last from p where c in ('TAA', 'TAG', 'TGA') group by 1, 2),
 a as (select p.doc_id, count(*) as starts, count_if(i < last) as uorfs from p left join z on p.doc_id = z.doc_id and i % 3 = f where c = 'ATG' group by 1)
 select s.doc_id, coalesce(starts, 0)::int as starts, coalesce(uorfs, 0)::int as uorfs from s left join a on s.doc_id = a.doc_id""", mapped=False)
def upstream_orfs(spark, sf):
    s = F.col("s")
    return _sequences(spark, sf).select("doc_id", sq.upstream_starts(s).alias("starts"), sq.uorf_count(s).alias("uorfs"))


_CODONS = ", ".join(f"coalesce(count_if(c = '{c}') / nullif(count(c), 0), 0.0) as codon_{c}" for c in sq.sense_codons())


@query(f"""with {_SEQ}, c as (select doc_id, substr(s, i, 3) as c from (select doc_id, s, unnest(range(1, greatest(length(s) - 1, 1), 3)) as i from s)),
 k as (select doc_id, c from c where c not in ('TAA', 'TAG', 'TGA')) select s.doc_id, {_CODONS} from s left join k on s.doc_id = k.doc_id group by 1""",
       " ".join(f"codon_{c}" for c in sq.sense_codons()), mapped=False)
def codon_frequencies(spark, sf):
    return sq.codon_frequencies(_sequences(spark, sf), "doc_id", "s")


@query(f"""with {_SEQ}, l as (select *, least(8, length(s)) as a, least(11, length(s)) as b, length(s) as n from s)
 select doc_id, coalesce((substr(s, 6, 1) in ('A', 'G') and length(s) >= 6)::int, 0) as kozak_minus3_purine, coalesce((substr(s, 12, 1) = 'G')::int, 0) as kozak_plus4_g,
  substr(s, 9, 3) = 'ATG' as start_is_atg, a as utr5_length, b - a as cds_length, n - b as utr3_length,
  ln(1 + a) as log1p_utr5_length, ln(1 + b - a) as log1p_cds_length, ln(1 + n - b) as log1p_utr3_length from l""",
       "log1p_utr5_length log1p_cds_length log1p_utr3_length", mapped=False)
def start_context(spark, sf):
    s = F.col("s")
    end = lambda n: F.least(F.lit(n), F.length(s))
    lengths = [c.cast("long") if i % 2 == 0 else c for i, c in enumerate(sq.region_lengths(s, end(8), end(11)))]
    names = [f"{p}{k}_length" for k in ("utr5", "cds", "utr3") for p in ("", "log1p_")]
    return _sequences(spark, sf).select("doc_id", *sq.start_context(s, F.lit(8)), *[c.alias(n) for c, n in zip(lengths, names, strict=True)])


_EXONS = "x as (select distinct l_orderkey as tx, case when l_orderkey % 2 = 0 then '+' else '-' end as strand, l_linenumber * 1000 as s, l_linenumber * 1000 + 10 + l_orderkey % 50 as e from lineitem)"


def _exons(spark, sf):
    o, n = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    return table(spark, sf, "lineitem").select(
        o.alias("tx"), F.when(o % 2 == 0, "+").otherwise("-").alias("strand"), (n * 1000).alias("start"), (n * 1000 + 10 + o % 50).alias("end")
    ).distinct()


@query(f"""with {_EXONS}, o as (select *, coalesce(sum(e - s + 1) over (partition by tx order by case when strand = '-' then -e
    else s end rows between unbounded preceding and 1 preceding), 0) as o from x),
 i as (select distinct tx, 1005 as s, 3020 as e from x), c as (select i.tx, i.s as a, i.e as b, x.strand, o + case
    when x.strand = '+' then greatest(i.s, x.s) - x.s else x.e - least(i.e, x.e) end as f, o + case when x.strand = '+' then least(i.e, x.e) - x.s
    else x.e - greatest(i.s, x.s) end as l
  from i join o x on i.tx = x.tx where i.s <= x.e and i.e >= x.s)
 select tx, a as "start", b as "end", min(f)::bigint as tx_start, max(l)::bigint + 1 as tx_end from c group by 1, 2, 3""", mapped=False)
def transcript_projection(spark, sf):
    exons = _exons(spark, sf)
    spans = exons.select("tx").distinct().select("tx", F.lit(1005).alias("start"), F.lit(3020).alias("end"))
    return sq.project(spans, exons, "tx", "start", "end", "strand")


@query("""with x as (select distinct l_orderkey as tx, case when l_orderkey % 2 = 0 then '+'
    else '-' end as strand, l_linenumber * 1000 as s, l_linenumber * 1000 + 10 + l_orderkey % 50 as e from lineitem),
 o as (select *, coalesce(sum(e - s + 1) over (partition by tx order by case when strand = '-' then -e else s end rows between unbounded preceding and 1 preceding), 0) as o from x),
 i as (
  select distinct tx, 'start_codon' as feature, s + 1 as a, s + 3 as b from x where s = 1000 union all select distinct tx, 'stop_codon', s + 2, s + 4 from x where s = 4000 and tx % 3 = 0
  union all select tx, 'CDS', s, e from x),
 c as (
  select i.tx, i.feature, i.a, i.b, o + case when strand = '+' then greatest(i.a, s) - s else e - least(i.b, e) end as f, o + case
    when strand = '+' then least(i.b, e) - s else e - greatest(i.a, s) end as l
  from i join o on i.tx = o.tx where i.a <= e and i.b >= s),
 p as (select tx, feature, a, b, min(f) as f, max(l) + 1 as l from c group by 1, 2, 3, 4),
 m as (
  select tx, min(f) filter (where feature = 'start_codon') as sa, max(l) filter (where feature = 'stop_codon') as sb, min(f) filter (where feature = 'CDS') as ca, max(l) filter (where feature = 'CDS') as cb
  from p group by 1)
 select tx, case when sa is not null and sb is not null then sa else ca end::bigint as cds_start, case when sa is not null and sb is not null then sb
    else cb end::bigint as cds_end from m""", mapped=False)
def coding_spans(spark, sf):
    """FN-33: the coding span of each transcript, from its codons or its coding exons."""
    exons = _exons(spark, sf)
    part = lambda df, f, a, b: df.select("tx", F.lit(f).alias("feature"), a.alias("start"), b.alias("end")).distinct()
    s, e = F.col("start"), F.col("end")
    features = part(exons.where("start = 1000"), "start_codon", s + 1, s + 3).unionByName(part(exons.where("start = 4000 and tx % 3 = 0"), "stop_codon", s + 2, s + 4)).unionByName(part(exons, "CDS", s, e))
    return sq.coding_span(sq.project(features, exons, "tx", "start", "end", "strand"), "tx", "feature")


@query("""with s as (select gene, count(*) as n_loci from u where cell = 'F' group by 1), l as (select gene, count(*) as n_labels from u where cell = 'O' and y = 1 group by 1)
 select s.gene, n_loci, coalesce(n_labels, 0)::bigint as n_labels, case when n_loci = 1 then case coalesce(n_labels, 0) when 1 then 'resolved_assigned'
    when 0 then 'resolved_not_assigned' else 'invalid_multiplicity' end
  else case when coalesce(n_labels, 0) = 0 then 'resolved_all_not_assigned' when n_labels = n_loci then 'resolved_all_assigned'
    else 'ambiguous_duplicate_gene' end end as mapping_status from s left join l on s.gene = l.gene""")
def label_multiplicity(spark, sf):
    u = union(spark, sf)
    return loci.label_by_gene(u.where("cell = 'F'"), u.where("cell = 'O' and y = 1"), "gene")


@query("""with h as (select locus, max(score) as s from u where cell = 'O' group by 1), j as (select a.locus, h.locus is not null as f from u a left
    join h on a.locus = h.locus where a.cell = 'F') select count(*) as n, avg(f::int) as coverage from j""", "coverage")
def attached_coverage(spark, sf):
    u = union(spark, sf)
    other = u.where("cell = 'O'").groupBy("locus").agg(F.max("score").alias("s"))
    joined, coverage = loci.attach(u.where("cell = 'F'"), other, ["locus"])
    return joined.agg(F.count("*").alias("n"), coverage.alias("coverage"))


@query("""with x as (select locus, min(motif) as motif, min(gene) as gene, min(score) as score from calls where cell = 'F' and tech = 'A' group by 1),
 z as (select locus, min(motif) as motif, min(gene) as gene, min(score) as score from calls where cell = 'F' and tech = 'N' group by 1)
 select coalesce(x.locus, z.locus) as locus, case when x.locus is null then 'N_exclusive_reported' when z.locus is null then 'A_exclusive_reported' else 'shared' end as class,
  case when x.locus is null or z.locus is null then coalesce(x.motif, z.motif) when x.motif = z.motif then x.motif end as motif,
  case when x.locus is not null and z.locus is not null then x.motif = z.motif end as motifs_agree, coalesce(x.gene, z.gene) as gene, coalesce(x.score, z.score) as score
 from x full join z on x.locus = z.locus""", "score")
def two_technology_union(spark, sf):
    """JN-02: every locus of two technologies with its class, agreed motif and fields of whichever has them; the agreement is gated."""
    side = lambda t: calls(spark, sf).where((F.col("cell") == "F") & (F.col("tech") == t)).groupBy("locus").agg(
        F.min("motif").alias("motif"), F.min("gene").alias("gene"), F.min("score").alias("score")
    )
    return loci.require_agreement(loci.two_technology_union(side("A"), side("N"), "locus", "motif", ("A", "N"), ("gene", "score")))


@query("""with a as (select motif, avg(y) as r from u group by 1), b as (select motif, sum(y) / count(*)::double + 0.001 * (length(motif) % 3) as r from u
    group by 1) select count(*) as n, max(abs(a.r - b.r)) as max_abs_difference from a join b on a.motif = b.motif""", "max_abs_difference")
def version_difference(spark, sf):
    u = union(spark, sf)
    a = u.groupBy("motif").agg(F.avg("y").alias("r"))
    b = u.groupBy("motif").agg((F.sum("y") / F.count("*") + 0.001 * (F.length(F.first("motif")) % 3)).alias("r"))
    return loci.largest_difference(a, b, ["motif"], "r")


@query("""with d as (select cell, pattern, avg(y) - .19 as d from u group by 1, 2) select cell, avg(d) as macro,
    count_if(d > 0)::bigint as n_positive, count(d) as n, avg(d) > 0 and count_if(d > 0) * 2 > count(d) as supported from d group by 1""", "macro")
def macro_support(spark, sf):
    d = union(spark, sf).groupBy("cell", "pattern").agg((F.avg("y") - 0.19).alias("d"))
    return loci.macro_support(d, ["cell"], "d")


@query("""select motif, min(y)::int as y, avg(score) as score, stddev_samp(score) as sd, count(*) as n_repeats, min(y) = max(y) as constant_y from u group by 1""", "score sd")
def repeat_average(spark, sf):
    return loci.average_repeats(union(spark, sf).select("motif", "y", "score"), ["motif"], "y", "score")


@query("""with e as (select cell, motif, avg(y) - .19 as d from u group by 1, 2) select motif, min(sign(d)) = max(sign(d)) as sign_stable, count(*) as n from e group by 1""")
def sign_stability(spark, sf):
    return regression.stability(union(spark, sf).groupBy("cell", "motif").agg((F.avg("y") - 0.19).alias("d")), ["motif"], "d")


@query("""with r as (select pattern, y, rank() over (partition by pattern order by score) + (count(*) over (partition by pattern, score) - 1) / 2.0 as rk from u where cell = 'F')
 select pattern, count(*) as n, sum(y)::bigint as n_pos, case when count(*) >= 300 then (sum(case when y = 1 then rk end) -
    sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y)::double * sum(1 - y), 0) end as auroc from r group by 1""", "auroc")
def category_auroc(spark, sf):
    return stats.category_auroc(union(spark, sf).where("cell = 'F'"), "pattern", "score", "y", 300)


@query("""with x as (select motif like '%STANDARD' as f, breadth::double as v from u where cell = 'F') select count_if(f)::bigint as n_flagged,
    count_if(not f)::bigint as n_rest, (quantile_cont(ln(1 + v), .5) filter (where f)) - (quantile_cont(ln(1 + v), .5) filter (where not f)) as effect from x""", "effect")
def plus_one_effect(spark, sf):
    rows = union(spark, sf).where("cell = 'F'").select(F.col("motif").endswith("STANDARD").alias("f"), F.col("breadth").cast("double").alias("v"))
    return stats.plus_one_effect(rows, "v", "f")


@query("""with m as (select motif, avg(score) as a, avg(breadth) as b from u group by 1)
    select count(*) as n, avg(a) as mean_a, median(a) as median_a, avg(b) as mean_b, median(b) as median_b from m where motif like '%PROMO'""", "mean_a median_a mean_b median_b")
def set_summary(spark, sf):
    m = union(spark, sf).groupBy("motif").agg(F.avg("score").alias("a"), F.avg("breadth").alias("b")).withColumn("f", F.col("motif").endswith("PROMO"))
    return stats.set_summary(m, "f", ["a", "b"])


@query("""select locus, y as target_reported, a as "source_A", n as "source_N", r as "source_R", breadth as source_breadth, pattern as source_pattern from u where cell = 'F'""")
def heldout_benchmark(spark, sf):
    rows = portability.heldout_benchmark(union(spark, sf).where("cell = 'F'"), TECHNOLOGIES, "y")
    return rows.select("locus", "target_reported", *[f"source_{t}" for t in TECHNOLOGIES], "source_breadth", "source_pattern")


@query("""select locus, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0) / count(*) over () as global_percentile,
 (rank() over (partition by pattern order by score) + (count(*) over (partition by pattern, score) - 1) / 2.0) / count(*) over (partition by pattern) as within_pattern_percentile from u where cell = 'F'""", "global_percentile within_pattern_percentile")
def scorecard(spark, sf):
    rows = union(spark, sf).where("cell = 'F'").select("locus", "score", F.col("pattern").alias("source_pattern"))
    return portability.scorecard(rows, "score").select("locus", "global_percentile", "within_pattern_percentile")


#: A coefficient table with a standardised feature, a flag and an intercept.
_MODEL = [
    {"feature": "score", "coefficient": 0.4, "mean": 48.0, "scale": 28.0}, {"feature": "breadth", "coefficient": -0.7, "mean": 1.2, "scale": 0.45},
    {"feature": "(intercept)", "coefficient": -1.5, "mean": 0.0, "scale": 1.0},
]


@query("select cell, locus, -1.5 + (score - 48) / 28 * .4 - (breadth - 1.2) / .45 * .7 as s from u", "s")
def linear_scores(spark, sf):
    return portability.with_score(union(spark, sf), _MODEL, "s").select("cell", "locus", "s")


@query(f"with {_TASKS}, c as (select score, source_breadth as b, 1.0 / count(*) over (partition by locus) as w from tk where cell = 'F') select sum(w * score) / sum(w) as mean_score, sqrt(sum(w * score * score) / sum(w) - (sum(w * score) / sum(w)) ** 2) as sd_score, sum(w * b) / sum(w) as mean_breadth from c", "mean_score sd_score mean_breadth")
def weighted_moments(spark, sf):
    rows = portability.equal_weights(loci.loto_tasks(union(spark, sf), TECHNOLOGIES).where("cell = 'F'"), "locus")
    got = portability.weighted_moments(rows, ["score", "source_breadth"], "weight")
    return spark.createDataFrame([(*got["score"], got["source_breadth"][0])], "mean_score double, sd_score double, mean_breadth double")


@query("""with k as (select c_mktsegment || (c_nationkey % 2) as name, md5((c_nationkey // 24)::varchar) as h, c_name as path from customer)
 select name, count(distinct h) as n_hashes, case when count(distinct h) = 1 then min(path) end as path, case when count(distinct h) = 1 then min(h) end as h,
    case when count(distinct h) = 1 then 'FROZEN' else 'REFERENCE_CONFLICT' end as status from k group by 1""", mapped=False)
def reference_freeze(spark, sf):
    n = F.col("c_nationkey")
    rows = table(spark, sf, "customer").select(
        F.concat("c_mktsegment", (n % 2).cast("string")).alias("name"), F.md5(F.floor(n / 24).cast("string")).alias("h"), F.col("c_name").alias("path")
    )
    return files.freeze(rows, "name", "h", "path")


@query("""with n as (select c_custkey, case c_custkey % 4 when 0 then 'a Ψ' when 1 then ' a  b ' when 2 then 'a/b' else '' end as raw, c_custkey // 40 as sheet, c_custkey % 40 as col from customer),
 b as (select *, case c_custkey % 4 when 0 then 'a_psi' when 3 then 'unnamed' else 'a_b' end as base from n), r as (select *, row_number() over (partition by sheet, base order by col) as i from b)
 select 'f' as file, sheet, col, case when i = 1 then base else base || '__dup' || i end as name, trim(raw) as raw_name from r""", mapped=False)
def column_names(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "a Ψ").when(k % 4 == 1, " a  b ").when(k % 4 == 2, "a/b").otherwise("")
    cells = table(spark, sf, "customer").select(
        F.lit("f").alias("file"), F.floor(k / 40).alias("sheet"), F.lit(0).alias("row"), (k % 40).alias("col"), raw.alias("value")
    )
    heads = cells.select("file", "sheet").distinct().withColumn("header_row", F.lit(0))
    return ingest.column_names(cells, heads)


@query(r"""with h as (select sheet, min("row") as top from (select c_custkey % 100 as sheet, c_custkey // 100 as "row" from customer) group by 1)
    select 'f' as file, c_custkey % 100 as sheet, c_custkey // 100 as "row", c_name as a, c_nationkey::varchar as b
 from customer, h where c_custkey % 100 = sheet and c_custkey // 100 > top""", mapped=False)
def cell_records(spark, sf):
    cells = _cells(spark, sf)
    heads = cells.groupBy("file", "sheet").agg(F.min("row").alias("header_row"))
    names = ingest.column_names(cells, heads).groupBy("file", "sheet").agg(*[F.max(F.when(F.col("col") == i, F.col("name"))).alias(f"n{i}") for i in (0, 2)])
    rows = ingest.records(cells, heads).join(names, ["file", "sheet"])
    return rows.select("file", "sheet", "row", F.element_at("raw", F.col("n0")).alias("a"), F.element_at("raw", F.col("n2")).alias("b"))


@query("""select l.l_orderkey * 10 + l.l_linenumber as id, p_name as gene from lineitem l left join part on l_partkey % 150 = p_partkey group by 1, 2""", mapped=False)
def identifier_mapping(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat((F.col("l_partkey") % 150).cast("string"), F.lit(".2")).alias("acc"))
    mapping = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("gene"))
    return ingest.map_identifiers(rows, "acc", mapping).select("id", "gene").distinct()


@query(f"with {_EFFECTS} select o.dataset as omitted, ef.dataset, ef.beta from ef join (select dataset from ef) o on ef.dataset <> o.dataset", "beta")
def leave_one_out_rows(spark, sf):
    return ranks.leave_one_out(_effects(spark, sf), "dataset").select("omitted", "dataset", "beta")


_R2 = f"""with e as (select vec_id, label as ds, embedding[1]::double as y, embedding[2]::double as f1, embedding[3]::double as f2 from embeddings),
 r as (select *, row_number() over (partition by ds order by vec_id) - 1 as idx, count(*) over (partition by ds) as n from e),
 s as (select ds, any_value(n) as n from r group by 1), reps as (select rep from range({REPLICATES}) a(rep)),
 {{levels}},
 d as (
  select rep, ds, times, {_DRAW.format(parts="'31', ds, rep, i")} % n as idx, count(*) as m
  from (select rep, ds, times, n, unnest(range(n)) as i from lv) group by 1, 2, 3, 4),
 z as (
  select rep, ds, times, sum(m * y * y) - sum(m * y) ** 2 / sum(m) as t, sum(m * (y - f1) ** 2) as a, sum(m * (y - f2) ** 2) as b
  from d join r using (ds, idx) group by 1, 2, 3)
 """
_DRAWN_SETS = f"""k as (select ds, row_number() over (order by ds) - 1 as d, count(*) over () as c from s),
 dr as (select rep, {_DRAW.format(parts="'32', rep, i")} % c as d, count(*) as times from reps, (select distinct c from k), (select unnest(range(c)) as i
    from (select distinct c from k)) group by 1, 2),
 lv as (select rep, k.ds, times, n from dr join k using (d) join s on s.ds = k.ds)"""


def _paired(spark, sf):
    rows, features = _dense(spark, sf)
    return rows.select("ds", "vec_id", "y", *features[:2])


@query(_R2.replace("{levels}", _DRAWN_SETS) + "select rep, ds, times, 1 - a / t as r2_f1, 1 - b / t as r2_f2 from z", "r2_f1 r2_f2", mapped=False)
def dataset_r2_bootstrap(spark, sf):
    """RS-09: bootstrap of R-squared by dataset with datasets drawn first."""
    return resample.r2_bootstrap(_paired(spark, sf), "ds", "vec_id", "y", ["f1", "f2"], REPLICATES, 31, hierarchical=True, by_row=True)


@query(_R2.replace("{levels}", "lv as (select rep, ds, 1 as times, n from s, reps)") + """, x as (select ds, b, a, t, (1 - b / t) - (1 - a / t) as delta from z)
 select ds, quantile_cont(delta, .025) as ci_low, quantile_cont(delta, .975) as ci_high, count(delta) as n_boot from x group by 1""", "ci_low ci_high", mapped=False)
def r2_delta_intervals(spark, sf):
    """RS-08: interval of the difference of two models' R-squared by dataset."""
    drawn = resample.r2_bootstrap(_paired(spark, sf), "ds", "vec_id", "y", ["f1", "f2"], REPLICATES, 31, by_row=True)
    delta = F.col("r2_f2") - F.col("r2_f1")
    return drawn.groupBy("ds").agg(F.percentile(delta, F.lit(0.025)).alias("ci_low"), F.percentile(delta, F.lit(0.975)).alias("ci_high"), F.count(delta).alias("n_boot"))


@query()
def r2_by_chunks(spark, sf):
    """RS-08, 09: bootstrap of R-squared over all components' models, datasets drawn first, drawn chunk by chunk."""
    rows, features = _dense(spark, sf)
    return resample.r2_bootstrap(rows, "ds", "vec_id", "y", features, REPLICATES, 31, hierarchical=True)


@query()
def ranker_evaluation(spark, sf):
    """The evaluation record of a score; each of its numbers has a query of its own with SQL."""
    rows = union(spark, sf).where("cell = 'F'")
    got = portability.evaluate(rows, "score", "y", "locus", replicates=REPLICATES)
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in sorted(got.items())], "metric string, value double")


@query("""select cell, count(distinct locus) as n from held group by 1""")
def heldout_counts(spark, sf):
    return heldout(spark, sf).groupBy("cell").agg(F.count_distinct("locus").alias("n"))


@query("""select tech, count(distinct locus) as n_loci, count(distinct motif) as n_motifs from calls group by 1""")
def call_counts(spark, sf):
    return calls(spark, sf).groupBy("tech").agg(F.count_distinct("locus").alias("n_loci"), F.count_distinct("motif").alias("n_motifs"))


@query("""select dataset, count(*) as n, quantile_cont(l_extendedprice / l_quantity, .5) as median from ln group by 1""", "median")
def outcome_medians(spark, sf):
    rows = lines(spark, sf).withColumn("v", F.col("l_extendedprice") / F.col("l_quantity"))
    return rows.groupBy("dataset").agg(F.count("*").alias("n")).join(ranks.quantiles(rows, ["dataset"], "v", {"median": 0.5}), "dataset")
