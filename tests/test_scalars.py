import math

from pyspark.sql import functions as F

from siteweave.functions import scalars as fn
from siteweave.functions import sequence as sq
from siteweave.functions.special import chi2_tail, erfc, normal_p, t_quantile, t_tail, wilson


def values(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x")).alias("y")).collect()]


def test_numbers(spark):
    assert values(spark, ["1,234.5", "12%", " 7 ", "x", "", None, "NaN", "Infinity"], fn.to_number) == [1234.5, 12.0, 7.0, None, None, None, None, None]
    assert values(spark, ["3.0", "4", "a", None], fn.to_integer) == [3, 4, None, None]
    assert values(spark, ["1", "0.0", "no", "yes", "-2", None, "N/A"], fn.truthy) == [True, False, False, True, False, False, False]


def test_chromosomes(spark):
    assert values(spark, ["MT", "1", "Chr2", "x", "weird", None], fn.chromosome) == ["chrM", "chr1", "chr2", "chrx", "weird", ""]
    assert values(spark, ["NC_000023.11", "NC_000001.11", "NC_012920.1", "NW_1.1", "chrMT", "y"], fn.chromosome_of_accession) == ["chrX", "chr1", "chrM", "NW_1.1", "chrM", "chrY"]


def test_motifs(spark):
    assert values(spark, ["aaΨgc", "AATGC", "AAAGC", "AAUG", None], fn.motif5) == ["AAUGC", "AAUGC", "AAAGC", None, None]
    assert values(spark, ["AAAGC", "AAUGC"], lambda c: fn.motif5(c, centre_u=True)) == [None, "AAUGC"]
    assert values(spark, ["5'-AAGC-3'", "AA psi GC", "AAAGC", None], fn.context_motif) == ["AAUGC", "AAUGC", None, None]
    assert values(spark, ["AGUAC", "AUUAG", "AGA", "AGAAC"], fn.domain_status) == [
        "in_validated_domain", "out_of_validated_domain_consecutive_U", "out_of_validated_domain_invalid_length", "out_of_validated_domain_center_not_U",
    ]
    assert values(spark, ["AGUAC", "UUUAC", "AUUUU", "AGAAC"], fn.u_run_length) == [1, 3, 4, None]


def test_run_interval_follows_the_strand(spark):
    rows = [("+", "AUUGC"), ("-", "AUUGC"), ("+", "UUUGC"), (None, "AUUGC")]
    df = spark.createDataFrame([(i, 10, s, m) for i, (s, m) in enumerate(rows)], "i int, p long, s string, m string")
    got = [r[0] for r in df.orderBy("i").select(fn.u_run_interval(F.col("p"), F.col("s"), F.col("m"))).collect()]
    assert [(g.start, g.end, g.complete, g.single) if g else None for g in got] == [(9, 10, True, False), (10, 11, True, False), (8, 10, False, False), None]


def test_site_strings(spark):
    got = values(spark, ["chr14_73219165-73219168", "chr21_43774291-43774290", "chr15_76285712", "chrUn_KI270_v1_55", "chr1:10–12", "NONE", "", None], fn.parse_site)
    assert [(g.chrom, g.lo, g.hi, g.interval, g.mode) for g in got] == [
        ("chr14", 73219165, 73219168, 1, "tail_pattern_1"), ("chr21", 43774290, 43774291, 1, "tail_pattern_1"), ("chr15", 76285712, 76285712, 0, "tail_pattern_1"),
        ("chrUn_KI270_v1", 55, 55, 0, "tail_pattern_1"), ("chr1", 10, 12, 1, "tail_pattern_1"), (None, None, None, None, "unparsed"),
        (None, None, None, None, "missing"), (None, None, None, None, "missing"),
    ]


def test_loci(spark):
    assert values(spark, ["chr1:+:5", "chr1:5", None], fn.parse_locus)[1:] == [None, None]
    df = spark.createDataFrame([("chr1", "+", 5), ("chr1", None, 5)], "c string, s string, p long")
    assert [r[0] for r in df.select(fn.locus_key("c", "s", "p")).collect()] == ["chr1:+:5", None]


def test_attributes(spark):
    got = values(spark, ['gene "X"; tag "MANE Select"; db_xref "A:1"; db_xref "GeneID:7";', "ID=rna-NM_1.2;gene=TP%2053;Dbxref=GeneID:9", "gene_id ABC; n 2", None], fn.attributes)
    assert got[0] == {"gene": "X", "tag": "MANE Select", "db_xref": "A:1,GeneID:7"}
    assert got[1]["gene"] == "TP 53" and got[1]["ID"] == "rna-NM_1.2"
    assert got[2] == {"gene_id": "ABC", "n": "2"} and got[3] == {}
    assert values(spark, ['db_xref "A:1"; db_xref "GeneID:7";'], lambda c: fn.gene_id(fn.attributes(c))) == ["7"]
    assert values(spark, ["ID=rna-NM_1.2"], lambda c: fn.transcript_id(fn.attributes(c))) == ["NM_1.2"]


def test_confidence_and_regions(spark):
    got = values(spark, ["Highest", "high er", "lower", "odd", "", None], fn.confidence)
    assert [(g.label, g.ordinal) for g in got] == [("highest", 3.0), ("higher", 2.0), ("lower", 1.0), ("unresolved:odd", None), (None, None), (None, None)]
    assert values(spark, [["CDS", "5UTR"], ["5UTR"], ["5UTR", "3UTR"], [], None], fn.primary_region, "array<string>") == ["CDS", "5UTR", "MULTI", "UNANNOTATED", "UNANNOTATED"]


def test_tails(spark):
    xs = [0.0, 0.1, 0.46, 0.47, 1.0, 3.9, 4.1, 8.0]
    assert all(abs(g - math.erfc(x)) <= 1e-14 * max(1, abs(math.erfc(x))) for g, x in zip(values(spark, xs, erfc, "double"), xs, strict=True))
    assert abs(values(spark, [-1.959963984540054], normal_p, "double")[0] - 0.05) < 1e-12
    assert abs(chi2_tail(2.3190625605045243, 4) - 0.6773006033214971) < 1e-12
    assert abs(t_quantile(0.975, 4) - 2.7764451051977987) < 1e-10 and abs(t_tail(2.7764451051977987, 4) - 0.025) < 1e-12


def test_wilson(spark):
    df = spark.createDataFrame([(159, 1103), (84, 179), (0, 0)], "k long, n long")
    got = df.select(*wilson(F.col("k"), F.col("n"))).collect()
    assert abs(got[0][0] - 0.12465794169908585) < 1e-12 and abs(got[1][1] - 0.5422589544270063) < 1e-12
    assert got[2][0] is None


def test_sequences(spark):
    assert values(spark, ["AATGCCCTAAATGCC", "ATGATG", "", "ATGA"], sq.uorf_count) == [1, 0, 0, 0]
    assert values(spark, ["GGCA", "", "AAA"], sq.gc_fraction) == [0.75, 0.0, 0.0]
    df = spark.createDataFrame([(1, "ACGTNACG"), (2, "AC")], "k int, s string")
    got = {(r["k"], r["kmer"]): (r["n"], r["frequency"]) for r in sq.kmer_frequencies(df, "k", "s", 3).collect()}
    assert got == {(1, "ACG"): (2, 2 / 6), (1, "CGT"): (1, 1 / 6)}
    cds = spark.createDataFrame([(1, "ATGAAATAA"), (2, ""), (3, "TAANNN")], "k int, s string")
    codons = {r["k"]: r.asDict() for r in sq.codon_frequencies(cds, "k", "s").collect()}
    assert codons[1]["codon_ATG"] == 0.5 and codons[1]["codon_AAA"] == 0.5 and len(codons[1]) == 62
    assert all(v == 0.0 for k in (2, 3) for c, v in codons[k].items() if c != "k")


def test_projection(spark):
    exons = spark.createDataFrame([("t", "-", 100, 109), ("t", "-", 200, 219), ("u", "+", 1, 5)], "tx string, strand string, start long, end long")
    spans = spark.createDataFrame([("t", 215, 217), ("t", 105, 202), ("t", 150, 160)], "tx string, start long, end long")
    got = {(r["start"], r["end"]): (r["tx_start"], r["tx_end"]) for r in sq.project(spans, exons, "tx", "start", "end", "strand").collect()}
    assert got == {(215, 217): (2, 5), (105, 202): (17, 25)}
