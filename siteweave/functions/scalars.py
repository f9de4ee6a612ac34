"""Scalars of call tables as column expressions; all of them give null for unknown unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGU"
#: Motif classes by pattern (fixed values).
MOTIF_CLASSES = {
    "pus7": "^U[ACGU]UA[AG]$",
    "pus7_strict": "^U[CG]UAG$",
    "trub1": "^GUUC[ACGU]$",
    "plus1_u": "^...U.$",
}
#: Words that read as false (fixed values).
FALSE_WORDS = ("", "0", "0.0", "false", "no", "na", "n/a", "nan", "none")


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(as_column(c)), F.lit(""))


def safe_text(c) -> Column:
    """FN-01: trimmed text, empty for null."""
    return F.coalesce(F.trim(as_column(c)), F.lit(""))


def first_existing(*columns) -> Column:
    """SRC-26: the first of the columns that is not blank."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def to_number(c, finite: bool = True) -> Column:
    """FN-02: a number without thousands commas and percent signs; NaN (and infinities if ``finite``) are null."""
    x = F.regexp_replace(F.trim(as_column(c)), "[,%]", "").try_cast("double")
    good = ~F.isnan(x)
    return F.when(good & (F.abs(x) < float("inf")) if finite else good, x)


def to_integer(c) -> Column:
    """FN-03: an integer read through a number ("3.0" is 3)."""
    return F.trim(as_column(c)).try_cast("double").try_cast("bigint")


def truthy(c) -> Column:
    """FN-04: false for blanks and words of denial, positive for numbers, else true."""
    word = F.lower(safe_text(c))
    return ~word.isin(*FALSE_WORDS) & F.coalesce(word.try_cast("double") > 0, F.lit(True))


def chromosome(c) -> Column:
    """FN-05: chr-prefixed chromosome; other names stay."""
    z = safe_text(c)
    named = F.when(F.upper(z) == "MT", "M").otherwise(z)
    return F.when(F.lower(z).startswith("chr"), F.concat(F.lit("chr"), F.substring(z, 4, 1 << 20))).when(
        z.rlike("^(?i:[0-9]+|X|Y|M|MT)$"), F.concat(F.lit("chr"), named)
    ).otherwise(z)


def chromosome_of_accession(c) -> Column:
    """FN-06: as FN-05, with primary RefSeq accessions (NC_0000NN) turned into chromosomes."""
    z = safe_text(c)
    tail = F.substring(z, 4, 1 << 20)
    n = F.regexp_extract(z, r"^(?i:NC)_(\d{6})(?:\.\d+)?$", 1).try_cast("int")
    mito = lambda x: F.when(F.upper(x) == "MT", "M").otherwise(x)
    return (
        F.when(F.lower(z).startswith("chr"), F.concat(F.lit("chr"), mito(tail)))
        .when(z.rlike("^(?i:[0-9]+|X|Y|M|MT)$"), F.concat(F.lit("chr"), mito(F.upper(z))))
        .when(n.between(1, 22), F.concat(F.lit("chr"), n.cast("string")))
        .when(n == 23, "chrX").when(n == 24, "chrY").when(n == 12920, "chrM")
        .otherwise(z)
    )


def strand(c) -> Column:
    """FN-07: + or -, else null."""
    z = F.trim(as_column(c))
    return F.when(z.isin("+", "-"), z)


def rna(c) -> Column:
    """FN-10: upper-case RNA letters of a motif of any length."""
    return F.regexp_replace(F.translate(F.upper(safe_text(c)), "ΨT", "UU"), "[^ACGU]", "")


def motif5(c, centre_u: bool = False) -> Column:
    """FN-08: a 5-mer, if five letters are left (and the middle one is U, if asked)."""
    z = rna(c)
    good = F.length(z) == 5
    return F.when(good & (F.substring(z, 3, 1) == "U") if centre_u else good, z)


def context_motif(c, allow_four: bool = True) -> Column:
    """FN-09: a 5-mer from a context label; four flanking bases imply the middle U."""
    z = F.regexp_replace(F.upper(safe_text(c)), "PSEUDOURIDINE|PSI", "U")
    z = rna(z)
    whole = F.when((F.length(z) == 5) & (F.substring(z, 3, 1) == "U"), z)
    if not allow_four:
        return whole
    return whole.when(F.length(z) == 4, F.concat(F.substring(z, 1, 2), F.lit("U"), F.substring(z, 3, 2)))


def dinucleotide(c) -> Column:
    """FN-09: two bases."""
    z = F.regexp_replace(F.translate(F.upper(safe_text(c)), "T", "U"), "[^ACGU]", "")
    return F.when(F.length(z) == 2, z)


def strict_motif(c) -> Column:
    """FN-09: a 5-mer with U in the middle; blanks and dashes go, any other letter disqualifies."""
    z = F.regexp_replace(F.translate(F.upper(safe_text(c)), "ΨT", "UU"), "[ -]", "")
    return F.when(z.rlike("^[ACGU]{2}U[ACGU]{2}$"), z)


def domain_status(motif: Column) -> Column:
    """FN-11: why a motif is outside the scorer's domain; length, then middle, then neighbours."""
    at = lambda i: F.substring(motif, i, 1)
    return (
        F.when(F.length(motif) != 5, "out_of_validated_domain_invalid_length")
        .when(at(3) != "U", "out_of_validated_domain_center_not_U")
        .when((at(2) == "U") | (at(4) == "U"), "out_of_validated_domain_consecutive_U")
        .otherwise("in_validated_domain")
    )


def single_u(motif: Column) -> Column:
    """FN-12: a middle U without U next to it."""
    return motif.rlike("^.[ACG]U[ACG].$")


def _run(motif: Column) -> tuple[Column, Column]:
    """Length of the U run around the middle, to the left of it and to the right."""
    left = F.length(F.regexp_extract(F.substring(motif, 1, 2), "(U*)$", 1))
    right = F.length(F.regexp_extract(F.substring(motif, 4, 2), "^(U*)", 1))
    return left, right


def u_run_length(motif: Column) -> Column:
    """FN-13: length of the U run that holds the middle, 1 to 5; null without a middle U."""
    left, right = _run(motif)
    return F.when((F.length(motif) == 5) & (F.substring(motif, 3, 1) == "U"), left + right + 1)


def u_run_interval(pos: Column, strand_: Column, motif: Column) -> Column:
    """FN-14: struct of start, end, complete (touches neither edge), single and length of the run."""
    left, right = _run(motif)
    forward = strand_ == "+"
    known = strand_.isin("+", "-") & pos.isNotNull() & u_run_length(motif).isNotNull()
    return F.when(
        known,
        F.struct(
            F.when(forward, pos - left).otherwise(pos - right).alias("start"),
            F.when(forward, pos + right).otherwise(pos + left).alias("end"),
            ((left < 2) & (right < 2)).alias("complete"),
            ((left == 0) & (right == 0)).alias("single"),
            (left + right + 1).alias("length"),
        ),
    )


def locus_key(*parts) -> Column:
    """FN-15: the parts joined by colons; null if any is missing."""
    parts = [as_column(p).cast("string") for p in parts]
    blank = F.lit(False)
    for p in parts:
        blank = blank | p.isNull() | (p == "")
    return F.when(~blank, F.concat_ws(":", *parts))


def parse_locus(c) -> Column:
    """FN-16: struct of chrom, strand and pos from chrom:strand:pos; null otherwise."""
    z, pattern = as_column(c), r"^([^:]+):([+-]):(\d+)$"
    part = lambda i: F.regexp_extract(z, pattern, i)
    return F.when(z.rlike(pattern), F.struct(part(1).alias("chrom"), part(2).alias("strand"), part(3).try_cast("bigint").alias("pos")))


STRICT_SITE = r"^(chr[^_]+)_(\d+)(?:-(\d+))?$"


def parse_site_strict(c) -> Column:
    """FN-17: struct of chrom, first, second and interval from chrN_a or chrN_a-b; null otherwise."""
    z = F.trim(as_column(c))
    part = lambda i: F.regexp_extract(z, STRICT_SITE, i)
    second = F.nullif(part(3), F.lit(""))
    return F.when(
        z.rlike(STRICT_SITE),
        F.struct(part(1).alias("chrom"), part(2).alias("first"), second.alias("second"), second.isNotNull().cast("int").alias("interval")),
    )


#: The documented form of a site (fixed format).
SITE = r"^((?i:chr).+?)[_:](\d+)(?:\s*[-~/:;,]\s*(\d+))?$"


def parse_site(c) -> Column:
    """FN-18: struct of chrom, lo, hi, interval and mode; coordinates stay null where nothing is documented.

    A site is a name that starts with chr, _ or :, and one number, or two joined by a range sign; a
    number before a last _ or : belongs to the name. Outer quotes and brackets go. Every string that
    looser tails accept is read by this one first, so a parsed site has one mode.
    """
    raw = safe_text(c)
    z = F.regexp_replace(F.translate(raw, "−–—", "---"), r"""^["'\[\]() ]+|["'\[\]() ]+$""", "")
    first, second = F.regexp_extract(z, SITE, 2).try_cast("bigint"), F.regexp_extract(z, SITE, 3).try_cast("bigint")
    second = F.coalesce(second, first)
    found = _site(chromosome_of_accession(F.regexp_extract(z, SITE, 1)), F.least(first, second), F.greatest(first, second), F.lit("tail_pattern_1"))
    return (
        F.when(raw == "", _site(None, None, None, F.lit("missing"))).when(z.rlike(SITE), found)
        .otherwise(_site(None, None, None, F.lit("unparsed")))
    )


def _site(chrom, lo, hi, mode) -> Column:
    null = lambda x, kind: F.lit(None).cast(kind) if x is None else x
    lo, hi = null(lo, "bigint"), null(hi, "bigint")
    return F.struct(null(chrom, "string").alias("chrom"), lo.alias("lo"), hi.alias("hi"), (lo != hi).cast("int").alias("interval"), mode.alias("mode"))


def region_label(feature) -> Column:
    """FN-20: region of an annotation feature; null for others."""
    f = F.lower(as_column(feature))
    utr = f.contains("utr")
    return (
        F.when(f.isin("cds", "start_codon", "stop_codon"), "CDS")
        .when(f.contains("five_prime") & utr, "5UTR").when(f.contains("three_prime") & utr, "3UTR")
        .when(f == "utr", "UTR").when(f == "exon", "EXON_OTHER")
    )


def primary_region(regions: Column) -> Column:
    """FN-20: one region for a set: coding, a single-sided UTR, UTR, other exon, several, none."""
    has = lambda x: F.array_contains(regions, x)
    return (
        F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, "UNANNOTATED").when(has("CDS"), "CDS")
        .when(has("5UTR") & ~has("3UTR"), "5UTR").when(has("3UTR") & ~has("5UTR"), "3UTR")
        .when(has("UTR"), "UTR").when(has("EXON_OTHER"), "EXON_OTHER").otherwise("MULTI")
    )


_BLANK = " \t\n\r\f\v"


def attributes(c) -> Column:
    """FN-21: map of annotation attributes; the values of a repeated key are joined by commas.

    Assigned fields (k=v) come first, all of them; then quoted ones (k "v"), each value that the key
    doesn't have yet. Without either, fields of a key and a bare value count, all of them. Assigned
    and bare values lose outer quotes and are URL-decoded (a plus stays one); what can't be decoded
    stays as it is.
    """
    trim = lambda x: F.btrim(x, F.lit(_BLANK))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    form, plain = r'([A-Za-z0-9_.:-]+)\s+"([^"]*)"', r"^([A-Za-z0-9_.:-]+)\s+(.+)$"

    def decoded(x: Column) -> Column:
        bare = F.btrim(trim(x), F.lit('"'))
        return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)

    def kinds(z: Column) -> Column:
        fields = F.transform(F.split(z, ";"), trim)
        assigned = F.transform(F.filter(fields, lambda f: F.contains(f, F.lit("="))), lambda f: pair(trim(F.substring_index(f, "=", 1)), decoded(F.regexp_replace(f, "^[^=]*=", ""))))
        bare = F.transform(F.filter(fields, lambda f: f.rlike(plain)), lambda f: pair(F.regexp_extract(f, plain, 1), decoded(F.regexp_extract(f, plain, 2))))
        quoted = F.zip_with(F.regexp_extract_all(z, F.lit(form), F.lit(1)), F.regexp_extract_all(z, F.lit(form), F.lit(2)), pair)
        return F.struct(F.filter(assigned, lambda p: p["k"] != "").alias("assigned"), quoted.alias("quoted"), bare.alias("bare"))

    def chosen(x: Column) -> Column:
        none = (F.size(x["assigned"]) == 0) & (F.size(x["quoted"]) == 0)
        return F.struct(F.when(none, x["bare"]).otherwise(x["assigned"]).alias("all"), x["quoted"].alias("quoted"))

    def joined(x: Column) -> Column:
        of = lambda pairs, k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
        values = lambda k: F.concat(of(x["all"], k), F.array_except(of(x["quoted"], k), of(x["all"], k)))
        keys = F.array_distinct(F.transform(F.concat(x["all"], x["quoted"]), lambda p: p["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(values(k), ",").alias("value"))))

    out = safe_text(c)
    for step in (kinds, chosen, joined):  # an array of one binds what a step uses more than once
        out = F.transform(F.array(out), step)[0]
    return out


def attribute(attrs: Column, *keys: str) -> Column:
    """FN-22: the first value of the first of the keys that is there."""
    return F.coalesce(*[blank_to_null(F.split(F.try_element_at(attrs, F.lit(k)), ",")[0]) for k in keys])


def dbxref(attrs: Column, source: str) -> Column:
    """FN-22: the first cross-reference of a source, as in GeneID:7157."""
    raw = F.coalesce(F.try_element_at(attrs, F.lit("Dbxref")), F.try_element_at(attrs, F.lit("db_xref")))
    return F.nullif(F.regexp_extract(raw, rf"(?:^|,)\s*{source}:([^,]+)", 1), F.lit(""))


def gene_symbol(attrs: Column) -> Column:
    return attribute(attrs, "gene_name", "gene", "gene_symbol", "Name")


def gene_id(attrs: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "^gene-", "")
    return F.coalesce(bare(attribute(attrs, "gene_id", "GeneID")), dbxref(attrs, "GeneID"), bare(attribute(attrs, "gene_parent")))


def transcript_id(attrs: Column) -> Column:
    bare = lambda x: F.regexp_replace(x, "^rna-", "")
    like = lambda x: F.when(x.rlike("^(?:rna-|N[MR]_|X[MR]_|ENST)"), bare(x))
    return F.coalesce(
        bare(attribute(attrs, "transcript_id", "transcript")), like(attribute(attrs, "Name")), like(attribute(attrs, "Parent")),
        F.when(attribute(attrs, "ID").startswith("rna-"), bare(attribute(attrs, "ID"))),
    )


def strip_version(c) -> Column:
    return F.regexp_replace(safe_text(c), r"\.\d+$", "")


#: Confidence labels with their ordinals, in the order in which they are looked for, and their spellings with a gap (fixed values).
CONFIDENCE = (("highest", 3), ("higher", 2), ("lower", 1))
CONFIDENCE_SPLIT = (r"\bhigh[-_ ]est\b", r"\bhigh[-_ ]er\b", r"\blow[-_ ]er\b")


def confidence(c) -> Column:
    """FN-23: struct of label and ordinal (highest 3, higher 2, lower 1); ``unresolved:x`` has no ordinal.

    Whole words of any label come before spellings with a gap.
    """
    z = F.lower(safe_text(c))
    said = [(F.contains(z, F.lit(label)), label, n) for label, n in CONFIDENCE] + [(z.rlike(form), label, n) for (label, n), form in zip(CONFIDENCE, CONFIDENCE_SPLIT, strict=True)]
    first = lambda i: F.coalesce(*[F.when(x[0], F.lit(x[i])) for x in said])
    rank, label = first(2), first(1)
    label = F.when(z.isin("", "nan", "none"), F.lit(None)).otherwise(F.coalesce(label, F.concat(F.lit("unresolved:"), z)))
    return F.struct(label.alias("label"), rank.cast("double").alias("ordinal"))


def motif_classes(motif: Column) -> list[Column]:
    """FN-24: a flag per motif class."""
    return [motif.rlike(p).alias(name) for name, p in MOTIF_CLASSES.items()]


def flank_onehot(motif: Column) -> list[Column]:
    """FN-26: 0/1 per flank position and base; all 0 unless the motif has five letters."""
    good = F.length(motif) == 5
    return [
        (good & (F.substring(motif, off + 3, 1) == b)).cast("int").alias(f"motif_{off:+d}_{b}")
        for off in (-2, -1, 1, 2)
        for b in BASES
    ]


def source_fields(flags: dict[str, Column]) -> list[Column]:
    """FN-34: breadth and pattern of 0/1 support flags, given by technology in pattern order."""
    breadth = sum((c for c in flags.values()), F.lit(0))
    pattern = F.concat_ws("+", *[F.when(c == 1, F.lit(name)) for name, c in flags.items()])
    return [breadth.alias("source_breadth"), pattern.alias("source_pattern")]


#: Labels of scored sites by domain and breadth, and bands of the percentile (fixed values).
LAYERS = ("out_of_validated_domain", "multi_technology_supported", "single_source_ranked")
READINGS = (
    "not_scored_outside_validated_locally-single-U_domain",
    "orthogonal_source_support_present; portability score is supplementary",
    "use portability percentile/rank to prioritize orthogonal validation",
)
BANDS = (
    (0.90, "high_validation_priority"),
    (0.75, "elevated_validation_priority"),
    (0.25, "intermediate_validation_priority"),
)
LAST_BAND = "lower_validation_priority"


def evidence_labels(domain: Column, breadth: Column) -> list[Column]:
    """FN-36: the evidence layer and how a score may be read, by domain and breadth."""
    pick = lambda said: F.when(domain != "in_validated_domain", said[0]).when(breadth >= 2, said[1]).otherwise(said[2])
    return [pick(LAYERS).alias("evidence_layer"), pick(READINGS).alias("interpretation")]


def priority_band(p: Column) -> Column:
    """FN-36: the band of a percentile; null for null."""
    out = F.when(p.isNull(), F.lit(None))
    for least, name in BANDS:
        out = out.when(p >= least, name)
    return out.otherwise(LAST_BAND)


def confirmation_excess(breadth_sum: Column, naive: Column) -> Column:
    """FN-38: breadth beyond one technology per locus."""
    return breadth_sum - naive
