"""From messy published tables to call tables.

Workbooks come as cell tables (file, sheet, row, col, value): a row per cell, so that finding
headers, blocks and columns is grouping and joining, however many sheets there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn

SHEET = ["file", "sheet"]
NUMBER = r"^[-+]?\d+(\.\d+)?$"
#: What a base window's columns must hold (fixed values).
BASE_SHARE, CENTRE_SHARE = 0.9, 0.9
MISSING_WORDS = ("", "nan", "none", "na")


def header_rows(cells: DataFrame, keywords: list[str], scan: int = 25, weight: float = 5.0, strings: float = 0.25) -> DataFrame:
    """SRC-08, 31: the header row of each sheet: most ``weight`` * keywords + filled + ``strings`` * texts; the first on a tie."""
    value = fn.safe_text("value")
    filled = value != ""
    row_text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", value.alias("v")))), lambda s: s["v"]), " "))
    scored = cells.where(F.col("row") < scan).groupBy(*SHEET, "row").agg(
        row_text.alias("text"), F.count_if(filled).alias("filled"), F.count_if(filled & ~value.rlike(NUMBER)).alias("texts")
    )
    hits = sum((F.col("text").contains(k.lower()).cast("int") for k in keywords), F.lit(0))
    scored = scored.withColumn("score", hits * weight + F.col("filled") + F.col("texts") * strings)
    best = F.max_by(F.struct(F.col("row").alias("header_row"), "score"), F.struct("score", -F.col("row")))
    return scored.groupBy(*SHEET).agg(best.alias("b")).select(*SHEET, "b.*")


def clean_name(c) -> Column:
    """SRC-09: a column name of letters, digits and _.()+%-."""
    z = F.regexp_replace(F.regexp_replace(fn.safe_text(c), "Ψ", "psi"), "[′’]", "")
    z = F.regexp_replace(F.regexp_replace(F.regexp_replace(z, r"\s+", "_"), r"[^A-Za-z0-9_.()+%-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(z, "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))


def column_names(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """SRC-09: (file, sheet, col, name, raw_name); later uses of a name get __dup2, __dup3 and so on."""
    top = cells.join(headers.select(*SHEET, "header_row"), SHEET).where(F.col("row") == F.col("header_row"))
    named = top.select(*SHEET, "col", fn.safe_text("value").alias("raw_name"), clean_name("value").alias("base"))
    n = F.row_number().over(Window.partitionBy(*SHEET, "base").orderBy("col"))
    return named.withColumn("n", n).select(
        *SHEET, "col", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("__dup"), F.col("n"))).alias("name"), "raw_name"
    )


def records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """SRC-10, 25: (file, sheet, row, raw) with a map of the named cells of each non-empty row below the header."""
    names = column_names(cells, headers)
    body = cells.join(headers.select(*SHEET, "header_row"), SHEET).where(F.col("row") > F.col("header_row"))
    filled = body.join(names, [*SHEET, "col"]).where(fn.safe_text("value") != "")
    return filled.groupBy(*SHEET, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("raw"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-11: rows, filled and numeric share of each column, from one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("c"))
    value, number = fn.safe_text("c.value"), fn.to_number("c.value")
    filled = value != ""
    return long.groupBy(F.col("c.column").alias("column")).agg(
        F.count("*").alias("n_rows"), F.count_if(filled).alias("n_filled"),
        F.try_divide(F.count_if(filled & number.isNotNull()), F.count_if(filled)).alias("numeric_share"),
    )


def keyword_tags(cells: DataFrame, terms: dict[str, list[str]], by: list[str]) -> DataFrame:
    """SRC-12: per block the tags with a matching cell and the terms that matched."""
    text = F.lower(fn.safe_text("value"))
    pairs = F.array(*[F.when(text.contains(t.lower()), F.struct(F.lit(tag).alias("tag"), F.lit(t).alias("term"))) for tag, ts in terms.items() for t in ts])
    hits = cells.select(*by, F.explode(F.array_compact(pairs)).alias("h"))
    return hits.groupBy(*by, F.col("h.tag").alias("tag")).agg(F.array_join(F.sort_array(F.collect_set("h.term")), "|").alias("terms"), F.count("*").alias("n"))


def motif_columns(cells: DataFrame, least: int) -> DataFrame:
    """SRC-13: columns with at least ``least`` distinct context motifs, the best of each sheet first."""
    motif = fn.context_motif("value")
    found = cells.where(motif.isNotNull()).groupBy(*SHEET, "col").agg(
        F.count_distinct(motif).alias("n_motifs"), F.min("row").alias("first_row"), F.max("row").alias("last_row")
    ).where(F.col("n_motifs") >= least)
    w = Window.partitionBy(*SHEET).orderBy(F.desc("n_motifs"), "col")
    return found.withColumn("place", F.row_number().over(w))


def matrix_long(cells: DataFrame, transpose: bool = False) -> DataFrame:
    """SRC-14: (file, sheet, motif, response) of a 16 x 16 block of dinucleotide labels around values."""
    labels = cells.select(*SHEET, "row", "col", fn.dinucleotide("value").alias("label")).where("label is not null")
    at_side = Window.partitionBy(*SHEET, "col")
    at_top = Window.partitionBy(*SHEET, "row")
    rows = labels.withColumn("n", F.size(F.collect_set("label").over(at_side))).where("n >= 16").select(*SHEET, "row", F.col("label").alias("r"))
    tops = labels.withColumn("n", F.size(F.collect_set("label").over(at_top))).where("n >= 16").select(*SHEET, "col", F.col("label").alias("c"))
    values = cells.select(*SHEET, "row", "col", fn.to_number("value").alias("x")).where("x is not null")
    joined = values.join(rows, [*SHEET, "row"]).join(tops, [*SHEET, "col"])
    first, second = ("c", "r") if transpose else ("r", "c")
    return joined.groupBy(*SHEET, F.concat(F.col(first), F.lit("U"), F.col(second)).alias("motif")).agg(F.avg("x").alias("response"))


def oriented_matrix(cells: DataFrame, least: tuple[int, int] = (5, 20)) -> DataFrame:
    """SRC-14: each sheet's matrix in the orientation with the greater +1U effect (ST-26); rows first on a tie.

    Columns: file, sheet, motif, response, orientation and effect.
    """
    from ..operators.stats import plus_one_effect

    both = matrix_long(cells).withColumn("orientation", F.lit("rows_first")).unionByName(
        matrix_long(cells, transpose=True).withColumn("orientation", F.lit("columns_first"))
    )
    flagged = both.withColumn("__u", F.col("motif").rlike("^...U"))
    effects = plus_one_effect(flagged, "response", "__u", least, [*SHEET, "orientation"])
    best = F.max_by(F.struct("orientation", "effect"), F.struct(F.coalesce("effect", F.lit(float("-inf"))), F.col("orientation")))
    chosen = effects.groupBy(*SHEET).agg(best.alias("b")).select(*SHEET, "b.*")
    return both.join(chosen, [*SHEET, "orientation"])


def choose_response(headers: DataFrame, weights: dict[str, float], n_valid: str, n_motifs: str) -> DataFrame:
    """SRC-15: per sheet the column with the best positive header score among those covering max(50, half) of the motifs.

    ``weights`` maps patterns to scores; a sheet without such a column is RESPONSE_UNRESOLVED.
    """
    score = sum((F.when(F.lower("name").rlike(p), w).otherwise(0.0) for p, w in weights.items()), F.lit(0.0))
    enough = F.col(n_valid) >= F.greatest(F.lit(50.0), F.col(n_motifs) * 0.5)
    good = headers.withColumn("header_score", score).withColumn("ok", enough & (F.col("header_score") > 0))
    best = F.max_by(F.when(F.col("ok"), F.struct("name", "header_score")), F.when(F.col("ok"), F.struct("header_score", F.col(n_valid), -F.col("col"))))
    out = good.groupBy(*SHEET).agg(best.alias("b")).select(*SHEET, "b.name", "b.header_score")
    return out.withColumn("status", F.when(F.col("name").isNull(), "RESPONSE_UNRESOLVED").otherwise("RESOLVED"))


def anchor_score(candidates: DataFrame, group: list[str], value: str, n_anchor: int = 230, mean_anchor: float = 0.876, level: float = 0.85) -> DataFrame:
    """SRC-16: candidates by their distance from published anchors: -|n over level - n| / 5 - 20 |mean - anchor|."""
    per = candidates.groupBy(*group).agg(F.count_if(F.col(value) > level).alias("n_high"), F.avg(value).alias("mean"))
    return per.withColumn("anchor_score", -F.abs(F.col("n_high") - n_anchor) / 5 - 20 * F.abs(F.col("mean") - mean_anchor))


def best_anchored(scored: DataFrame, group: list[str], candidate: str) -> DataFrame:
    """SRC-16: per group the candidate with the best anchor score; ties go to the smaller candidate."""
    rest = [c for c in scored.columns if c not in group]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("anchor_score"), F.col(candidate)))
    return scored.groupBy(*group).agg(best.alias("b")).select(*group, "b.*") if group else scored.agg(best.alias("b")).select("b.*")


def base_window(df: DataFrame, columns: list[str]) -> list[str] | None:
    """SRC-18: the first five neighbouring columns that hold bases, the middle one U or T; None if there are none."""
    share = lambda c, letters: F.avg(F.upper(F.trim(F.col(f"`{c}`"))).isin(*letters).cast("double"))
    row = df.agg(*[x for i, c in enumerate(columns) for x in (share(c, "ACGTU").alias(f"b{i}"), share(c, "TU").alias(f"u{i}"))]).first()
    for i in range(len(columns) - 4):
        if all((row[f"b{j}"] or 0) >= BASE_SHARE for j in range(i, i + 5)) and (row[f"u{i + 2}"] or 0) >= CENTRE_SHARE:
            return columns[i : i + 5]
    return None


def identifier_audit(df: DataFrame, columns: list[str], maps: dict[str, DataFrame], least: float = 0.30) -> DataFrame:
    """SRC-19: share of each column's distinct values found in each identifier map (one column, ``id``), over all rows.

    ``usable`` marks shares of at least ``least``.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.upper(fn.strip_version(F.col(c).cast("string"))).alias("id")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.*").where("id <> ''").distinct()
    known = reduce(DataFrame.unionByName, [m.select(F.upper(fn.strip_version("id")).alias("id"), F.lit(k).alias("id_type")).distinct() for k, m in maps.items()])
    total = values.groupBy("column").agg(F.count("*").alias("n_values"))
    hits = values.join(known, "id").groupBy("column", "id_type").agg(F.count("*").alias("n_hits"))
    out = hits.join(total, "column").withColumn("share", F.col("n_hits") / F.col("n_values"))
    return out.withColumn("usable", F.col("share") >= least)


def map_identifiers(df: DataFrame, column: str, mapping: DataFrame, out: str = "gene") -> DataFrame:
    """SRC-20, FN-37: ``df`` with the gene of an identifier, with or without version; ``mapping`` has id and gene, one per id."""
    key = F.upper(fn.strip_version(F.col(column).cast("string")))
    names = mapping.groupBy(F.upper(fn.strip_version("id")).alias("__id")).agg(F.min("gene").alias(out), F.count_distinct("gene").alias("__n"))
    joined = df.withColumn("__id", key).join(names.where("__n = 1").drop("__n"), "__id", "left")
    return joined.drop("__id")


def gene_tokens(df: DataFrame, column: str, genes: DataFrame, key: str) -> DataFrame:
    """FN-37: (key, gene): the whole value if it is a gene, else the only gene among its tokens; null otherwise."""
    value = F.upper(fn.safe_text(column))
    known = genes.select(F.upper("gene").alias("token"), "gene").dropDuplicates(["token"])
    tokens = F.array_distinct(F.concat(F.array(value), F.regexp_extract_all(value, F.lit(r"[A-Z0-9][A-Z0-9.-]*"), F.lit(0))))
    spread = df.select(key, value.alias("whole"), F.explode(tokens).alias("token")).join(known, "token")
    per = spread.groupBy(key).agg(F.max(F.when(F.col("token") == F.col("whole"), F.col("gene"))).alias("exact"), F.min("gene").alias("one"), F.count_distinct("gene").alias("n"))
    gene = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    return df.join(per.select(key, gene.alias("gene")), key, "left").select(key, "gene")


def rows_of_cell_line(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """SRC-21: rows that name the cell line in the column that names it most often; none if no column does."""
    pattern = rf"(?i)\b{name}\b"
    row = df.agg(*[F.count_if(F.col(c).cast("string").rlike(pattern)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    best = max(range(len(columns)), key=lambda i: (row[f"n{i}"], -i))
    return df.where(F.col(columns[best]).cast("string").rlike(pattern)) if row[f"n{best}"] else df.limit(0)


def coordinate_columns(df: DataFrame, columns: list[str], least: float = 0.9) -> dict:
    """SRC-22: a combined locus column, or chromosome and position columns, each valid in ``least`` of its values; or unresolved."""
    value = lambda c: fn.safe_text(F.col(c).cast("string"))
    share = lambda c, p: F.avg(F.when(value(c) != "", value(c).rlike(p).cast("double")))
    kinds = {"locus": r"^chr[^:_]+[:_]\d+", "chrom": r"^(?:chr)?(?:\d{1,2}|X|Y|MT?)$", "pos": r"^\d{4,}$"}
    row = df.agg(*[share(c, p).alias(f"{k}{i}") for i, c in enumerate(columns) for k, p in kinds.items()]).first()
    best = {k: max(range(len(columns)), key=lambda i: (row[f"{k}{i}"] or 0, -i)) for k in kinds}
    good = {k: columns[i] for k, i in best.items() if (row[f"{k}{i}"] or 0) >= least}
    if "locus" in good:
        return {"status": "COMBINED_LOCUS", "locus": good["locus"]}
    if {"chrom", "pos"} <= set(good):
        return {"status": "CHROM_POS", "chrom": good["chrom"], "pos": good["pos"]}
    return {"status": "COORDINATES_UNRESOLVED"}


def distinct_columns(df: DataFrame, key: str, columns: list[str]) -> list[str]:
    """SRC-23: the columns without those that repeat an earlier one, by an order-free sum of hashes of (key, value).

    Repeated rows add up, so a column differs from another as soon as their (key, value) counts do.
    """
    total = lambda c: F.sum(F.xxhash64(key, F.col(c).cast("double")).cast("decimal(28,0)"))
    row = df.agg(*[total(c).alias(f"h{i}") for i, c in enumerate(columns)]).first()
    seen: dict = {}
    return [c for i, c in enumerate(columns) if seen.setdefault(row[f"h{i}"], c) == c]


#: The call table's columns; ``raw`` keeps what a source has besides.
CALLS = ["dataset_id", "assay", "cell_line", "chrom", "strand", "pos1", "source_start", "source_end", "base_locus_id", "gene", "motif", "signal", "confidence_raw", "raw"]


def normalise_calls(df: DataFrame, dataset_id: str, assay: str, cell_line: str, columns: dict[str, str], motif_columns: list[str] = ()) -> DataFrame:
    """SRC-24, 28, 29: a published table in the shape of ``CALLS``.

    ``columns`` names the source's chrom, strand, pos (the base itself), start, end, gene, motif,
    signal and confidence where it has them. Without a ``pos`` the end of a one-base interval is
    the position; without either it stays unknown. A motif may come as five base columns.
    """
    get = lambda k: F.col(f"`{columns[k]}`").cast("string") if k in columns else F.lit(None).cast("string")
    end = fn.to_integer(get("end"))
    start = fn.to_integer(get("start"))
    pos = fn.to_integer(get("pos")) if "pos" in columns else F.when(end - start == 1, end)
    chrom = F.nullif(fn.chromosome(get("chrom")), F.lit(""))
    motif = fn.motif5(F.concat(*[F.col(f"`{c}`") for c in motif_columns])) if motif_columns else fn.motif5(get("motif"))
    used = set(columns.values()) | set(motif_columns)
    rest = [c for c in df.columns if c not in used]
    raw = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]) if rest else F.create_map().cast("map<string,string>")
    made = {
        "dataset_id": F.lit(dataset_id), "assay": F.lit(assay), "cell_line": F.lit(cell_line), "chrom": chrom, "strand": fn.strand(get("strand")),
        "pos1": pos, "source_start": start, "source_end": end, "base_locus_id": fn.locus_key(chrom, fn.strand(get("strand")), pos),
        "gene": fn.blank_to_null(get("gene")), "motif": motif, "signal": fn.to_number(get("signal")), "confidence_raw": fn.blank_to_null(get("confidence")), "raw": raw,
    }
    return df.select(*[made[c].alias(c) for c in CALLS])


def assay_context(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-28: normalised calls with a centred motif, their single-U flag and U-run fields; and QC counts per dataset and assay.

    Rows without a locus or such a motif are counted and left out.
    """
    centred = (F.length("motif") == 5) & (F.substring("motif", 3, 1) == "U")
    known = F.coalesce(centred, F.lit(False))
    placed = F.col("base_locus_id").isNotNull()
    counts = calls.groupBy("dataset_id", "assay").agg(
        F.count("*").alias("n_rows"), F.count_if(~placed).alias("n_without_locus"), F.count_if(~known).alias("n_without_motif"),
        F.count_if(known & placed).alias("n_kept"), F.count_if(known & placed & fn.single_u(F.col("motif"))).alias("n_single_u"),
        F.count_distinct(F.when(known & placed, F.col("base_locus_id"))).alias("n_loci"),
    )
    run = fn.u_run_interval(F.col("pos1"), F.col("strand"), F.col("motif"))
    kept = calls.where(known & placed).withColumn("single_u", fn.single_u(F.col("motif"))).withColumn("__run", run)
    fields = {"run_start": "start", "run_end": "end", "run_complete": "complete", "run_length": "length"}
    return kept.withColumns({k: F.col(f"__run.{v}") for k, v in fields.items()}).drop("__run"), counts


def positive_calls(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """SRC-29: distinct valid coordinates of rows that the source itself calls."""
    valid = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(fn.truthy(F.col(flag).cast("string")) & valid).select(*keys).distinct()


def positive_universe(df: DataFrame, key: str, motif: str, fraction: str, expected: int) -> DataFrame:
    """SRC-27: ``df`` with the percentile of the source's fraction; ValueError unless rows, keys and motifs are complete."""
    from ..operators.ranks import percentile_ranks

    row = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.count_if(F.col(motif).isNull()).alias("missing")).first()
    if row["n"] != expected or row["keys"] != expected or row["missing"]:
        raise ValueError(f"{row['n']} rows and {row['keys']} keys of {expected}, {row['missing']} without a motif")
    return percentile_ranks(df, fraction, out="fraction_percentile")


def header_above(cells: DataFrame, blocks: DataFrame, reach: int = 10) -> DataFrame:
    """SRC-31: for each block (file, sheet, col, first_row) the nearest text above it in its column, within ``reach`` rows."""
    text = fn.safe_text("value")
    near = cells.select(*SHEET, "col", "row", text.alias("header")).where((F.col("header") != "") & ~F.col("header").rlike(NUMBER))
    joined = blocks.join(near, [*SHEET, "col"]).where(F.col("row").between(F.col("first_row") - reach, F.col("first_row") - 1))
    return joined.groupBy(*SHEET, "col", "first_row").agg(F.max_by("header", "row").alias("header"))


def tokens_around(cells: DataFrame, blocks: DataFrame, tokens: list[str], reach: int = 8) -> DataFrame:
    """SRC-31: for each block (file, sheet, col, first_row) the tokens that cells within ``reach`` rows and columns hold."""
    text = F.upper(fn.safe_text("value"))
    named = cells.select(*SHEET, F.col("row").alias("__row"), F.col("col").alias("__col"), F.explode(F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, F.upper(t)))).alias("token"))
    near = blocks.join(named, SHEET).where((F.abs(F.col("__row") - F.col("first_row")) <= reach) & (F.abs(F.col("__col") - F.col("col")) <= reach))
    found = near.groupBy(*SHEET, "col", "first_row").agg(F.array_join(F.sort_array(F.collect_set("token")), "|").alias("tokens"))
    return blocks.select(*SHEET, "col", "first_row").join(found, [*SHEET, "col", "first_row"], "left")


def complete_calibration(df: DataFrame, motif: str, response: str, universe: int = 256) -> DataFrame:
    """SRC-30: the table itself if it has each of ``universe`` motifs with a number; ValueError if not."""
    row = df.agg(F.count_distinct(motif).alias("n"), F.count_if(F.col(response).isNull()).alias("missing")).first()
    if row["n"] != universe or row["missing"]:
        raise ValueError(f"{row['n']} motifs of {universe}, {row['missing']} without a response")
    return df


def ordinal_confidence(df: DataFrame, column: str) -> DataFrame:
    """SRC-32: ``df`` with label and ordinal; ValueError if a label can't be resolved."""
    out = df.withColumn("__c", fn.confidence(column)).withColumns({"confidence_label": F.col("__c.label"), "confidence": F.col("__c.ordinal")}).drop("__c")
    if (bad := out.where(F.col("confidence_label").startswith("unresolved:")).first()) is not None:
        raise ValueError(f"confidence {bad['confidence_label']}")
    return out


def site_parser_audit(df: DataFrame, column: str) -> DataFrame:
    """FN-19: sites, intervals by the strict and the tolerant parser, and distinct sites that the strict one misses."""
    strict, full = fn.parse_site_strict(column), fn.parse_site(column)
    parsed = df.select(F.col(column), strict.alias("s"), full.alias("f"))
    missed = F.col("s").isNull() & F.col("f.lo").isNotNull()
    return parsed.agg(
        F.count("*").alias("n"), F.count_if(F.col("s.interval") == 1).alias("strict_intervals"),
        F.count_if(F.col("f.interval") == 1).alias("tolerant_intervals"), F.count_distinct(F.when(missed, F.col(column))).alias("missed_sites"),
    )


def rescaled_fraction(df: DataFrame, column: str) -> DataFrame:
    """FN-25: a column divided by 100 if its median is above 1.5."""
    from ..operators.ranks import quantiles

    found = quantiles(df, [], column, {"m": 0.5}).first()
    median = found["m"] if found else None
    return df.withColumn(column, F.col(column) / 100) if median is not None and median > 1.5 else df
