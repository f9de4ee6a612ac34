"""Queries of sources, ingest and scalars: files written and read back, cell tables, discovery of columns, call tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import sequence as sq
from ..operators import loci
from ..operators.storage import shared_dir
from ..sources import files, ingest
from .mapping import calls, table, union
from .more import _motifs, site_texts
from .queries import query


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""select c_custkey as id, c_name as name, null::varchar as tags, c_acctbal as balance from customer
 union all select s_suppkey, s_name, s_name || '|' || s_nationkey, null from supplier""", "balance", mapped=False)
def delimited_round_trip(spark, sf):
    """SRC-01, 02, AGG-13: two tables under the union of their columns, written with a header and read back."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array("s_name", F.col("s_nationkey").cast("string")).alias("tags")
    )
    path = _path(spark, "delimited")
    files.write_table(files.union_rows(c, s).select("id", "name", "tags", "balance"), path)
    return files.read_table(spark, path, "id long, name string, tags string, balance double")


@query("select 'customer' as part, count(*) as n, min(c_name) as first from customer union all select 'supplier', count(*), min(s_name) from supplier", mapped=False)
def contract_round_trip(spark, sf):
    """SRC-03: a stage's summary as one JSON document, read back."""
    c = table(spark, sf, "customer").agg(F.count("*").alias("n"), F.min("c_name").alias("first")).first()
    s = table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.min("s_name").alias("first")).first()
    path = _path(spark, "contract")
    files.write_contract(spark, {"customer": c.asDict(), "supplier": s.asDict()}, path)
    read = spark.read.text(path).select(F.from_json("value", "map<string, struct<n: bigint, first: string>>").alias("m"))
    return read.select(F.explode("m").alias("part", "v")).select("part", "v.*")


_LINES = """ln as (
  select l_orderkey as o, l_linenumber as n, l_partkey as p, case l_linenumber % 3 when 0 then 'CDS' else 'exon' end as feature,
    case when l_orderkey % 11 = 0 then 'x' else (l_partkey * 10)::varchar end as a, (l_partkey * 10 + l_linenumber)::varchar as b,
    case l_returnflag when 'A' then '+' else '-' end as strand, l_orderkey % 7 = 0 as short
  from lineitem)"""


def _annotation(spark, sf) -> str:
    """Lines of an annotation file: comments, short lines and coordinates that are no integers among them."""
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    full = F.concat_ws(
        "\t", F.lit("NC_000001.11"), F.lit("s"), F.when(n % 3 == 0, "CDS").otherwise("exon"), F.when(o % 11 == 0, "x").otherwise(text(p * 10)), text(p * 10 + n),
        F.lit("."), F.when(F.col("l_returnflag") == "A", "+").otherwise("-"), F.lit("."), F.concat(F.lit('gene "g'), text(p), F.lit('"; transcript_id "t'), text(o), F.lit('";')),
    )
    short = F.concat_ws("\t", F.lit("NC_000001.11"), F.lit("s"), F.lit("exon"))
    lines = F.explode(F.array(F.lit("#comment"), F.when(o % 7 == 0, short).otherwise(full)))
    path = _path(spark, "annotation")
    table(spark, sf, "lineitem").select(lines.alias("value")).write.text(path)
    return path


@query(f"""with {_LINES} select 'chr1' as chrom, a::bigint as "start", b::bigint as "end", strand, 'g' || p as gene, 't' || o as tx, count(*) as n_lines
 from ln where not short and feature = 'exon' and a <> 'x' group by all""", mapped=False)
def annotation_scan(spark, sf):
    """SRC-04, FN-06, 07, 21, 22: exons of an annotation file with their genes."""
    rows = files.read_annotation(spark, _annotation(spark, sf))
    a = fn.attributes(F.col("attributes"))
    parsed = rows.select(
        fn.chromosome_of_accession("seqname").alias("chrom"), "start", "end", fn.strand("strand").alias("strand"), fn.gene_symbol(a).alias("gene"), fn.transcript_id(a).alias("tx")
    )
    return parsed.groupBy(*parsed.columns).agg(F.count("*").alias("n_lines"))


@query(f"with {_LINES} select count(*) as n, count_if(short)::bigint as n_short, count_if(not short and a = 'x')::bigint as n_bad_coordinates from ln", mapped=False)
def annotation_quality(spark, sf):
    """SRC-04: what the scan leaves out."""
    lines = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(files.GTF).csv(_annotation(spark, sf))
    return files.annotation_quality(lines)


@query("""select 'd' || doc_id || '.1' as accession, replace(regexp_replace(upper(text), '[^ACGTU]', '', 'g'), 'U', 'T') as seq from documents where lang = 'en'""", mapped=False)
def fasta_scan(spark, sf):
    """SRC-05: the sequences of some accessions of a wrapped FASTA file, named without their versions."""
    docs = table(spark, sf, "documents")
    letters = F.regexp_replace(F.upper("text"), "[^ACGTU]", "")
    record = F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(".1 of a document, A->G > it\n"), F.regexp_replace(letters, "(.{60})", "$1\n"))
    path = _path(spark, "fasta")
    docs.select(record.alias("value")).write.text(path)
    return files.read_fasta(spark, path, docs.where("lang = 'en'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("accession")))


@query("""with s as (select 'd' || doc_id || '.1' as accession, replace(regexp_replace(upper(text), '[^ACGTU]', '', 'g'), 'U', 'T') as s from documents),
 w as (select accession, length(s) as n, unnest(list_transform(range(1, greatest(length(s) - 4, 1)), lambda i: substr(s, i, 6))) as kmer from s)
 select accession, kmer, count(*) as n, count(*) / (max(n) - 5)::double as frequency from w group by 1, 2""", "frequency", mapped=False)
def fasta_kmers(spark, sf):
    """SRC-05, FN-29: 6-mers of the sequences of a FASTA file, read and counted in pieces of 500 letters."""
    docs = table(spark, sf, "documents")
    letters = F.regexp_replace(F.regexp_replace(F.upper("text"), "[^ACGTU]", ""), "(.{60})", "$1\n")
    path = _path(spark, "fasta")
    docs.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(".1 > of\n"), letters).alias("value")).write.text(path)
    chunks = files.fasta_chunks(spark, path, 500)
    return sq.chunk_kmers(chunks, 6, "accession")


@query("""with f as (
  select l_returnflag || l_linestatus as name, string_agg(k || chr(10), '' order by k) as body
  from (select *, (l_orderkey * 10 + l_linenumber) || ':' || l_partkey || ':' || l_suppkey || ':' || floor(l_extendedprice)::bigint as k from lineitem) group by 1)
 select name, octet_length(encode(body))::bigint as bytes, sha256(body) as found_sha256,
  case name when 'AF' then 'HASH_OK' when 'NF' then 'HASH_MISMATCH' else 'PRESENT' end as status from f
 union all select 'none', null, null, 'MISSING'""", mapped=False)
def file_manifest(spark, sf):
    """SRC-06: sizes, hashes and status of one file per flag and status of a line."""
    key = F.concat(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit(":"), "l_partkey", F.lit(":"), "l_suppkey", F.lit(":"), F.floor("l_extendedprice"))
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), key.alias("value"))
    path = _path(spark, "assets")
    rows.repartition("name").sortWithinPartitions("name", "value").write.partitionBy("name").text(path)
    name = F.regexp_extract("path", "name=([^/]+)/", 1)
    known = files.manifest(spark, path, name=name).where("name = 'AF'").select("name", F.col("found_sha256").alias("sha256"))
    expected = known.unionByName(spark.createDataFrame([("NF", "0"), ("none", "1")], "name string, sha256 string"))
    return files.manifest(spark, path, expected, name=name).select("name", "bytes", "found_sha256", "status")


_GRID = """mt as (
  select l_suppkey % 10 as sheet, l_linenumber as col, l_orderkey as "row", substr('ACGU', 1 + (l_partkey % 4)::int, 1) || substr('ACGUU', 1 + (l_suppkey % 5)::int, 1)
    || 'U' || substr('UUCGA', 1 + ((l_partkey // 4) % 5)::int, 1) || substr('ACGU', 1 + (l_orderkey % 4)::int, 1) as motif from lineitem)"""


@query(f"""with {_GRID}, c as (select sheet, col, count(distinct motif) as n_motifs, min("row") as first_row, max("row") as last_row from mt group by 1, 2 having count(distinct motif) >= 10)
 select 'f' as file, *, row_number() over (partition by sheet order by n_motifs desc, col) as place from c""", mapped=False)
def motif_columns(spark, sf):
    """SRC-13: the columns of cell tables that hold motifs."""
    m = _motifs(spark, sf).select(
        F.lit("f").alias("file"), (F.col("pos") % 10).alias("sheet"), F.floor(F.col("id") / 10).alias("row"), F.col("line").alias("col"),
        F.concat(F.lit(" "), F.lower("motif")).alias("value"),
    )
    return ingest.motif_columns(m, 10).withColumn("place", F.col("place").cast("long"))


_PAIRS = [a + b for a in fn.BASES for b in fn.BASES]
_MATRIX = """v as (
  select l_suppkey % 5 as sheet, (l_partkey % 16) as i, (l_orderkey % 16) as j, avg(l_quantity) as x from lineitem group by 1, 2, 3),
 lb as (select substr('ACGU', 1 + (k // 4)::int, 1) || substr('ACGU', 1 + (k % 4)::int, 1) as label, k from range(16) t(k)),
 b as (
  select sheet, 'rows_first' as orientation, r.label || 'U' || c.label as motif, x from v join lb r on r.k = i join lb c on c.k = j
  union all select sheet, 'columns_first', c.label || 'U' || r.label, x from v join lb r on r.k = i join lb c on c.k = j)"""


def _matrix(spark, sf):
    """Blocks of 16 by 16 means between dinucleotide labels."""
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("sheet"), (F.col("l_partkey") % 16).alias("i"), (F.col("l_orderkey") % 16).alias("j"), "l_quantity")
    values = rows.groupBy("sheet", "i", "j").agg(F.avg("l_quantity").cast("string").alias("value"))
    body = values.select("sheet", (F.col("i") + 1).alias("row"), (F.col("j") + 1).alias("col"), "value")
    sheets = body.select("sheet").distinct().select("sheet", F.posexplode(F.array(*[F.lit(p) for p in _PAIRS])).alias("k", "value"))
    k = F.col("k").cast("long") + 1
    top, side = sheets.select("sheet", F.lit(0).cast("long").alias("row"), k.alias("col"), "value"), sheets.select("sheet", k.alias("row"), F.lit(0).cast("long").alias("col"), "value")
    return body.unionByName(top).unionByName(side).select(F.lit("f").alias("file"), "sheet", "row", "col", "value")


@query(f"with {_MATRIX} select 'f' as file, sheet, motif, x as response from b where orientation = 'rows_first'", "response", mapped=False)
def matrix_long(spark, sf):
    return ingest.matrix_long(_matrix(spark, sf))


@query(f"""with {_MATRIX}, w as (select sheet, orientation, least(min(x), 0) as low from b group by 1, 2),
 e as (
  select b.sheet, b.orientation, quantile_cont(ln(1 + x - low), .5) filter (where motif[4] = 'U') - quantile_cont(ln(1 + x - low), .5) filter (where motif[4] <> 'U') as effect
  from b join w on b.sheet = w.sheet and b.orientation = w.orientation group by 1, 2),
 o as (select *, row_number() over (partition by sheet order by effect desc nulls last, orientation desc) as i from e)
 select 'f' as file, b.sheet, b.orientation, motif, x as response, effect from b join o on b.sheet = o.sheet and b.orientation = o.orientation and i = 1""",
       "response effect", mapped=False)
def oriented_matrix(spark, sf):
    """SRC-14: the orientation with the greater +1U effect."""
    return ingest.oriented_matrix(_matrix(spark, sf))


@query("""with h as (
  select l_suppkey % 8 as sheet, l_linenumber as col, case l_linenumber % 4 when 0 then 'Psi level' when 1 then 'p-value' when 2 then 'signal level' else 'note' end as name,
    count(*) as n_valid, count(distinct l_partkey) as n_motifs from lineitem group by 1, 2),
 s as (select *, (case when lower(name) like '%psi%' then 3.0 else 0 end + case when lower(name) like '%level%' then 1.0 else 0 end - case
    when lower(name) like 'p-value%' then 5.0 else 0 end)::double as header_score from h),
 g as (select *, row_number() over (partition by sheet order by header_score desc, n_valid desc, col) as i from s where n_valid >= greatest(50.0, n_motifs * .5) and header_score > 0)
 select 'f' as file, h.sheet, g.name, g.header_score, case when g.name is null then 'RESPONSE_UNRESOLVED' else 'RESOLVED' end as status
 from (select distinct sheet from h) h left join g on h.sheet = g.sheet and i = 1""", "header_score", mapped=False)
def response_columns(spark, sf):
    """SRC-15: the response column of each sheet by the score of its header."""
    n = F.col("l_linenumber")
    name = F.when(n % 4 == 0, "Psi level").when(n % 4 == 1, "p-value").when(n % 4 == 2, "signal level").otherwise("note")
    heads = table(spark, sf, "lineitem").groupBy(F.lit("f").alias("file"), (F.col("l_suppkey") % 8).alias("sheet"), n.alias("col"), name.alias("name")).agg(
        F.count("*").alias("n_valid"), F.count_distinct("l_partkey").alias("n_motifs")
    )
    return ingest.choose_response(heads, {"psi": 3.0, "level": 1.0, "^p-value": -5.0}, "n_valid", "n_motifs")


@query("""with c as (select l_returnflag as g, l_linenumber as candidate, count_if(l_quantity / 50 > .85)::bigint as n_high, avg(l_quantity / 50) as mean from lineitem group by 1, 2),
 s as (select *, -abs(n_high - 230) / 5 - 20 * abs(mean - .876) as anchor_score from c), o as (select *, row_number() over (partition by g order by anchor_score desc, candidate) as i from s)
 select g, candidate, n_high, mean, anchor_score from o where i = 1""", "mean anchor_score", mapped=False)
def anchored_candidates(spark, sf):
    """SRC-16: per group the candidate nearest the published anchors."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("candidate"), (F.col("l_quantity") / 50).alias("v"))
    return ingest.best_anchored(ingest.anchor_score(rows, ["g", "candidate"], "v"), ["g"], "candidate")


_COLUMNS = "[strand, motif[1], motif[2], case when pos % 50 = 0 then 'N' else motif[3] end, motif[4], motif[5], motif[1]]"


@query("""with m as (
  select l_suppkey as pos, case l_returnflag when 'A' then '+' when 'N' then '-' else '.' end as strand, substr('ACGU', 1 + (l_partkey % 4)::int, 1) || substr('ACGUU', 1 + (l_suppkey % 5)::int, 1)
   || 'U' || substr('UUCGA', 1 + ((l_partkey // 4) % 5)::int, 1) || substr('ACGU', 1 + (l_orderkey % 4)::int, 1) as motif from lineitem),
 l as (select unnest(range(7)) as i, unnest(""" + _COLUMNS + """) as v from m),
 s as (select i, avg((v in ('A', 'C', 'G', 'T', 'U'))::int) >= .9 as base, avg((v in ('T', 'U'))::int) >= .9 as mid from l group by 1),
 w as (select min(a.i) as i from s a where a.i <= 2 and (select bool_and(base) from s b where b.i between a.i and a.i + 4) and (select mid from s c where c.i = a.i + 2))
 select case when i is null then null else 'c' || i || '|c' || (i + 1) || '|c' || (i + 2) || '|c' || (i + 3) || '|c' || (i + 4) end as columns from w""", mapped=False)
def base_window(spark, sf):
    """SRC-18: the columns that spell a motif."""
    at = lambda i: F.substring("motif", i, 1)
    cells = [F.col("strand"), at(1), at(2), F.when(F.col("pos") % 50 == 0, "N").otherwise(at(3)), at(4), at(5), at(1)]
    rows = _motifs(spark, sf).select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    found = ingest.base_window(rows, rows.columns)
    return spark.createDataFrame([("|".join(found) if found else None,)], "columns string")


@query("""with r as (select o_orderkey as k, case when o_custkey % 3 = 0 then 'A549 cells' else 'K562' end as a, case o_orderstatus when 'F' then 'in a549'
    when 'O' then 'A5490' else '' end as b from orders),
 n as (select count_if(regexp_matches(a, '(?i)\\bA549\\b')) as na, count_if(regexp_matches(b, '(?i)\\bA549\\b')) as nb from r)
 select k, a, b from r, n where regexp_matches(case when na >= nb then a else b end, '(?i)\\bA549\\b')""".replace("\\\\", "\\"), mapped=False)
def rows_of_cell_line(spark, sf):
    """SRC-21: rows of a cell line by the column that names it most."""
    a = F.when(F.col("o_custkey") % 3 == 0, "A549 cells").otherwise("K562")
    b = F.when(F.col("o_orderstatus") == "F", "in a549").when(F.col("o_orderstatus") == "O", "A5490").otherwise("")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), a.alias("a"), b.alias("b"))
    return ingest.rows_of_cell_line(rows, ["a", "b"], "A549")


@query("""with v as (select case when o_custkey % 20 = 0 then 'scaffold' else 'chr' || (o_custkey % 22 + 1) end as c, (o_orderkey + 10000)::varchar as p, o_orderstatus as s from orders)
 select case when avg(regexp_full_match(c, '(?:chr)?(?:\\d{1,2}|X|Y|MT?)')::int) >= .9 and avg(regexp_full_match(p, '\\d{4,}')::int) >= .9 then 'CHROM_POS' else 'COORDINATES_UNRESOLVED' end as status,
  'c' as chrom, 'p' as pos from v""".replace("\\\\", "\\"), mapped=False)
def coordinate_columns(spark, sf):
    """SRC-22: chromosome and position columns of a table without names."""
    c = F.when(F.col("o_custkey") % 20 == 0, "scaffold").otherwise(F.concat(F.lit("chr"), (F.col("o_custkey") % 22 + 1).cast("string")))
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") + 10000).cast("string").alias("p"), c.alias("c"))
    got = ingest.coordinate_columns(rows, rows.columns)
    return spark.createDataFrame([(got["status"], got.get("chrom"), got.get("pos"))], "status string, chrom string, pos string")


@query("""with l as (
  select p_partkey as k, unnest(['p_size', 'p_retailprice', 'again', 'twice', 'price']) as name, unnest([0, 1, 2, 3, 4]) as i,
    unnest([p_size::double, p_retailprice::double, (p_size + 0)::double, (p_size * 2)::double, p_retailprice::double]) as v from part),
 same as (select a.i from l a join l b on a.k = b.k and b.i < a.i group by a.i, b.i having bool_and(a.v is not distinct from b.v))
 select distinct name as "column" from l where i not in (select i from same)""", mapped=False)
def distinct_columns(spark, sf):
    """SRC-23: value columns without repetitions of earlier ones."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", (F.col("p_size") + 0).alias("again"), (F.col("p_size") * 2).alias("twice"), F.col("p_retailprice").alias("price"))
    kept = ingest.distinct_columns(part, "p_partkey", ["p_size", "p_retailprice", "again", "twice", "price"])
    return spark.createDataFrame([(c,) for c in kept], '"column" string'.replace('"', "`"))


_SOURCE = """sr as (
  select l_orderkey * 10 + l_linenumber as id, case l_linenumber % 3 when 0 then 'chr' || (l_suppkey % 9) when 1 then (l_suppkey % 9)::varchar else 'MT' end as chr,
    case l_returnflag when 'A' then '+' when 'N' then '-' else '?' end as strand, l_partkey * 10 as s, l_partkey * 10 + case when l_orderkey % 5 = 0 then 2 else 1 end as e,
    case when l_orderkey % 9 = 0 then null else substr('ACGU', 1 + (l_partkey % 4)::int, 1) || substr('ACGUU', 1 + (l_suppkey % 5)::int, 1) || 'Ψ' || substr('UUCGA', 1 + ((l_partkey // 4) % 5)::int, 1) || substr('acgt', 1 + (l_orderkey % 4)::int, 1) end as motif,
    case when l_discount > 0.05 then l_discount || '%' else 'na' end as level, case l_tax when 0.0 then 'Highest' when 0.01 then 'higher' when 0.02 then 'lower' else ' ' end as conf from lineitem),
 nc as (
  select id, case chr when 'MT' then 'chrM' else case when chr like 'chr%' then chr else 'chr' || chr end end as chrom, case when strand in ('+', '-') then strand end as strand,
    case when e - s = 1 then e end as pos1, s as source_start, e as source_end, replace(replace(upper(motif), 'Ψ', 'U'), 'T', 'U') as motif,
    try_cast(replace(level, '%', '') as double) as signal, nullif(trim(conf), '') as confidence_raw from sr)"""


def _source(spark, sf):
    """A published table with blanks, percent signs, spellings of chromosomes and intervals of one and two bases."""
    o, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    pick = lambda letters, c: F.substr(F.lit(letters), (1 + c).cast("int"), F.lit(1))
    chrom = F.when(n % 3 == 0, F.concat(F.lit("chr"), (s % 9).cast("string"))).when(n % 3 == 1, (s % 9).cast("string")).otherwise("MT")
    motif = F.concat(pick("ACGU", p % 4), pick("ACGUU", s % 5), F.lit("Ψ"), pick("UUCGA", F.floor(p / 4) % 5), pick("acgt", o % 4))
    tax = F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        (o * 10 + n).alias("id"), chrom.alias("chr"), F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "N", "-").otherwise("?").alias("strand"),
        (p * 10).alias("start"), (p * 10 + F.when(o % 5 == 0, 2).otherwise(1)).alias("end"), F.when(o % 9 != 0, motif).alias("motif"),
        F.when(F.col("l_discount") > 0.05, F.concat(F.col("l_discount").cast("string"), F.lit("%"))).otherwise("na").alias("level"),
        F.when(tax == 0.0, "Highest").when(tax == 0.01, "higher").when(tax == 0.02, "lower").otherwise(" ").alias("conf"),
    )


def _normalised(spark, sf):
    names = {"chrom": "chr", "strand": "strand", "start": "start", "end": "end", "motif": "motif", "signal": "level", "confidence": "conf"}
    return ingest.normalise_calls(_source(spark, sf), "d1", "ELAP", "HeLa", names)


@query(f"""with {_SOURCE} select 'd1' as dataset_id, 'ELAP' as assay, 'HeLa' as cell_line, chrom, strand, pos1, source_start, source_end,
 case when strand is not null and pos1 is not null then chrom || ':' || strand || ':' || pos1 end as base_locus_id, null::varchar as gene, motif, signal, confidence_raw, id::varchar as raw_id from nc""", "signal", mapped=False)
def normalised_calls(spark, sf):
    """SRC-24, FN-05, 07, 08, 15: a published table in the shape of a call table."""
    return _normalised(spark, sf).withColumn("raw_id", F.element_at("raw", "id")).drop("raw")


_RUNS = """lf as (select *, length(regexp_extract(substr(motif, 1, 2), '(U*)$', 1)) as lf, length(regexp_extract(substr(motif, 4, 2), '^(U*)', 1)) as rt from nc)"""


@query(f"""with {_SOURCE}, {_RUNS} select id::varchar as raw_id, chrom || ':' || strand || ':' || pos1 as base_locus_id, motif, regexp_full_match(motif, '.[ACG]U[ACG].') as single_u,
 case when strand = '+' then pos1 - lf else pos1 - rt end as run_start, case when strand = '+' then pos1 + rt
    else pos1 + lf end as run_end, lf < 2 and rt < 2 as run_complete, lf + rt + 1 as run_length
 from lf where strand is not null and pos1 is not null and motif is not null""", mapped=False)
def assay_context(spark, sf):
    """SRC-28, FN-12, 14: calls with a centred motif and their U-run."""
    rows = ingest.assay_context(_normalised(spark, sf))[0].withColumn("raw_id", F.element_at("raw", "id"))
    return rows.select("raw_id", "base_locus_id", "motif", "single_u", "run_start", "run_end", "run_complete", F.col("run_length").cast("long").alias("run_length"))


@query(f"""with {_SOURCE}, k as (select *, strand is not null and pos1 is not null as placed, motif is not null as known from nc)
 select 'd1' as dataset_id, 'ELAP' as assay, count(*) as n_rows, count_if(not placed)::bigint as n_without_locus,
    count_if(not known)::bigint as n_without_motif, count_if(placed and known)::bigint as n_kept,
  count_if(placed and known and regexp_full_match(motif, '.[ACG]U[ACG].'))::bigint as n_single_u, count(distinct case
    when placed and known then chrom || strand || pos1 end) as n_loci from k""", mapped=False)
def assay_counts(spark, sf):
    """SRC-28: what the context loader kept and left out."""
    return ingest.assay_context(_normalised(spark, sf))[1]


@query(f"with {_SOURCE} select distinct chrom, strand, pos1 from nc where chrom is not null and strand is not null and pos1 is not null and signal > 0", mapped=False)
def positive_calls(spark, sf):
    """SRC-29: distinct coordinates that the source itself calls."""
    rows = _normalised(spark, sf).withColumn("flag", F.coalesce(F.col("signal"), F.lit(0.0)).cast("string"))
    return ingest.positive_calls(rows, "flag", ["chrom", "strand", "pos1"])


@query("""select p_partkey as key, p_type as motif, p_size as fraction, (rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0) / count(*) over () as fraction_percentile from part""", "fraction_percentile", mapped=False)
def positive_universe(spark, sf):
    """SRC-27: a complete universe with the percentile of its fraction."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("motif"), F.col("p_size").alias("fraction"))
    return ingest.positive_universe(part, "key", "motif", "fraction", part.count())


@query("select motif, avg(score) as response from u group by 1", "response")
def complete_calibration(spark, sf):
    """SRC-30: a response for each motif of the universe."""
    u = union(spark, sf)
    table_ = u.groupBy("motif").agg(F.avg("score").alias("response"))
    return ingest.complete_calibration(table_, "motif", "response", u.select("motif").distinct().count())


@query(f"""with {_SOURCE} select id, case confidence_raw when 'Highest' then 'highest' else confidence_raw end as confidence_label,
 case confidence_raw when 'Highest' then 3.0 when 'higher' then 2.0 when 'lower' then 1.0 end::double as confidence from nc""", mapped=False)
def ordinal_confidence(spark, sf):
    """SRC-32, FN-23: labels of confidence as ordinals."""
    return ingest.ordinal_confidence(_source(spark, sf).select("id", "conf"), "conf").select("id", "confidence_label", "confidence")


@query("""with b as (select l_suppkey % 6 as sheet, l_linenumber as col, 5 + (l_suppkey % 3) as first_row from lineitem
    group by all), h as (select sheet, col, first_row - 2 as r, 'Head ' || col as v from b union all select sheet, col, first_row - 4, 'far' from b
  union all select sheet, col, first_row - 1, '12' from b), t as (select sheet, col, first_row, max_by(v, r) as header from (select b.*, h.r, h.v from b
    join h on b.sheet = h.sheet and b.col = h.col where r between first_row - 3 and first_row - 1 and v <> '12') group by 1, 2, 3)
 select 'f' as file, sheet, col, first_row, header from t""", mapped=False)
def headers_above(spark, sf):
    """SRC-31: the text above each block."""
    blocks, cells = _blocks(spark, sf)
    return ingest.header_above(cells, blocks, 3)


@query("""with b as (select l_suppkey % 6 as sheet, l_linenumber as col, 5 + (l_suppkey % 3) as first_row from lineitem group by all),
 n as (select sheet, col as c, first_row - 4 as r, 'FAR' as t from b union all select sheet, col, first_row - 2, 'HEAD' from b)
 select 'f' as file, b.sheet, b.col, b.first_row, string_agg(distinct t, '|' order by t) as tokens from b left
    join n on n.sheet = b.sheet and abs(r - first_row) <= 3 and abs(c - b.col) <= 3 group by all""", mapped=False)
def tokens_around(spark, sf):
    """SRC-31: named tokens near each block."""
    blocks, cells = _blocks(spark, sf)
    return ingest.tokens_around(cells, blocks, ["FAR", "HEAD"], 3)


def _blocks(spark, sf):
    blocks = table(spark, sf, "lineitem").select(
        F.lit("f").alias("file"), (F.col("l_suppkey") % 6).alias("sheet"), F.col("l_linenumber").alias("col"), (5 + F.col("l_suppkey") % 3).alias("first_row")
    ).distinct()
    said = [(2, F.concat(F.lit("Head "), F.col("col").cast("string"))), (4, F.lit("far")), (1, F.lit("12"))]
    cells = blocks.select("file", "sheet", "col", F.explode(F.array(*[F.struct((F.col("first_row") - up).alias("row"), v.alias("value")) for up, v in said])).alias("c"))
    return blocks, cells.select("file", "sheet", "col", "c.*")


_SPELLED = """sp as (
  select c_custkey as k, case c_custkey % 6 when 0 then 'chr' || (c_nationkey + 1) when 1 then 'MT' when 2 then 'X'
    when 3 then 'NC_0000' || lpad((c_nationkey % 24 + 1)::varchar, 2, '0') || '.9' when 4 then 'NC_012920.1' else 'KI270' end as chr,
    case c_custkey % 4 when 0 then ' AUΨgc ' when 1 then 'auGC' when 2 then 'PsiAGCU' else 'A-C' end as label, case c_custkey % 3 when 0 then '' when 1 then ' '
    else null end as first_, c_name as second_
  from customer)"""


@query(f"""with {_SPELLED} select k, case k % 6 when 1 then 'chrM' when 2 then 'chrX' else chr end as chrom,
 case k % 6 when 1 then 'chrM' when 2 then 'chrX' when 3 then case regexp_extract(chr, '0000(..)', 1)::int when 23 then 'chrX' when 24 then 'chrY'
    else 'chr' || regexp_extract(chr, '0000(..)', 1)::int end when 4 then 'chrM' else chr end as accession_chrom,
 case k % 4 when 0 then 'AUUGC' when 1 then 'AUUGC' when 2 then null else null end as context, case k % 4 when 3 then 'AC' end as pair, case k % 4
    when 0 then 'AUUGC' end as strict, case k % 4 when 0 then 'AUUGC' end as motif, second_ as first_of from sp""", mapped=False)
def label_scalars(spark, sf):
    """FN-05, 06, 08, 09, SRC-26: chromosomes, accessions, context labels and the first value that isn't blank."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    accession = F.concat(F.lit("NC_0000"), F.lpad((n % 24 + 1).cast("string"), 2, "0"), F.lit(".9"))
    chrom = (
        F.when(k % 6 == 0, F.concat(F.lit("chr"), (n + 1).cast("string"))).when(k % 6 == 1, "MT").when(k % 6 == 2, "X").when(k % 6 == 3, accession)
        .when(k % 6 == 4, "NC_012920.1").otherwise("KI270")
    )
    label = F.when(k % 4 == 0, " AUΨgc ").when(k % 4 == 1, "auGC").when(k % 4 == 2, "PsiAGCU").otherwise("A-C")
    rows = table(spark, sf, "customer").select(k.alias("k"), chrom.alias("chr"), label.alias("label"), F.when(k % 3 == 0, "").when(k % 3 == 1, " ").alias("blank"), "c_name")
    return rows.select(
        "k", fn.chromosome("chr").alias("chrom"), fn.chromosome_of_accession("chr").alias("accession_chrom"), fn.context_motif("label").alias("context"),
        fn.dinucleotide("label").alias("pair"), fn.strict_motif("label").alias("strict"), fn.motif5("label").alias("motif"), fn.first_existing("blank", "c_name").alias("first_of"),
    )


@query(f"with {_SOURCE} select id, chrom || ':' || strand || ':' || pos1 as locus, case when strand is not null and pos1 is not null then chrom end as chrom, case when pos1 is not null then strand end as strand, case when strand is not null then pos1 end as pos from nc", mapped=False)
def locus_keys(spark, sf):
    """FN-15, 16: locus keys built and parsed again."""
    rows = _normalised(spark, sf).select(F.element_at("raw", "id").cast("bigint").alias("id"), F.col("base_locus_id").alias("locus"))
    return rows.select("id", "locus", fn.parse_locus("locus").alias("p")).select("id", "locus", "p.*")


@query("""select count(*) as n, count_if(o_orderkey % 5 = 0)::bigint as strict_intervals, count_if(o_orderkey % 5 in (0, 2))::bigint as tolerant_intervals,
 count(distinct case when o_orderkey % 5 in (1, 2) then o_orderkey end) as missed_sites from orders""", mapped=False)
def site_parser_audit(spark, sf):
    """FN-19: what the strict parser of sites misses."""
    return ingest.site_parser_audit(site_texts(spark, sf), "site")


_FEATURES = "(values (0, 'CDS'), (1, 'five_prime_UTR'), (2, 'three_prime_UTR'), (3, 'UTR'), (4, 'exon'), (5, 'gene'), (6, 'stop_codon')) v(i, f)"


@query(f"""with r as (select l_partkey as k, case f when 'CDS' then 'CDS' when 'stop_codon' then 'CDS' when 'five_prime_UTR' then '5UTR'
    when 'three_prime_UTR' then '3UTR' when 'UTR' then 'UTR' when 'exon' then 'EXON_OTHER' end as region
  from lineitem join {_FEATURES} on i = (l_orderkey + l_linenumber) % 7 where l_tax < .04), s as (select k, list_sort(list(distinct region) filter (where region is not null)) as rs from r group by 1)
 select k, coalesce(array_to_string(rs, '|'), '') as regions, case when rs is null or len(rs) = 0 then 'UNANNOTATED' when list_contains(rs, 'CDS') then 'CDS'
    when list_contains(rs, '5UTR') and not list_contains(rs, '3UTR') then '5UTR'
  when list_contains(rs, '3UTR') and not list_contains(rs, '5UTR') then '3UTR' when list_contains(rs, 'UTR') then 'UTR'
    when list_contains(rs, 'EXON_OTHER') then 'EXON_OTHER' else 'MULTI' end as primary_region from s""", mapped=False)
def region_labels(spark, sf):
    """FN-20: regions of features and the primary region of a set."""
    names = F.array(*[F.lit(x) for x in ("CDS", "five_prime_UTR", "three_prime_UTR", "UTR", "exon", "gene", "stop_codon")])
    feature = F.get(names, ((F.col("l_orderkey") + F.col("l_linenumber")) % 7).cast("int"))
    rows = table(spark, sf, "lineitem").where("l_tax < .04").select(F.col("l_partkey").alias("k"), fn.region_label(feature).alias("region"))
    sets = rows.groupBy("k").agg(F.sort_array(F.collect_set("region")).alias("rs"))
    return sets.select("k", F.array_join("rs", "|").alias("regions"), fn.primary_region(F.col("rs")).alias("primary_region"))


@query("""select l_orderkey * 10 + l_linenumber as id, l_quantity / (case when (select quantile_cont(l_quantity, .5) from lineitem) > 1.5 then 100 else 1 end) as a,
 l_discount / (case when (select quantile_cont(l_discount, .5) from lineitem) > 1.5 then 100 else 1 end) as b from lineitem""", "a b", mapped=False)
def rescaled_fractions(spark, sf):
    """FN-25: columns of percent turned into fractions, others left alone."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return ingest.rescaled_fraction(ingest.rescaled_fraction(rows, "a"), "b")


@query("""with x as (select cell, locus, (rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0) / count(*) over () as p, breadth, case
    when gene % 5 = 0 then 'out' else 'in_validated_domain' end as d from u)
 select cell, locus, case when d = 'out' then 'out_of_validated_domain' when breadth >= 2 then 'multi_technology_supported' else 'single_source_ranked' end as evidence_layer,
  case when d = 'out' then 'not_scored_outside_validated_locally-single-U_domain'
    when breadth >= 2 then 'orthogonal_source_support_present; portability score is supplementary'
    else 'use portability percentile/rank to prioritize orthogonal validation' end as interpretation,
  case when p >= .9 then 'high_validation_priority' when p >= .75 then 'elevated_validation_priority' when p >= .25 then 'intermediate_validation_priority'
    else 'lower_validation_priority' end as priority from x""")
def evidence_labels(spark, sf):
    """FN-36: evidence layers, how scores may be read, and bands of their percentiles."""
    from ..operators.ranks import percentile_ranks

    rows = percentile_ranks(union(spark, sf), "score", out="p")
    domain = F.when(F.col("gene") % 5 == 0, "out").otherwise("in_validated_domain")
    return rows.select("cell", "locus", *fn.evidence_labels(domain, F.col("breadth")), fn.priority_band(F.col("p")).alias("priority"))


@query("""with g as (select distinct upper(split_part(p_name, ' ', 1)) as t, min(split_part(p_name, ' ', 1)) as gene from part group by 1),
 r as (select c_custkey as k, upper(trim(case c_custkey % 3 when 0 then split_part(p_name, ' ', 1) when 1 then p_name || ' (x)' else c_mktsegment end)) as v
    from customer join part on p_partkey = c_custkey % 100),
 t as (select k, v, unnest(list_distinct(list_append(regexp_extract_all(v, '[A-Z0-9][A-Z0-9.-]*'), v))) as t from r),
 h as (select k, max(case when t.t = v then gene end) as exact, min(gene) as one, count(distinct gene) as n from t join g on g.t = t.t group by 1)
 select r.k, coalesce(exact, case when n = 1 then one end) as gene from r left join h on r.k = h.k""", mapped=False)
def gene_tokens(spark, sf):
    """FN-37: the gene that a messy value names."""
    part = table(spark, sf, "part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    genes = part.groupBy(F.upper(first).alias("t")).agg(F.min(first).alias("gene")).select("gene")
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(part, F.col("p_partkey") == k % 100)
    value = F.when(k % 3 == 0, first).when(k % 3 == 1, F.concat("p_name", F.lit(" (x)"))).otherwise(F.col("c_mktsegment"))
    return ingest.gene_tokens(rows.select(k.alias("k"), value.alias("v")), "v", genes, "k")


@query("select l_orderkey * 10 + l_linenumber as id, l_partkey as part, p_type as motif from (select distinct l_orderkey, l_linenumber, l_partkey from lineitem) join part on l_partkey = p_partkey", mapped=False)
def checked_join(spark, sf):
    """JN-16: a join that holds only because the right side's key is unique."""
    lines = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("part")).distinct()
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("motif"))
    return loci.checked_join(lines, part, ["part"], "inner")


@query("""select count(*) as n, (select count(*) from (select locus, motif from calls where tech = 'A' except all select locus, motif from calls where tech = 'A' and score >= 0)) = 0 as same_rows,
 (select count(*) from (select locus, motif from calls where tech = 'A' except all select locus, motif from calls where tech = 'N')) = 0 as same_as_other from calls where tech = 'A'""")
def same_rows(spark, sf):
    """JN-17: whether two models would see the same rows."""
    c = calls(spark, sf)
    a = c.where("tech = 'A'").select("locus", "motif")
    told = loci.same_rows(a, c.where("tech = 'A' and score >= 0").select("locus", "motif")), loci.same_rows(a, c.where("tech = 'N'").select("locus", "motif"))
    return a.agg(F.count("*").alias("n")).select("n", F.lit(told[0]).alias("same_rows"), F.lit(told[1]).alias("same_as_other"))


@query("select locus, min(motif) as motif from calls group by 1")
def agreeing_collapse(spark, sf):
    """AGG-06: one row per locus, whose duplicates must agree on the motif."""
    return loci.agreeing_collapse(calls(spark, sf), ["locus"], "motif")


@query("""select unnest(list_filter(['cell', 'breadth', 'y'], lambda c: true)) as "column" from (select 1)
    where (select count(distinct cell) > 1 and count(distinct breadth) > 1 and count(distinct y) > 1 from u)""")
def varying_columns(spark, sf):
    """AGG-20: columns without those that are constant."""
    rows = union(spark, sf).select("cell", "breadth", "y", F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return spark.createDataFrame([(c,) for c in loci.varying_columns(rows, rows.columns)], "`column` string")


@query("""select source, n from (select 'both' as source, count(*) as n from (select locus from calls where tech = 'A' intersect select locus from calls where tech = 'N')
 union all select 'first', count(*) from (select locus from calls where tech = 'A' except select locus from calls where tech = 'N') union all
    select 'all', count(*) from (select locus from calls where tech in ('A', 'N')))""")
def key_sets(spark, sf):
    """AGG-13: tagged union, intersection and difference of two technologies' loci."""
    side = lambda t: calls(spark, sf).where(F.col("tech") == t).select("locus", F.lit(t).alias("source"))
    a, n = side("A"), side("N")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    both = a.select("locus").intersect(n.select("locus"))
    first = a.select("locus").exceptAll(n.select("locus")).distinct().join(n.select("locus").distinct(), "locus", "left_anti")
    return count(both, "both").unionByName(count(first, "first")).unionByName(count(files.union_rows(a, n), "all"))
