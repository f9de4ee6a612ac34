"""Sequence features as column expressions; k-mers as rolling codes, over whole sequences or their pieces."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DNA = "ACGT"
STOPS = ("TAA", "TAG", "TGA")


def base_fraction(seq: Column, bases: str) -> Column:
    """FN-28: share of some bases; 0 for an empty sequence."""
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.translate(seq, bases, ""))) / F.length(seq)).otherwise(0.0)


def gc_fraction(seq: Column) -> Column:
    return base_fraction(seq, "GC")


def base_frequencies(seq: Column) -> list[Column]:
    return [base_fraction(seq, b).alias(f"freq_{b}") for b in DNA]


def letters(text: Column) -> Column:
    """The letters of a text: cut once, as a substring of a long text would be searched from its start each time."""
    return F.split(text, "")


def windows(text: Column, k: int, step: int = 1) -> Column:
    """All k-letter windows of a text, in order; those that start at multiples of ``step``."""
    if step == k:
        return F.regexp_extract_all(text, F.lit(f"(?s).{{{k}}}"), F.lit(0))
    at = lambda x: F.transform(F.sequence(F.lit(1), F.size(x) - k + 1, F.lit(step)), lambda i: F.array_join(F.slice(x, i, k), ""))
    cut = F.transform(F.array(letters(text)), at)[0]
    return F.when(F.length(text) >= k, cut).otherwise(F.array().cast("array<string>"))


#: Bits of a k-mer's code, at most: 31 letters of DNA.
MOST_BITS = 62


def letter_bits(alphabet: str) -> int:
    return max(1, (len(alphabet) - 1).bit_length())


def kmer_codes(text: bytes, k: int, alphabet: str = DNA) -> np.ndarray:
    """Codes of the clean k-letter windows of a text, ``letter_bits`` a letter, in order; linear in its length for any k."""
    values = np.full(256, len(alphabet), np.uint8)
    values[list(alphabet.encode("ascii"))] = range(len(alphabet))
    letters, bits = values[np.frombuffer(text, np.uint8)], letter_bits(alphabet)
    n = len(letters) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    # Windows of a power of two letters double; those that make up k are put one behind the other.
    bad = letters == len(alphabet)
    out, done, power, width = np.zeros(n, np.int64), 0, np.where(bad, 0, letters).astype(np.int64), 1
    while done < k:
        if k & width:
            out = (out << (bits * width)) | power[done : done + n]
            done += width
        if done < k:
            power = (power[: len(power) - width] << (bits * width)) | power[width:]
            width *= 2
    seen = np.concatenate(([0], np.cumsum(bad)))
    return out[seen[k:] == seen[:n]]


def _code_counts(k: int, alphabet: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, codes, counts = [], [], []
            for i, text in enumerate(batch.column(1)):
                found, n = np.unique(kmer_codes((text.as_py() or "").encode("ascii", "replace"), k, alphabet), return_counts=True)
                key.append(np.full(len(found), i))
                codes.append(found)
                counts.append(n)
            rows = np.concatenate([*key, np.empty(0, np.int64)]).astype(np.int64)
            columns = [batch.column(0).take(pa.array(rows)), *[pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)) for x in (codes, counts)]]
            yield pa.RecordBatch.from_arrays(columns, ["key", "code", "n"])

    return count


def _kmer(code: Column, k: int, alphabet: str) -> Column:
    bits = letter_bits(alphabet)
    place = lambda i: F.shiftright(code, bits * (k - 1 - i)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    return F.concat(*[F.substring(F.lit(alphabet), place(i) + 1, F.lit(1)) for i in range(k)])


def kmer_frequencies(df: DataFrame, key: str, text: str, k: int, alphabet: str | None = DNA) -> DataFrame:
    """FN-29: (key, kmer, n, frequency): clean windows counted, all windows in the denominator.

    k-mers whose codes fit into ``MOST_BITS`` are rolling codes, counted per sequence in its task.
    ``alphabet`` (ASCII letters) None takes every window.
    """
    if alphabet and k * letter_bits(alphabet) <= MOST_BITS:
        kind = df.schema[key].dataType.simpleString()
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.greatest(F.length(text) - k + 1, F.lit(0)).cast("long").alias("all"))
        found = rows.select("key", "text").mapInArrow(_code_counts(k, alphabet), f"key {kind}, code long, n long").groupBy("key", "code").agg(F.sum("n").alias("n"))
        sizes = rows.where("all > 0").groupBy("key").agg(F.max("all").alias("all"))
        joined = found.join(sizes, "key")
        return joined.select(F.col("key").alias(key), _kmer(F.col("code"), k, alphabet).alias("kmer"), "n", (F.col("n") / F.col("all")).alias("frequency"))
    # Letters are split once per row: a substring of a long text would be searched from its start each time.
    split = df.select(key, F.greatest(F.length(text) - k + 1, F.lit(0)).alias("__all"), F.split(text, "").alias("__letters")).where("__all > 0")
    pieces = F.transform(F.sequence(F.lit(1), F.size("__letters") - k + 1), lambda i: F.array_join(F.slice("__letters", i, k), ""))
    rows = split.select(key, "__all", F.explode(pieces).alias("kmer"))
    if alphabet:
        rows = rows.where(F.col("kmer").rlike(f"^[{alphabet}]{{{k}}}$"))
    counted = rows.groupBy(key, "kmer").agg(F.count("*").alias("n"), F.max("__all").alias("__all"))
    return counted.select(key, "kmer", "n", (F.col("n") / F.col("__all")).alias("frequency"))


def chunk_kmers(chunks: DataFrame, k: int, record: str = "record", offset: str = "offset", chunk: str = "chunk") -> DataFrame:
    """FN-29: ``kmer_frequencies`` of DNA in pieces (``files.fasta_chunks``), a row per record and k-mer.

    A piece takes the first k - 1 letters of the next one along, so windows across borders count
    once and a sequence is spread over as many tasks as it has pieces. Pieces are at least k - 1 letters
    long but for the last; k is 31 at most.
    """
    after = Window.partitionBy(record).orderBy(offset)
    heads = chunks.select(record, offset, F.length(chunk).alias("size"), F.left(F.col(chunk), F.lit(k - 1)).alias("head"))
    nexts = heads.select(record, offset, F.coalesce(F.lead("head").over(after), F.lit("")).alias("__next"))  # k letters per piece
    totals = heads.groupBy(record).agg(F.greatest(F.sum("size") - k + 1, F.lit(0)).alias("all"))
    whole = chunks.join(nexts, [record, offset]).select(F.col(record).alias("key"), F.concat(chunk, "__next").alias("text"))
    kind = chunks.schema[record].dataType.simpleString()
    found = whole.mapInArrow(_code_counts(k, DNA), f"key {kind}, code long, n long").groupBy("key", "code").agg(F.sum("n").alias("n"))
    joined = found.withColumnRenamed("key", record).join(totals, record)
    return joined.select(record, _kmer(F.col("code"), k, DNA).alias("kmer"), "n", (F.col("n") / F.col("all")).alias("frequency"))


def sense_codons() -> list[str]:
    return [c for c in ("".join(x) for x in product(DNA, repeat=3)) if c not in STOPS]


def codon_frequencies(df: DataFrame, key: str, cds: str) -> DataFrame:
    """FN-30: ``key`` and codon_<c>, the share of each of the 61 sense codons among them, from one count per sequence.

    ``key`` must be unique; sequences without a sense codon have zeros.
    """
    codons = df.select(key, F.explode(windows(F.col(cds), 3, 3)).alias("codon")).where(F.col("codon").isin(sense_codons()))
    counted = codons.groupBy(key, "codon").agg(F.count("*").alias("n"))
    total = F.sum("n")
    wide = counted.groupBy(key).agg(*[(F.coalesce(F.sum(F.when(F.col("codon") == c, F.col("n"))), F.lit(0)) / total).alias(f"codon_{c}") for c in sense_codons()])
    return df.select(key).join(wide, key, "left").fillna(0.0, [f"codon_{c}" for c in sense_codons()])


def positional_onehot(seq: Column, anchor: Column, offsets, prefix: str) -> list[Column]:
    """FN-27: 0/1 per offset from a 0-based anchor and base; all 0 outside the sequence.

    The stretch around the anchor is cut out once; each offset looks into that.
    """
    offsets = list(offsets)
    low, high = min(offsets, default=0), max(offsets, default=0)
    first = F.greatest(anchor + low, F.lit(0))
    near = F.when(anchor + high >= 0, F.substr(seq, first + 1, anchor + high - first + 1))
    out = []
    for off in offsets:
        at = anchor + off
        base = F.when(at >= 0, F.substr(near, at - first + 1, F.lit(1)))
        out += [F.coalesce((base == b).cast("int"), F.lit(0)).alias(f"{prefix}_{off:+d}_{b}") for b in DNA]
    return out


def _codons_at(seq: Column) -> Column:
    """The three letters at each position of a sequence, in order."""
    return windows(seq, 3)


def upstream_starts(utr5: Column) -> Column:
    """FN-31: start codons in a 5' UTR, in any frame."""
    return F.size(F.filter(_codons_at(utr5), lambda c: c == "ATG"))


def uorf_count(utr5: Column) -> Column:
    """FN-31: start codons with a stop in their frame inside the UTR.

    A start has one exactly if it lies before its frame's last stop, so one look at each codon is
    enough.
    """
    last = lambda x, f: F.coalesce(F.array_max(F.transform(x, lambda c, i: F.when(c.isin(*STOPS) & (i % 3 == f), i))), F.lit(-1))

    def count(both: Column) -> Column:
        return F.size(F.filter(F.transform(both["codons"], lambda c, i: (c == "ATG") & (i < F.get(both["last"], i % 3))), lambda hit: hit))

    with_last = F.transform(F.array(_codons_at(utr5)), lambda x: F.struct(x.alias("codons"), F.array(last(x, 0), last(x, 1), last(x, 2)).alias("last")))
    return F.transform(with_last, count)[0]


def start_context(seq: Column, start: Column) -> list[Column]:
    """FN-32: purine at -3, G at +4, and whether the 0-based start is a start codon."""
    at = lambda off: F.when(start + off >= 0, F.substr(seq, start + off + 1, F.lit(1)))
    return [
        F.coalesce(at(-3).isin("A", "G"), F.lit(False)).cast("int").alias("kozak_minus3_purine"),
        F.coalesce(at(3) == "G", F.lit(False)).cast("int").alias("kozak_plus4_g"),
        F.coalesce(F.substr(seq, start + 1, F.lit(3)) == "ATG", F.lit(False)).alias("start_is_atg"),
    ]


def region_lengths(seq: Column, start: Column, stop: Column) -> list[Column]:
    """FN-32: lengths of 5' UTR, coding part and 3' UTR for a half-open coding span, and their log1p."""
    parts = {"utr5": start, "cds": stop - start, "utr3": F.length(seq) - stop}
    return [x for n, c in parts.items() for x in (c.alias(f"{n}_length"), F.log1p(c.cast("double")).alias(f"log1p_{n}_length"))]


def exon_offsets(exons: DataFrame, transcript: str, start: str, end: str, strand: str, out: str = "offset") -> DataFrame:
    """WIN-13: transcript position before each exon, in the direction of the strand."""
    first = F.when(F.col(strand) == "-", -F.col(end)).otherwise(F.col(start))
    before = Window.partitionBy(transcript).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    return exons.withColumn(out, F.coalesce(F.sum(F.col(end) - F.col(start) + 1).over(before), F.lit(0)))


def project(intervals: DataFrame, exons: DataFrame, transcript: str, start: str, end: str, strand: str) -> DataFrame:
    """FN-33: genomic intervals (start, end per transcript) as half-open spans of transcript positions.

    ``exons`` has the same column names; parts outside exons fall away, and an interval without
    any is left out.
    """
    placed = exon_offsets(exons, transcript, start, end, strand).select(
        transcript, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(strand).alias("__strand"), "offset"
    )
    cut = intervals.join(placed, transcript).where((F.col(start) <= F.col("__e")) & (F.col(end) >= F.col("__s")))
    lo, hi = F.greatest(start, "__s"), F.least(end, "__e")
    forward = F.col("__strand") != "-"
    first = F.col("offset") + F.when(forward, lo - F.col("__s")).otherwise(F.col("__e") - hi)
    last = F.col("offset") + F.when(forward, hi - F.col("__s")).otherwise(F.col("__e") - lo)
    return cut.groupBy(*intervals.columns).agg(F.min(first).alias("tx_start"), (F.max(last) + 1).alias("tx_end"))


def coding_span(projected: DataFrame, transcript: str, feature: str) -> DataFrame:
    """FN-33: coding span per transcript, from start and stop codons where both are, else from coding exons."""
    at = lambda f, c: F.when(F.col(feature) == f, F.col(c))
    per = projected.groupBy(transcript).agg(
        F.min(at("start_codon", "tx_start")).alias("a"), F.max(at("stop_codon", "tx_end")).alias("b"),
        F.min(at("CDS", "tx_start")).alias("c"), F.max(at("CDS", "tx_end")).alias("d"),
    )
    codons = F.col("a").isNotNull() & F.col("b").isNotNull()
    return per.select(transcript, F.when(codons, F.col("a")).otherwise(F.col("c")).alias("cds_start"), F.when(codons, F.col("b")).otherwise(F.col("d")).alias("cds_end"))
