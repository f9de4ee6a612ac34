"""Tables, annotation, sequences and contracts as files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import stable

GTF = "seqname string, source string, feature string, start string, end string, score string, strand string, frame string, attributes string"


def read_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = "\t") -> DataFrame:
    """SRC-01: a delimited table, plain or gzip, with a header; strings unless a schema is given. "" and NaN are null."""
    reader = spark.read.option("sep", sep).option("header", True).option("nullValue", "").option("nanValue", "NaN")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def union_rows(*frames: DataFrame) -> DataFrame:
    """SRC-02, AGG-13: all rows under the ordered union of columns; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """SRC-02: a delimited table with a header; arrays are joined by |."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", sep).option("header", True).option("nullValue", "").csv(path)


def write_contract(spark: SparkSession, contract: dict, path: str) -> None:
    """SRC-03: one JSON document."""
    import json

    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").write.mode("overwrite").text(path)


def read_annotation(spark: SparkSession, path: str, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    """SRC-04: annotation lines of some features with integer coordinates; see ``annotation_quality`` for the rest."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(GTF).csv(path)
    return parse_annotation(rows, features)


def parse_annotation(lines: DataFrame, features: tuple[str, ...] = ("exon",)) -> DataFrame:
    """SRC-04 from nine string columns."""
    good = lines.where(F.col("attributes").isNotNull() & F.col("feature").isin(*features))
    whole = good.withColumns({c: F.col(c).try_cast("bigint") for c in ("start", "end")})
    return whole.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def annotation_quality(lines: DataFrame) -> DataFrame:
    """SRC-04: lines, lines short of nine fields, and lines with coordinates that are no integers."""
    short = F.col("attributes").isNull()
    bad = ~short & (F.col("start").try_cast("bigint").isNull() | F.col("end").try_cast("bigint").isNull())
    return lines.agg(F.count("*").alias("n"), F.count_if(short).alias("n_short"), F.count_if(bad).alias("n_bad_coordinates"))


#: Letters of one piece of a sequence, at most.
CHUNK = 1 << 16


def fasta_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """SRC-05: (record, accession, offset, chunk) pieces of the sequences of FASTA files, in upper-case DNA.

    A record starts at a line that starts with >; its accession is the first word there. Every
    split of a file is read as a stream of lines, each task cutting its own into pieces; what a
    split begins with belongs to the last record before it, which a running count over the splits
    tells. So a sequence of any length is spread over tasks, and no text is shuffled. Letters before
    the first record are left out; a record without letters has one empty piece.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, record, name, offset, held, size = None, 0, None, 0, [], 0

        def flush(done: bool) -> list[tuple]:
            """Whole pieces of what is held; the rest too, once the record or split is done."""
            nonlocal offset, held, size
            text, out = "".join(held), []
            while len(text) >= chunk or (done and (text or (name is not None and not offset))):
                out.append((*place, record, name, offset, text[:chunk]))
                offset, text = offset + len(text[:chunk]), text[chunk:]
                if not text:
                    break
            held, size = [text] if text else [], len(text)
            return out

        for batch in batches:
            rows = []
            for file, split, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if place != (file, split):
                    rows += flush(True) if place else []
                    place, record, name, offset, held, size = (file, split), 0, None, 0, [], 0
                if value.startswith(">"):
                    rows += flush(True)
                    words = value[1:].split()
                    record, name, offset, held, size = record + 1, words[0] if words else "", 0, [], 0
                else:
                    held.append("".join(value.split()).upper().replace("U", "T"))
                    size += len(held[-1])
                    if size >= chunk:
                        rows += flush(False)
            yield _rows(rows)
        if place:
            yield _rows(flush(True))

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = ["file", "split", "n", "accession", "offset", "chunk"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    pieces = stable(lines.mapInArrow(cut, "file string, split long, n long, accession string, offset long, chunk string"))
    last = F.max("n")
    at_last = pieces.groupBy("file", "split", "n").agg(F.max("accession").alias("accession"), F.sum(F.length("chunk")).alias("letters"))
    splits = at_last.groupBy("file", "split").agg(last.alias("n"), F.max_by("accession", "n").alias("name"), F.max_by("letters", "n").alias("tail"))
    upto = Window.partitionBy("file").orderBy("split")  # a row per split of a file
    splits = splits.withColumn("headed", F.sum((F.col("n") > 0).cast("int")).over(upto))
    splits = splits.withColumns({
        "end": F.sum("tail").over(Window.partitionBy("file", "headed").orderBy("split")),
        "owner": F.last(F.when(F.col("n") > 0, F.struct("split", "n", "name")), ignorenulls=True).over(upto),
    })
    carried = splits.select("file", "split", F.lag("end").over(upto).alias("__end"), F.lag("owner").over(upto).alias("__owner"))
    joined = pieces.join(carried, ["file", "split"], "left")
    begun = F.col("n") == 0
    record = F.concat_ws("#", "file", F.when(begun, F.col("__owner.split")).otherwise(F.col("split")), F.when(begun, F.col("__owner.n")).otherwise(F.col("n")))
    return joined.where(~begun | F.col("__owner").isNotNull()).select(
        record.alias("record"), F.when(begun, F.col("__owner.name")).otherwise(F.col("accession")).alias("accession"),
        F.when(begun, F.col("offset") + F.col("__end")).otherwise(F.col("offset")).alias("offset"), "chunk",
    ).where((F.col("chunk") != "") | (F.col("offset") == 0))


def wanted_chunks(chunks: DataFrame, wanted: DataFrame, column: str = "accession") -> DataFrame:
    """SRC-05: the pieces of the wanted accessions, matched with or without version."""
    bare = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    names = wanted.select(bare(F.col(column)).alias("__bare")).distinct()
    return chunks.withColumn("__bare", bare(F.col("accession"))).join(names, "__bare", "left_semi").drop("__bare")


def read_fasta(spark: SparkSession, path: str, wanted: DataFrame | None = None, column: str = "accession") -> DataFrame:
    """SRC-05: (accession, seq), a row per record, for sequences that fit into one; see ``fasta_chunks`` for longer ones."""
    chunks = fasta_chunks(spark, path)
    chunks = chunks if wanted is None else wanted_chunks(chunks, wanted, column)
    whole = chunks.groupBy("record", "accession").agg(F.sort_array(F.collect_list(F.struct("offset", "chunk"))).alias("c"))
    return whole.select("accession", F.array_join("c.chunk", "").alias("seq"))


#: Files up to this size are read by Spark as one row; larger ones are streamed.
MOST_BYTES = 1 << 30
_READ = 8 << 20


def _streamed(paths: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in paths:
        out = []
        for path in f["path"]:
            system, place = pa.fs.FileSystem.from_uri(quote(path, safe="/:@"))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while part := stream.read(_READ):
                    digest.update(part)
            out.append(digest.hexdigest())
        f["found_sha256"] = out
        yield f


def manifest(spark: SparkSession, path: str, expected: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """SRC-06: path, bytes and sha256 of files, and their status against ``expected`` (name, sha256).

    ``name`` is an expression on ``path``, by default its last part. A file up to ``MOST_BYTES`` is
    read by Spark; a larger one is a task of its own, which streams it through the digest from the
    file system of its address (as Arrow knows them), however large it is.
    """
    listed = spark.read.format("binaryFile").load(path)
    named = (F.element_at(F.split("path", "/"), -1) if name is None else name).alias("name")
    small = listed.where(F.col("length") <= MOST_BYTES).select("path", named, F.col("length").alias("bytes"), F.sha2("content", 256).alias("found_sha256"))
    large = listed.where(F.col("length") > MOST_BYTES).select("path", named, F.col("length").alias("bytes"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = large.repartition(spread, "path").mapInPandas(_streamed, "path string, name string, bytes long, found_sha256 string")
    files = small.unionByName(large)
    if expected is None:
        return files.withColumn("status", F.lit("PRESENT"))
    joined = files.join(expected, "name", "full_outer")
    status = (
        F.when(F.col("path").isNull(), "MISSING").when(F.col("sha256").isNull(), "PRESENT")
        .when(F.col("sha256") == F.col("found_sha256"), "HASH_OK").otherwise("HASH_MISMATCH")
    )
    return joined.withColumn("status", status)


def freeze(candidates: DataFrame, name: str, sha: str, path: str) -> DataFrame:
    """SRC-07: one path per name if all its copies have one hash, else REFERENCE_CONFLICT."""
    per = candidates.groupBy(name).agg(F.count_distinct(sha).alias("n_hashes"), F.min(path).alias(path), F.min(sha).alias(sha))
    ok = F.col("n_hashes") == 1
    return per.select(name, "n_hashes", *[F.when(ok, F.col(c)).alias(c) for c in (path, sha)], F.when(ok, "FROZEN").otherwise("REFERENCE_CONFLICT").alias("status"))
