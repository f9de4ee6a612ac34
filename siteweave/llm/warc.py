"""WARC archives with one Zstandard frame per record and a shared dictionary.

A ``.warc.zst`` archive opens with a skippable frame that holds the dictionary; each record is
one frame after it. Every task trains a dictionary on the first payloads it sees and writes its
partition as archives of a bounded size through Spark's own text writer: a row is the bytes of a
frame, and the line separator is an empty skippable frame, which every reader passes over. The
writer starts a new file after ``ARCHIVE_ROWS`` rows; each file's first row is the dictionary, and
empty rows end a file early once it holds ``ARCHIVE_BYTES``. So archives are committed and
recovered like any other output, on any file system that Spark writes.

The reader takes archives of any origin with Spark's binary source, one per task at a time, decodes frame by
frame, and validates headers, lengths and digests. It gives generic records of all types, in
batches, with their payloads only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, write_table

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame in ASCII, which separates the frames.
SEPARATOR = "P*M\x18\0\0\0\0"
DUPLICATE_BYTES = 1000
#: Payloads that a dictionary is trained on, the bytes taken of each, and its size.
TRAINED_ON, TRAINED_BYTES, DICTIONARY_BYTES = 64, 8192, 16384
LEVEL, FEED = 3, 1 << 15
#: Rows (frames) of an archive, and compressed bytes after which it takes no more records.
ARCHIVE_ROWS, ARCHIVE_BYTES = 4096, 64 << 20
#: Records of one batch that the reader gives.
BATCH = 256
#: Repeated payloads, the most frequent first, that are broadcast; bits of the filter in front of the join with all others.
MOST_KNOWN, FILTER_BITS = 100_000, 1 << 26
ID = "urn:page:"
RECORD = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_bytes long, payload_digest string, block_bytes long"


def dictionary_frame(payloads: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict]:
    """The leading skippable frame; raw content where the payloads are too few to train on."""
    samples = [p[:TRAINED_BYTES] for p in payloads if p]
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8)
    except zstandard.ZstdError:
        made = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = made.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, made


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of another page's identical payload, which it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}


def parse_record(raw: bytes) -> dict:
    """A record of any type: its names, lengths, SHA-1 and payload; ValueError if a header, length or digest is wrong.

    The payload of an HTTP message is its body, that of any other record its block. A revisit
    leaves its payload out, so length and digest are those that it states.
    """
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not sep or not version.startswith("WARC/1."):
        raise ValueError(f"no WARC header: {raw[:40]!r}")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"}.difference(fields):
        raise ValueError(f"a record lacks {sorted(missing)}")
    length, kind, name = int(fields["content-length"]), fields["warc-type"], fields["warc-record-id"].strip("<>")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{name} says {length} bytes and has {len(rest) - 4}")
    block = payload = rest[:length]
    said, encoded = None, False
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        status, http_fields = _headers(http)
        if kind in ("response", "revisit") and (not sep and block[-2:] != b"\r\n" or not status.startswith("HTTP/")):
            raise ValueError(f"{name} is a {kind} without an HTTP header")
        said, encoded = http_fields.get("content-length"), "transfer-encoding" in http_fields
    elif kind == "revisit":
        payload = b""
    stated = fields.get("warc-payload-digest", "")
    digest = None
    if stated.lower().startswith("sha1:"):
        coded = stated[5:]
        digest = bytes.fromhex(coded) if len(coded) == 40 else base64.b32decode(coded.upper())
    if kind != "revisit" and not encoded:
        found = hashlib.sha1(payload).digest()
        if said is not None and int(said) != len(payload) or digest not in (None, found):
            raise ValueError(f"the payload of {name} doesn't match its length or digest")
        digest = found
    size = (None if said is None else int(said)) if kind == "revisit" else len(payload)
    return {
        "record_id": name, "record_type": kind, "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_bytes": size,
        "payload_digest": digest.hex() if digest else None, "block_bytes": length, "payload": payload,
    }


def frames(archive: bytes | pa.Buffer) -> Iterator[bytes]:
    """The decoded frames of an archive, each held alone; the dictionary comes from the leading frame.

    A dictionary that is itself a Zstandard frame is decoded first.
    """
    at, reader, view = 0, None, memoryview(archive)
    whole = len(view)
    while at < whole:
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at + 8 + size > whole:
                raise ValueError("a skippable frame is cut short")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError("the dictionary doesn't lead the archive")
                made = bytes(view[at + 8 : at + 8 + size])
                if int.from_bytes(made[:4], "little") == FRAME_MAGIC:
                    made = zstandard.ZstdDecompressor().decompressobj().decompress(made)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(made))
            at += 8 + size
            continue
        one, parts = (reader or zstandard.ZstdDecompressor()).decompressobj(), []
        while not one.eof:
            if at >= whole:
                raise ValueError("a frame is cut short")
            parts.append(one.decompress(view[at : at + FEED]))
            at += FEED
        at = min(at, whole) - len(one.unused_data)
        yield b"".join(parts)


def _linked(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, payload, digest) with ``refers_to``: the response of an equal payload, null for a response.

    Digests are counted without their payloads. The ``MOST_KNOWN`` most frequent payloads are
    broadcast, so that none of the others has more than that share of the rows. Of the others the
    pages that revisit are found by ids and digests alone. A filter of their hashes, of at most
    ``FILTER_BITS`` / 64 rows, then keeps all other pages in place: only revisiting pages, and those
    that the filter mistakes for one, are shuffled, by page and digest.
    """
    large = rows.where(F.octet_length("payload") >= DUPLICATE_BYTES).select("page_id", "digest")
    copies = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = write_table(copies, "payload-copies")
    all_known = copies.count() <= MOST_KNOWN
    known = copies if all_known else write_table(copies.orderBy(F.desc("n"), "digest").limit(MOST_KNOWN), "payload-copies-known")
    linked = rows.join(F.broadcast(known.select("digest", "first")), "digest", "left")
    columns = ["page_id", "url", "payload", "digest"]
    if all_known:
        return linked.select(*columns, F.expr("nullif(first, page_id)").alias("refers_to"))

    rest = copies.join(F.broadcast(known.select("digest")), "digest", "left_anti").select("digest", "first")
    revisits = large.join(rest, "digest").where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")))
    revisits = write_table(revisits.select("page_id", "digest", F.col("first").alias("other")).distinct(), "payload-revisits")
    mark = F.pmod(F.xxhash64("page_id", "digest"), F.lit(FILTER_BITS))
    word, bit = F.floor(mark / 64).alias("word"), (mark % 64).cast("int")
    marks = revisits.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    linked = linked.withColumn("word", word).join(F.broadcast(write_table(marks, "payload-filter")), "word", "left")
    meets = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    named, r = linked.where(meets).select(*columns, "first").alias("l"), revisits.alias("r")
    same = (F.col("l.digest") == F.col("r.digest")) & F.col("l.page_id").eqNullSafe(F.col("r.page_id"))
    moved = named.join(r, same, "left").select(*[f"l.{c}" for c in columns], F.expr("coalesce(r.other, nullif(l.first, l.page_id))").alias("refers_to"))
    return linked.where(~meets).select(*columns, F.expr("nullif(first, page_id)").alias("refers_to")).unionByName(moved)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of each partition of ``pages`` under ``path``; ``ARCHIVE_ROWS`` and ``ARCHIVE_BYTES`` bound each.

    Of rows with equal payloads of ``DUPLICATE_BYTES`` or more, the largest id is the response and
    the others, those without an id among them, revisit it; rows that share that id are all
    responses, as are rows of which none has an id. Null html is an empty payload.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    rows = _linked(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, head, row, size = None, b"", 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            if writer is None:
                head, made = dictionary_frame([p.as_py() for p in batch.column(2)[:TRAINED_ON]])
                writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made)
            for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                if size >= ARCHIVE_BYTES:
                    out += [b""] * (-row % ARCHIVE_ROWS)
                    row, size = 0, 0
                if row % ARCHIVE_ROWS == 0:
                    out.append(head)
                    row, size = 1, len(head)
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), bytes.fromhex(digest.as_py()), refers_to.as_py())
                out.append(writer.compress(raw))
                row, size = row + 1, size + len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    packed = rows.mapInArrow(pack, "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ARCHIVE_ROWS).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record of the archives under ``path`` (with its payload, if asked for); a malformed archive fails the job."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD + (", payload binary" if payloads else "")
    kinds = {"payload_bytes": pa.int64(), "block_bytes": pa.int64(), "payload": pa.binary()}
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names=names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found: list[dict] = []
                for frame in frames(content.as_buffer()):
                    one = parse_record(frame)
                    found.append({n: one[n] for n in names})
                    if len(found) == BATCH:
                        yield batch_of(found)
                        found = []
                if found:
                    yield batch_of(found)

    return files.mapInArrow(unpack, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns what is read back, under the pages' ids."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    page = lambda c: F.nullif(F.regexp_extract(c, f"^{ID}(-?[0-9]*)$", 1), F.lit("")).cast("long")
    return read_archives(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
