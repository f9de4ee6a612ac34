"""SimHash near-duplicates, linked by multi-index hashing.

The 64-bit fingerprints are cut into two 32-bit segments. Two fingerprints that differ in at
most two bits differ in at most one bit in one of the segments, so each fingerprint looks up
the table of a segment's values at its own value and at the values one bit away (a Hamming
ball of radius one), and every match is verified on all 64 bits. Of the two values of a pair
that differ by one bit only the one with a 0 there looks up the other, which halves the ball.

Only distinct fingerprints are linked: copies share theirs. A segment value that more than
``BUCKET`` distinct fingerprints share (variants of one long text) would give a number of
candidates quadratic in its size. Whatever owns or looks up such a value is linked through the
ball of the whole fingerprint instead: two fingerprints are within two bits of each other
exactly if their balls of radius one meet, and at most 65 fingerprints meet in one point, so
nothing is lost and no group is large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import connected_components, fresh_name, write_table

SEED = 42
WORDS = 3
BUCKET = 64
BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text as a signed 64-bit integer.

    Bytes, not code points: ``bytes.lower`` touches A-Z only and ``bytes.split`` splits at
    space and 0x09-0x0D only, which is the definition of a word here.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    last = len(parts) - width + 1
    spans_from, spans_to = starts[:last].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, last, BLOCK):
        cut = slice(at, at + BLOCK)
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(spans_from[cut], spans_to[cut], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long): one row per row of ``docs``; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), _fingerprints(F.col(text_col)).alias("fingerprint"))


def hex_fingerprint(column: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def link_fingerprints(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect what lies within two bits in ``distinct`` (fingerprint).

    Below ``bucket`` every pair within two bits is a link. For the rest the links are stars
    around shared points, which connect the same fingerprints.
    """
    fp = F.col("fingerprint")
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)
    entries = distinct.select("fingerprint", F.posexplode(F.array(low, high)).alias("segment", "value"))
    index = write_table(entries, "segments")
    crowded = write_table(
        index.groupBy("segment", "value").count().where(F.col("count") > bucket).select("segment", "value"), "crowded"
    )
    flips = F.expr("transform(filter(sequence(0, 31), i -> (value & shiftleft(1L, i)) = 0), i -> value | shiftleft(1L, i))")
    probes = index.select(
        F.col("fingerprint").alias("a"),
        "segment",
        F.posexplode(F.concat(F.array("value"), flips)).alias("flip", "value"),
    )
    quiet = index.join(crowded, ["segment", "value"], "left_anti").withColumnRenamed("fingerprint", "b")
    links = (
        probes.join(quiet, ["segment", "value"])
        .where("(flip > 0 or a < b) and a <> b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    if crowded.isEmpty():
        return links
    near = probes.join(crowded, ["segment", "value"], "left_semi").select(F.col("a").alias("fingerprint")).distinct()
    ball = F.expr("concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i)))")
    stars = (
        near.select("fingerprint", F.explode(ball).alias("point"))
        .groupBy("point")
        .agg(F.collect_list("fingerprint").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where("a <> b")
    )
    return links.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included. Texts
    without words have fingerprint zero and are linked like any other; null texts count as
    empty. Rows with a null id keep their row and take part in links, but never name a
    component (null only if no id in the component is known). Repeated rows stay repeated; an
    empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    prints = write_table(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = write_table(prints.groupBy("fingerprint").agg(F.min("id").alias("first")), "classes")
    roots = connected_components(link_fingerprints(classes.select("fingerprint")))
    roots = write_table(roots.withColumnRenamed("node", "fingerprint"), "roots")
    least = roots.join(classes, "fingerprint").groupBy("root").agg(F.min("first").alias("component"))
    linked = roots.join(least, "root").select("fingerprint", "component")
    named = classes.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "first").alias("component_id")
    )
    return prints.join(write_table(named, "components"), "fingerprint").select("id", "fingerprint", "component_id")


#: Ids that are broadcast to drop rows; more are joined by a sort, which spills.
MOST_BROADCAST = 2_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the smallest id.

    Columns stay as they are. Rows that share an id share its fate, and of those that stay one is
    left: that of the least text, then of the least hash of the row. Rows with a null id cannot be
    told apart by it and stay. Only the ids to drop meet the documents, so texts aren't shuffled
    unless those ids are more than ``MOST_BROADCAST``.
    """
    name = fresh_name(docs, "id")
    found = near_duplicates(docs, id_col, text_col).where("id is not null")
    fate = found.groupBy("id").agg(F.max(F.col("id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    fate = write_table(fate.select(F.col("id").alias(name), "stays"), "fate")
    size = fate.agg(F.count("*").alias("n"), F.count_if("stays").alias("several")).first()
    known = F.broadcast(fate) if size["n"] <= MOST_BROADCAST else fate.hint("merge")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = docs[id_col] == known[name]
    out = docs.join(known, same, "left_anti")
    if size["several"]:
        again = docs.join(known.where("stays"), same, "left_semi").groupBy(F.col(id_col).alias(name))
        row = F.struct(*columns)
        again = again.agg(F.min_by(row, F.struct(F.col(text_col), F.xxhash64(*columns))).alias("row"))
        out = out.unionByName(again.select("row.*"))
    return out.select(*columns)
