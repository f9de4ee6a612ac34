"""Mixing sources to target weights by a low-discrepancy schedule over blocks of equal length.

Targets share all words by weight; none exceeds ``most`` times its source, and what is cut off is
shared again among the rest (``targets``). A source is one stream of words: its documents in the
order of a hash, over and over, up to its target. The stream is cut into blocks of ``block`` words,
which cross the borders of documents.

Slot k of the mix takes the van der Corput point of k, bits of k reversed behind the point, and
falls to the source whose part of the cumulative targets holds it. A slot's rank is the number of
earlier slots of its source, which the points give in closed form (``earlier``), so nothing is
shuffled to count it; the slot takes its source's block of that rank. After any number of slots
each source is within log2(slots) blocks of its share. Blocks that the slots leave over, as many at
most, follow at the end, so that every source's words equal its target rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.ranks import running
from ..operators.resample import numbered
from .common import write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK, SEED = (5, 2, 1), 3, 256, 11
#: Digits of a point: at most 2^40 slots; cumulative targets are rounded to that grid.
DIGITS = 40


def words_in(text: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, source_size, weight, target, low, high) per source of ``sizes`` (source, size).

    Sources by code point, null last, get the weights in turn. In the order of what a unit of weight
    may take at most, the capped sources come first, and one running sum tells how many there are.
    ``low`` and ``high`` bound the source's part of the points; a source without words has none.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull())
    per = numbered(per, ["absent", "source"], "sid").drop("absent")
    turn = F.array(*[F.lit(w) for w in weights])[(F.col("sid") % len(weights)).cast("int")]
    per = per.withColumns({"weight": turn.cast("long"), "cap": most * F.col("source_size")})
    filled = running(per.withColumn("ratio", F.col("cap") / F.col("weight")), [], [F.col("ratio"), F.col("sid")], ["cap", "weight"])
    total = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))  # one row
    left = F.col("words") - (F.col("cum_cap") - F.col("cap"))
    weight_left = F.col("weights") - (F.col("cum_weight") - F.col("weight"))
    free = left * F.col("weight") <= F.col("cap") * weight_left
    filled = filled.crossJoin(total).withColumn("level", F.when(free, F.struct(F.col("ratio").alias("r"), F.col("sid").alias("s"), left.alias("left"), weight_left.alias("weights"))))
    level = filled.agg(F.min("level").alias("least"))  # one row: the first source that isn't capped, and what is left from there
    order = F.struct(F.col("ratio").alias("r"), F.col("sid").alias("s"))
    capped = F.col("least").isNull() | (order < F.struct("least.r", "least.s"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("least.left") * F.col("weight") / F.col("least.weights"))
    named = filled.crossJoin(level).select("sid", "source", "source_size", "weight", target.alias("target"))
    named = running(named, [], [F.col("sid")], ["target"]).crossJoin(named.agg(F.sum("target").alias("all")))
    point = lambda c: F.least(F.round(F.try_divide(c, F.col("all")) * (1 << DIGITS)).cast("long"), F.lit(1 << DIGITS))
    high = F.coalesce(point(F.col("cum_target")), F.lit(0))
    low = F.coalesce(point(F.col("cum_target") - F.col("target")), F.lit(0))
    named = named.select("sid", "source", "source_size", "weight", "target", low.alias("low"), high.alias("high"))
    return write_table(named, "targets")


def points(k: np.ndarray) -> np.ndarray:
    """The van der Corput points of slots, in units of 2^-DIGITS."""
    out = np.zeros_like(k)
    for _ in range(DIGITS):
        out, k = (out << 1) | (k & 1), k >> 1
    return out


def below(k: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of the slots before ``k`` have a point below ``bound``.

    A point below the bound shares its first digits and has a 0 at one of the bound's ones: for each
    such digit these are the slots of one residue class.
    """
    out, residue = np.where(bound >= 1 << DIGITS, k, 0), np.zeros_like(k)
    for i in range(DIGITS):
        one = (bound >> (DIGITS - 1 - i)) & 1
        step = 1 << (i + 1)
        out += one * np.maximum(0, (k - residue + step - 1) // step) * (bound < 1 << DIGITS)
        residue = residue + one * (1 << i)
    return out


def _longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column, dtype=np.int64)


@F.arrow_udf(LongType())
def point_of(k: pa.Array) -> pa.Array:
    return pa.array(points(_longs(k)))


@F.arrow_udf(LongType())
def earlier(k: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Slots before ``k`` whose point is in [low, high)."""
    k = _longs(k)
    return pa.array(below(k, _longs(high)) - below(k, _longs(low)))


def schedule(parts: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, rank) of the slots below ``slots``, for sources with their ``low`` and ``high``.

    Points meet parts by equal cells, of which there are about four per source, never by a nested loop.
    """
    spark = parts.sparkSession
    bits = min(DIGITS, 2 + max(1, parts.count()).bit_length())
    cell = lambda c: F.shiftright(c, DIGITS - bits)
    held = parts.where("low < high").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    dealt = spark.range(slots).select(F.col("id").alias("slot"), point_of("id").alias("point")).withColumn("cell", cell(F.col("point")))
    found = dealt.join(held.select("sid", "low", "high", "cell"), "cell").where("low <= point and point < high")
    return found.select("slot", "sid", earlier("slot", "low", "high").alias("rank"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
        most: int = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix, and its documents with their sources.

    The mix has a row per piece of a document in a slot: slot, sid, epoch, row (the document's place
    in its source), first_word and n_words. Read in the order of slots, rows and epochs, it is the
    training stream. The documents have row, sid, doc_id, size, source, source_size and target.

    Sizes are words; a null or empty text has none and is in no slot (its row is null). A null
    source is a source of its own, last in order. Repeated rows are documents of their own; equal
    seeds give equal mixes however the rows are partitioned. No documents give no rows.
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(text).alias("size"))
    sizes = write_table(sizes, "sizes")
    named = targets(sizes, weights, most)
    rows = sizes.alias("d").join(named.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rows = rows.select("sid", "doc_id", "size", "s.source", "source_size", "target")
    order = [F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id"), F.col("size")]
    placed = running(rows.where("size > 0"), ["sid"], order, ["size"]).withColumn("row", F.col("cum_size") - F.col("size")).drop("cum_size")
    placed = write_table(placed, "placed")
    goal = F.round("target").cast("long")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")))
    pieces = placed.select("sid", "row", "size", "source_size", goal.alias("goal"), epochs.alias("epoch"))
    pieces = pieces.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("row")).withColumn("to", F.least(F.col("from") + F.col("size"), "goal"))
    pieces = pieces.where(F.col("from") < F.col("to"))
    step = F.lit(block).cast("long")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.call_function("div", F.col("from"), step), F.call_function("div", F.col("to") - 1, step))))
    start, end = F.greatest("from", F.col("rank") * step), F.least("to", (F.col("rank") + 1) * step)
    pieces = pieces.select("sid", "rank", "epoch", "row", (start - F.col("from")).alias("first_word"), (end - start).alias("n_words"))
    words = named.agg(F.sum("target").alias("w")).first()["w"] or 0
    slots = -(-int(round(words)) // block)
    dealt = schedule(named, slots)
    ends = named.select("sid", earlier(F.lit(slots).cast("long"), "low", "high").alias("given"))
    n = max(1, named.count())
    late = F.lit(slots) + (F.col("rank") - F.col("given")) * n + F.col("sid")
    found = pieces.join(dealt, ["sid", "rank"], "left").join(ends, "sid")
    found = found.select(F.coalesce("slot", late).alias("slot"), "sid", "rank", "epoch", "row", "first_word", "n_words")
    columns = ["row", "sid", "doc_id", "size", "source", "source_size", "target"]
    empty = rows.where("size = 0").withColumn("row", F.lit(None).cast("long"))
    return found, placed.select(columns).unionByName(empty.select(columns))


def taken(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot) per document: the words that the mix takes of it, and where first."""
    found, rows = mix(docs, **how)
    per = found.groupBy("sid", "row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return rows.join(per, ["sid", "row"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )
