"""Exact random counts for cells of equal rows, drawn inside tasks, so that no row is repeated per replicate.

A replicate's draws fall down a tree: first over chunks of ``CHUNK`` cells, by the chunks' sizes, then
over the cells of each chunk. Every node has a random stream of its own, keyed by seed, replicate
and the node's number, so any partitioning gives the same counts. With replacement the counts are
multinomial, without it multivariate hypergeometric; both are exact, and their work is cells times
replicates whatever the number of rows.

``text_draws`` gives the draws that SQL can repeat, a hash each, in whole batches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running

CHUNK = 4096
#: Numpy draws without replacement from fewer things than this.
MOST_HYPERGEOMETRIC = 10**9


def stream(seed: int, *key: int) -> np.random.Generator:
    """The random stream of one node."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed & 0xFFFFFFFF, *[k & 0xFFFFFFFFFFFFFFFF for k in key]])))


def split(sizes: np.ndarray, n: int, replace: bool, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` draws from sum(sizes) things fall to each size."""
    if replace:
        return rng.multinomial(n, sizes / sizes.sum())
    if sizes.sum() >= MOST_HYPERGEOMETRIC:
        raise ValueError(f"draws without replacement from {sizes.sum()} rows of one group; at most {MOST_HYPERGEOMETRIC - 1}")
    return rng.multivariate_hypergeometric(sizes, n, method="marginals")


def chunked(cells: DataFrame, group: list[str], order: list[str], size: str, columns: list[str]) -> DataFrame:
    """(*group, chunk, size, sizes, <columns>): up to ``CHUNK`` cells of a group in a row, as arrays in ``order``."""
    ones = cells.withColumn("__one", F.lit(1).cast("long"))
    placed = running(ones, group, [F.col(c) for c in order], ["__one"]).withColumn("chunk", F.call_function("div", F.col("cum___one") - 1, F.lit(CHUNK)))
    held = F.sort_array(F.collect_list(F.struct(F.col("cum___one").alias("__i"), F.col(size).cast("long").alias("__size"), *columns)))  # ``CHUNK`` at most
    rows = placed.groupBy(*group, "chunk").agg(F.sum(size).cast("long").alias("size"), held.alias("__cells"))
    return rows.select(*group, "chunk", "size", F.col("__cells.__size").alias("sizes"), *[F.col(f"__cells.{c}").alias(c) for c in columns])


def drawn_chunks(chunks: DataFrame, group: list[str], draws: DataFrame, seed: int, replace: bool) -> DataFrame:
    """``chunks`` by replicate with ``n``, the draws that fall to each; ``draws`` has rep, the group and n of the group.

    A group's chunk sizes are one row of an array: one number for ``CHUNK`` cells.
    """
    per = chunks.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("chunk", "size"))).alias("__c"))
    asked = (draws.join(per, group) if group else draws.crossJoin(per)).select("rep", *group, "n", F.col("__c.chunk").alias("__k"), F.col("__c.size").alias("__s"), F.xxhash64(F.lit("tree"), *group).alias("__g"))  # one row, if no group
    spread = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fall(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["__n"] = [split(np.asarray(s, np.int64), int(n), replace, stream(seed, r, g)) for r, g, n, s in zip(f["rep"], f["__g"], f["n"], f["__s"], strict=True)]
            yield f[["rep", *group, "__k", "__n"]]

    kinds = ", ".join(["rep long", *[f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in group], "__k array<long>", "__n array<long>"])
    fallen = asked.repartition(spread, "rep", *group).mapInPandas(fall, kinds)
    fallen = fallen.select("rep", *group, F.explode(F.arrays_zip("__k", "__n")).alias("__z")).select("rep", *group, F.col("__z.__k").alias("chunk"), F.col("__z.__n").alias("n"))
    return fallen.where("n > 0").join(chunks, [*group, "chunk"])


def cell_counts(cells: DataFrame, size: str, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(rep, <columns>, m): how often each cell is drawn when all rows are drawn with replacement, by replicate; m > 0.

    ``columns`` name the cells, each of which is there once. No cells give no rows.
    """
    spark = cells.sparkSession
    chunks = chunked(cells, [], columns, size, columns)
    n = chunks.agg(F.sum("size").alias("n"))
    draws = spark.range(replicates).select(F.col("id").alias("rep")).crossJoin(n).where("n > 0")  # one row
    asked = drawn_chunks(chunks, [], draws, seed, True)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = [split(np.asarray(s, np.int64), int(n), True, stream(seed, r, c, 1)) for r, c, n, s in zip(f["rep"], f["chunk"], f["n"], f["sizes"], strict=True)]
            hit = [np.nonzero(x)[0] for x in m]
            out = {"rep": np.repeat(f["rep"].to_numpy(), [len(h) for h in hit])}
            for c in columns:
                out[c] = [v for values, h in zip(f[c], hit, strict=True) for v in np.asarray(values, dtype=object)[h]]
            out["m"] = np.concatenate([x[h] for x, h in zip(m, hit, strict=True)] or [np.empty(0, np.int64)])
            yield pd.DataFrame(out)

    kinds = ", ".join(["rep long", *[f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in columns], "m long"])
    return asked.select("rep", "chunk", "n", "sizes", *columns).mapInPandas(count, kinds)


#: MD5's shifts and sines (fixed values).
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at a time, whose words fit a core's cache, and the longest text of one MD5 block.
BATCH, ONE_BLOCK = 16384, 55


def _first_bits(words: list) -> np.ndarray:
    """The first 48 bits of the MD5 of one-block messages; ``words`` are 16 arrays (or numbers) of 32 bits."""
    a, b, c, d = (np.full(len(words[14]), x, np.uint32) for x in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += np.uint32(_SINES[i])
        f += words[k]
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=g)
        f >>= np.uint32(32 - _SHIFTS[i])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> np.uint32(16)).astype(np.int64)


def text_draws(heads: list[bytes], tails: list[bytes]) -> Iterator[np.ndarray]:
    """For each head the 48 bits that ``resample.draw`` takes from the MD5 of head + tail, for all tails at once.

    Tails are laid out once per length of a head; texts of more than one block are hashed one by one.
    """
    size = np.array([len(t) for t in tails], np.int64)
    laid: dict[int, tuple] = {}
    for head in heads:
        h = len(head)
        if h not in laid:
            long = np.nonzero(size > ONE_BLOCK - h)[0]
            kept = np.where(size > ONE_BLOCK - h, 0, size) if h <= ONE_BLOCK else np.zeros_like(size)
            block = np.zeros((len(tails), 64), np.uint8)
            flat = np.frombuffer(b"".join(t[:k] for t, k in zip(tails, kept, strict=True)), np.uint8)
            start = np.cumsum(kept) - kept
            block[np.repeat(np.arange(len(tails)), kept), h % 64 + np.arange(len(flat)) - np.repeat(start, kept)] = flat
            block[np.arange(len(tails)), np.minimum(h + kept, ONE_BLOCK)] = 0x80
            block[:, 56:58] = ((h + kept) * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
            laid[h] = np.ascontiguousarray(block.view("<u4").T), long
        words, long = laid[h]
        first = np.frombuffer(head[:ONE_BLOCK].ljust(64, b"\0"), "<u4")
        out = _first_bits([w | x if x else w for w, x in zip(words, first, strict=True)])
        for i in long:
            out[i] = int(hashlib.md5(head + tails[i], usedforsecurity=False).hexdigest()[:12], 16)
        yield out
