"""Audit of how far the sources of a language diverge in their terms.

Each document is folded and cut by a translate table (``terms``), and a ``Counter`` of its terms
gives frequencies; a task adds them up sparsely per language and source, in runs of a bounded
number of entries, and Spark sums what the tasks send. No step sees a whole language or source.

A group's distribution over its language's kept terms is smoothed: p = 1 + floor(1e9 (count + 2)
/ (N + 2 V)). Two groups differ by the sum over all kept terms of floor((p - q)^2 / (p + q)).
Most terms are missing from most sources, so the sum is put together from sparse parts:

* every term of a group against the other's value of a missing term, from the group's histogram
  of values (a few hundred values stand for all terms);
* terms of neither group, by their number;
* for terms of both, what the first two parts got wrong, summed inside tasks.

Everything is integer arithmetic.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.resample import numbered
from .common import write_table
from .terms import LETTERS, terms_of

SCALE = 1_000_000_000
LEAST_DOCS, TOP = 10, 10
#: Entries that a task gathers before it adds them up.
ENTRIES = 1_000_000


def _summed(found: dict[tuple[str, str], tuple[list[bytes], list[int]]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (terms, counts) in found.items():
        coded = pa.array(terms, pa.binary()).dictionary_encode()
        at = np.asarray(coded.indices)
        n = np.bincount(at, weights=np.array(counts, dtype=np.float64)).astype(np.int64)  # far below 2^53
        columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), coded.dictionary, pa.array(n), pa.array(np.bincount(at).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[str, str], tuple[list[bytes], list[int]]] = {}
    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            counts = Counter(terms_of(text.as_py(), LETTERS))
            if counts:
                terms, ns = found.setdefault((lang.as_py(), source.as_py()), ([], []))
                terms += counts.keys()
                ns += counts.values()
                entries += len(counts)
            if entries >= ENTRIES:
                yield from _summed(found)
                found, entries = {}, 0
    yield from _summed(found)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by language and source; null is ''."""
    rows = docs.select(
        F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).cast("binary").alias("text")
    )
    some = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def smoothed(n: Column, total: str = "total", v: str = "v") -> Column:
    """p of a term with ``n`` occurrences, exact at any size."""
    up = (n.cast("decimal(25,0)") + 2) * F.lit(SCALE)
    down = F.col(total) + 2 * F.col(v)
    return F.lit(1) + F.call_function("div", up.cast("decimal(38,0)"), down.cast("decimal(38,0)"))


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of longs up to 1e9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _blocks(k: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs i < j below ``k``, about ``most`` at a time."""
    i = 0
    while i < k - 1:
        to, n = i, 0
        while to < k - 1 and (not n or n + k - 1 - to <= most):
            n, to = n + k - 1 - to, to + 1
        rows = np.arange(i, to)
        yield np.repeat(rows, k - 1 - rows), np.concatenate([np.arange(r + 1, k) for r in rows])
        i = to


def _floor_ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of groups a < b the sum over shared terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

    A row is a term: its groups' numbers (ascending), their p, and their p of a missing term.
    """
    width = 1 << 31
    kept = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), pa.array(values)], ["a", "b", "shared"])

    for batch in batches:
        cells = batch.column(0)
        sizes, starts = np.diff(np.asarray(cells.offsets)), np.asarray(cells.offsets)[:-1]
        group, p, none = (np.asarray(cells.values.field(i)) for i in range(3))
        parts = [kept]
        for k in np.unique(sizes[sizes > 1]).tolist():
            rows = starts[sizes == k]
            for i, j in _blocks(k):
                step = max(1, (1 << 20) // len(i))
                for at in range(0, len(rows), step):
                    a, b = (rows[at : at + step, None] + x[None, :] for x in (i, j))
                    f = _floor_ratio
                    value = f(p[a], p[b]) - f(p[a], none[b]) - f(none[a], p[b]) + f(none[a], none[b])
                    parts.append(_add_up((group[a] * width + group[b]).ravel(), value.ravel()))
        kept = _add_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        if len(kept[0]) > ENTRIES:
            yield out(*kept)
            kept = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(kept[0]):
        yield out(*kept)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source that occurs.

    Part ``pair``: the divergence from each other source of the language. Part ``term``: the ``top``
    terms that the group uses more than its language does. Ranks go by value, then by item.

    A language keeps the terms in at least ``least_docs`` of its documents; repeated rows are
    documents of their own. Null text, language and source are ''. Groups without terms get their
    pairs (0 where the language keeps no term) and no terms; a language of one source has no pairs;
    no documents give no rows. Other columns don't matter.
    """
    counts = term_counts(docs, text, lang, source)
    cell = F.struct("source", "n")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(cell).alias("cells"))  # a cell per source
    kept = write_table(kept.where(F.col("docs") >= least_docs), "terms")
    languages = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    used = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"), F.count("*").alias("n_terms"))
    there = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    groups = there.join(used, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "n_terms", "v", "lang_total"])
    none = F.when(F.col("v") > 0, smoothed(F.lit(0))).otherwise(1)
    groups = write_table(numbered(groups, ["lang", "source"], "g").withColumn("none", none), "groups")

    own = groups.select("lang", "source", "g", "total", "v", "lang_total", "none")
    cells = kept.select("lang", "term", "all", F.explode("cells").alias("c")).select("lang", "term", "all", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    cells = cells.join(own, ["lang", "source"]).select("lang", "term", "g", "none", smoothed(F.col("n")).alias("p"), smoothed(F.col("all"), "lang_total").alias("q"))
    cells = write_table(cells, "cells")

    over = cells.where("p > q").select("g", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    best = best.join(groups.select("g", "lang", "source"), "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    b = groups.select("lang", F.col("g").alias("b"), F.col("source").alias("item"), F.col("none").alias("none_b"), F.col("n_terms").alias("terms_b"))
    values = cells.groupBy("lang", F.col("g").alias("a"), "p").agg(F.count("*").alias("times"))
    sided = values.join(b, "lang").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("times") * difference(F.col("p"), F.col("none_b"))).alias("side"))
    sided = write_table(sided, "sides")  # a row per pair of the result
    of_term = F.sort_array(F.collect_list(F.struct("g", "p", "none")))
    shared = cells.groupBy("lang", "term").agg(of_term.alias("cells")).where(F.size("cells") > 1).select("cells")
    shared = shared.mapInArrow(_corrections, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    a = groups.select("lang", F.col("g").alias("a"), "source", F.col("none").alias("none_a"), F.col("n_terms").alias("terms_a"), "v")
    pairs = a.join(b, "lang").where("a <> b").withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b")})
    pairs = pairs.join(sided, ["a", "b"], "left").join(sided.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("side").alias("other_side")), ["a", "b"], "left")
    pairs = pairs.join(shared.select(F.col("a").alias("low"), F.col("b").alias("high"), "shared"), ["low", "high"], "left")
    neither = (F.col("v") - F.col("terms_a") - F.col("terms_b")) * difference(F.col("none_a"), F.col("none_b"))
    value = neither + sum((F.coalesce(c, F.lit(0)) for c in ("side", "other_side", "shared")), F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, value).otherwise(0).alias("value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
