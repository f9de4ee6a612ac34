"""Ranked lexical search of a corpus by MaxScore with bounds of term pairs.

Queries are few and documents many, so documents stay where they are. One pass folds and counts
them (``terms``) and writes, per document, its length and the queries' terms in it; sums over that
table give the statistics. A second pass takes it in shards of a bounded number of documents, each
inverted in memory: postings by term with their impacts and the greatest of them.

A query's terms are taken in pairs of neighbouring weights. For every pair the shard precomputes its
intersection list, the documents that hold both, and the greatest joint impact in it; a document
then gains at most that if it is listed, and at most the larger single maximum if it isn't. Both
are less than the sum of the maxima that independent terms allow. With the score to beat (the
k-th best so far), pairs whose bounds together stay under it are not essential: documents come
from the lists of the other pairs alone, and each is dropped as soon as its score and the bounds of
its remaining pairs, by membership in their lists, can't reach it. A document that could still tie
is scored, so the result is exact.

Tasks return their best k per query and Spark ranks them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from .common import write_table
from .terms import LETTERS_AND_DIGITS, terms_of

TOP = 50
#: Documents, and postings, of one shard in memory.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 4_000_000
#: Query terms, with repetitions over queries, that one pass over the index serves; more queries take more passes.
PASS_TERMS = 100_000
#: Entries of intersection lists that a shard keeps; beyond, a list is made again when it is needed.
PAIR_ENTRIES = 8_000_000


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """Each posting's share of a score, in 64-bit integers as defined."""
    m = 50 + (50 * length * n) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class QueryLog:
    """What shards precompute for: term weights, queries as pairs of terms, and the distinct pairs.

    A query's terms are paired in the order of their weights; an odd one stands alone.
    """

    def __init__(self, weights: list[int], queries: list[list[int]]):
        self.weights = np.array(weights, dtype=np.int64)
        self.units, self.pair_of, pairs = [], [], {}
        for terms in queries:
            ranked = sorted((t for t in terms if weights[t] > 0), key=lambda t: (weights[t], t))
            units = [(min(u), max(u)) for u in (ranked[i : i + 2] for i in range(0, len(ranked), 2))]
            self.units.append(np.array(units, dtype=np.int64).reshape(-1, 2))
            self.pair_of.append(np.array([pairs.setdefault(u, len(pairs)) if u[0] < u[1] else -1 for u in units], dtype=np.int64))
        self.pairs = list(pairs)


class Shard:
    """Some documents inverted: of each term its documents (numbers in the shard) and impacts, of each pair what both have."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, log: QueryLog, n: int, total: int):
        self.ids, self.absent, self.log = ids, absent, log
        impact = impacts(log.weights[term], tf, lengths[doc], n, total)
        order = np.argsort(term, kind="stable")  # documents ascend within a term
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(log.weights) + 1))
        self.top = np.zeros(len(log.weights), np.int64)
        held = np.nonzero(np.diff(self.starts))[0]
        if len(held):
            self.top[held] = np.maximum.reduceat(self.impact, self.starts[held])
        self._marks = np.zeros(len(ids), np.int64)
        self.joint, self.lists, kept = np.zeros(len(log.pairs), np.int64), [], 0
        for p in range(len(log.pairs)):
            both, self.joint[p] = self.intersect(p)
            kept += len(both)
            self.lists.append(both if kept <= PAIR_ENTRIES else None)

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[t], self.starts[t + 1])
        return self.doc[part], self.impact[part]

    def intersect(self, p: int) -> tuple[np.ndarray, int]:
        """The documents that hold both terms of a pair, and their greatest joint impact."""
        (da, xa), (db, xb) = (self.postings(t) for t in self.log.pairs[p])
        self._marks[da] = xa + 1
        at = self._marks[db]
        self._marks[da] = 0
        both = at > 0
        return db[both].astype(np.int32), int((at[both] - 1 + xb[both]).max(initial=0))

    def listed(self, p: int) -> np.ndarray:
        return self.intersect(p)[0] if self.lists[p] is None else self.lists[p]

    def search(self, q: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the documents that can be among the best ``k``, ties included.

        ``least`` is a score that the k-th best is known to reach.
        """
        least = max(least, 1)
        units, pair_of = self.log.units[q], self.log.pair_of[q]
        single = self.top[units].max(axis=1)  # a unit of one term names it twice
        paired = pair_of >= 0
        bounds = np.where(paired, np.maximum(single, self.joint[pair_of] if len(self.joint) else 0), single)
        order = np.argsort(bounds, kind="stable")
        units, pair_of, single, bounds = units[order], pair_of[order], single[order], bounds[order]
        reach = np.cumsum(bounds)
        scores, i = np.zeros(len(self.ids), np.int64), len(units)
        while i and reach[i - 1] >= least:
            i -= 1
            for t in set(units[i].tolist()):
                docs, x = self.postings(t)
                scores[docs] += x
            if i and k < len(scores):  # a score in part is a bound from below
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        doc = np.nonzero(scores)[0]
        score = scores[doc]
        for i in range(i - 1, -1, -1):
            before = int(reach[i - 1]) if i else 0
            alive = score + before + bounds[i] >= least
            doc, score = doc[alive], score[alive]
            if bounds[i] > single[i]:
                listed = _member(self.listed(pair_of[i]), doc)
                alive = score + before + np.where(listed, bounds[i], single[i]) >= least
                doc, score = doc[alive], score[alive]
            if not len(doc):
                break
            for t in set(units[i].tolist()):
                docs, x = self.postings(t)
                if len(docs):
                    at = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
                    score = score + np.where(docs[at] == doc, x[at], 0)
            if len(doc) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        alive = score >= least
        return doc[alive], score[alive]


def _member(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


class Best:
    """The best ``k`` so far of each query, ties by id (null after all others)."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.rows = k, [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n_queries)]

    def least(self, q: int) -> int:
        return int(self.rows[q][0][-1]) if len(self.rows[q][0]) == self.k else 0

    def add(self, q: int, *new: np.ndarray) -> None:
        """``new``: scores, ids, and whether an id is null."""
        score, ids, absent = (np.concatenate(x) for x in zip(self.rows[q], new, strict=True))
        first = np.lexsort((ids, absent, -score))[: self.k]
        self.rows[q] = score[first], ids[first], absent[first]


def _shards(batches: Iterator[pa.RecordBatch], log: QueryLog, n: int, total: int) -> Iterator[Shard]:
    parts: list[tuple[np.ndarray, ...]] = []
    rows = postings = 0

    def made() -> Shard:
        ids, absent, lengths, sizes, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Shard(ids, absent, lengths, np.repeat(np.arange(rows), sizes), term, tf, log, n, total)

    for batch in batches:
        ids, lengths, terms, tfs = (batch.column(i) for i in range(4))
        offsets, at = np.asarray(terms.offsets), 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(offsets, offsets[at] + SHARD_POSTINGS - postings, "right")) - 1
            to = min(batch.num_rows, at + SHARD_DOCS - rows, max(fit, at + (not rows)))
            of, part = slice(at, to), slice(offsets[at], offsets[to])
            parts.append((
                np.asarray(ids.fill_null(0))[of], np.asarray(ids.is_null())[of], np.asarray(lengths)[of], np.diff(offsets[at : to + 1]),
                np.asarray(terms.values)[part].astype(np.int64), np.asarray(tfs.values)[part].astype(np.int64),
            ))
            rows, postings, at = rows + to - at, postings + int(offsets[to] - offsets[at]), to
            if at < batch.num_rows or rows >= SHARD_DOCS:
                yield made()
                parts, rows, postings = [], 0, 0
    if rows:
        yield made()


def index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms with repeats, and which query terms it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, ids, tfs, offsets = [], [], [], [0]
            for value in batch.column(1):
                found = terms_of(value.as_py(), LETTERS_AND_DIGITS)
                counts = Counter(found)
                for t in counts.keys() & known.keys():
                    ids.append(known[t])
                    tfs.append(counts[t])
                n.append(len(found))
                offsets.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


@F.arrow_udf(ArrayType(BinaryType()))
def distinct_terms(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(set(terms_of(t, LETTERS_AND_DIGITS))) for t in texts.to_pylist()], pa.list_(pa.binary()))


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0.

    Equal scores go by ascending id, null ids last; ranks are unique. A term counts once in a query.
    Null and empty texts have no terms and aren't counted among the documents. Repeated documents
    are ranked each; a query id that occurs twice is ranked over both texts' rows apart, so give
    each text its id. No queries or documents give no rows. ``pass_terms`` bounds what one pass over
    the index broadcasts, never the result.
    """
    asked = queries.select(F.col(item_id).cast("long").alias("item"), distinct_terms(F.coalesce(F.col(item_text), F.lit("")).cast("binary")).alias("terms"))
    asked = write_table(asked.where(F.size("terms") > 0), "queries")
    words = asked.agg(F.sum(F.size("terms")).alias("w")).first()["w"] or 0
    passes = max(1, -(-words // pass_terms))
    out = None
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == i).collect()  # about ``pass_terms`` terms
        found = _pass(docs, [(r["item"], [bytes(t) for t in r["terms"]]) for r in own], k, doc_id, text)
        out = found if out is None else out.unionByName(found)
    return out


def _pass(docs: DataFrame, asked: list[tuple[int, list[bytes]]], k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    table = write_table(index(docs, vocabulary, doc_id, text), "index")
    size = table.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("total")).first()
    df = {r["t"]: r["df"] for r in table.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # query terms
    n, total = size["n"], max(size["total"] or 0, 1)
    log = QueryLog([weight_of(n, df.get(i, 0)) for i in range(len(vocabulary))], [[vocabulary[t] for t in terms] for _, terms in asked])
    shared = spark.sparkContext.broadcast((log, [item for item, _ in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, items = shared.value
        best = Best(k, len(items))
        for shard in _shards(batches, log, n, total):
            for q in range(len(items)):
                doc, score = shard.search(q, k, best.least(q))
                if len(doc):
                    best.add(q, score, shard.ids[doc], shard.absent[doc])
        for q, (score, ids, absent) in enumerate(best.rows):
            if len(score):
                columns = [pa.array([x] * len(score), pa.int64()) for x in (q, items[q])] + [pa.array(ids, mask=absent), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["q", "item_id", "doc_id", "score"])

    found = table.where(F.size("terms") > 0).mapInArrow(run, "q long, item_id long, doc_id long, score long")
    place = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
