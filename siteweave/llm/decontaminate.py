"""Benchmark decontamination: BM25 over test items with block-max WAND, every passage a query.

The inverted index holds the test items. A passage is two neighbouring stretches of ``stride``
words, so that every run of ``stride`` words lies whole in one; the stride is the least power of
two (16 at least) that the item's own length doesn't exceed, so items of different length classes
meet passages of different lengths, and no item changes another's passages.

A retrieved item counts as leaked if its five-word shingles are in the passage: 0.8 of all of
them, or 0.8 of both the question's (all sentences but the last) and the answer's (the last).
The retrieval threshold follows from that rule. At most as many of an item's terms can be absent
as shingles may be, so a passage that satisfies the rule has at least the item's own BM25 score
less its largest weights, that many of them (``least_score``). Where a few rare terms hold nearly
all of an item's score, as in items made from one template, that leaves almost nothing. Such an
item (``LEAST_SHARE``) is retrieved by how many of its shingles each term touches instead, whatever
the terms' frequencies (``touched``): once for the whole text and once for question and answer, the
two ways to satisfy the rule; BM25 stays its reported score. Impacts are divided by the least sum,
so the threshold is 1 for all items; retrieval is complete, and which items leak doesn't depend on
the weights, on other items, or on how the items are dealt to shards.

Block-max WAND runs in batches: each passage has a cursor per term, ordered by the item that it
stands on. The pivot is the first item at which the terms' greatest impacts reach the threshold;
if the maxima of its block don't, all cursors before it skip to the end of the block (or to the
next cursor); otherwise they move to the pivot, which is scored. Each step handles one pivot of
every passage that is still open.

Shards are built in tasks and hold a bounded number of words. A benchmark of one shard is
broadcast and looked up in the scan. For a larger one a scan of the texts serves ``SCAN_SHARDS``
shards: it keeps the texts that share a shingle with any of their items, as every text does that
satisfies the rule, and these alone meet the shards, each broadcast in turn. A text's hits come
together by its hash.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from .common import fresh_name, write_table
from .encoding import slices

OVERLAP, SHINGLE = 0.8, 5
K1, B, BLOCK, LEAST_STRIDE = 1.2, 0.75, 8, 16
#: Words of test items in one index; a larger benchmark is split into several.
SHARD_WORDS = 1_000_000
#: Shards for whose items one scan looks: 8 bytes a shingle and about a shingle a word are broadcast.
SCAN_SHARDS = 16
#: Multiplier of the rolling hash of word hashes, modulo 2^64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Cursors that a task moves at a time.
CURSORS = 1 << 18
HITS = "array<struct<item_id:bigint,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"
FIELDS = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
SLACK = 1e-9
#: Items whose least score is a smaller share of their own are retrieved by the shingles that their terms touch.
LEAST_SHARE = 0.1

words_of = re.compile(r"\w+").findall


def shingles(words: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def share(part: list[str], passage: list[str]) -> float:
    """The share of a part's shingles that the passage has; a short part is one shingle, none is whole."""
    width = min(SHINGLE, len(part))
    own = shingles(part, width) if width else set()
    return len(own & shingles(passage, width)) / len(own) if own else 1.0


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """All sentences but the last, and the last; of a single sentence the last quarter of the words."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(p)]
    if len(parts) > 1:
        return words_of(" ".join(parts[:-1]).lower()), words_of(parts[-1].lower())
    words = words_of(text.lower())
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def leaks(shares: list[float]) -> bool:
    """The rule, on the shares of all shingles, the question's and the answer's."""
    return shares[0] >= OVERLAP or min(shares[1:]) >= OVERLAP


def absent_terms(part: list[str]) -> int:
    """The most distinct terms of a part that a passage with enough of its shingles can lack.

    k absent words touch at least k shingles. Where shingles repeat, the words of the first four
    places may share theirs with others, so four more are allowed.
    """
    width = min(SHINGLE, len(part))
    own = len(shingles(part, width)) if width else 0
    lacking = own - int(np.ceil(OVERLAP * own - SLACK))
    return lacking if not lacking or own == len(part) - width + 1 else lacking + SHINGLE - 1


def least_score(weights: dict[str, float], parts: list[list[str]]) -> float:
    """The share of an item's own score that every passage which satisfies the rule reaches."""
    top = lambda part: sum(sorted((weights[w] for w in set(part)), reverse=True)[: absent_terms(part)])
    whole, question, answer = map(top, parts)
    return 1 - max(whole, question + answer) / sum(weights.values()) - SLACK


def touched(parts: list[list[str]]) -> tuple[dict[str, float], float]:
    """How many distinct shingles of the parts each term is in, and the least sum over a passage with enough of each part.

    A shingle that lacks k of its terms takes k from the sum, all of its terms at most; so a passage
    loses at most the largest shingles, as many as each part may lack.
    """
    counts: Counter[str] = Counter()
    least = 0
    for part in parts:
        own = [set(s) for s in shingles(part, min(SHINGLE, len(part)))] if part else []
        for terms in own:
            counts.update(terms)
        least += sum(sorted(map(len, own))[: int(np.ceil(OVERLAP * len(own) - SLACK))])
    return {w: float(n) for w, n in counts.items()}, least * (1 - SLACK)


def word_hashes(split: list[list[str]]) -> list[np.ndarray]:
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*split)}
    return [np.fromiter(map(known.get, words), dtype=np.uint64, count=len(words)) for words in split]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words by their hashes; runs of different widths differ."""
    out = np.full(max(0, len(words) - width + 1), width, dtype=np.uint64)
    for i in range(width):
        out = out * FACTOR + words[i : i + len(out)]
    return out


def signs(text: str) -> tuple[set[int], np.ndarray]:
    """Widths and hashes of shingles of an item, one of which at least is in every passage that satisfies the rule.

    Those of the whole text, and of the question for a passage that has enough of question and
    answer; of the answer, if there is no question.
    """
    question, answer = question_and_answer(text)
    parts = [words_of(text.lower()), question or answer]
    widths = [min(SHINGLE, len(p)) for p in parts]
    return set(widths), np.concatenate([shingle_hashes(h, w) for h, w in zip(word_hashes(parts), widths, strict=True)])


def stride_of(n_words: int) -> int:
    return max(LEAST_STRIDE, 1 << (n_words - 1).bit_length())


class Index:
    """Posting lists of test items of one length class; ``df`` and the averages come from all items."""

    def __init__(self, stride: int, items: list[tuple[int, list[str], str, int]], df: dict[str, int], total: int, average: float):
        self.stride, self.items = stride, []
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for item, words, text, copies in items:
            weights = {
                w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / average))
                for w, n in Counter(words).items()
            }
            parts = [words, *question_and_answer(text)]
            own = sum(weights.values())
            shares = {w: x / own for w, x in weights.items()}
            least = least_score(weights, parts)
            place = len(self.items)  # of the item; one that is there twice has two numbers
            for impact, bound in [(shares, least)] if least >= LEAST_SHARE else [touched(parts[:1]), touched(parts[1:])]:
                for w, x in impact.items():
                    if (t := self.terms.setdefault(w, len(self.terms))) == len(postings):
                        postings.append([])
                    postings[t].append((len(self.items), x / bound))
                self.items.append((place, item, copies, shares, parts))
        sizes = np.array([len(p) for p in postings], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.who = np.array([j for p in postings for j, _ in p], dtype=np.int64)
        self.impact = np.array([x for p in postings for _, x in p])
        term = np.repeat(np.arange(len(sizes)), sizes)
        self.top = np.maximum.reduceat(self.impact, self.starts[:-1])
        self.n = len(self.items) + 1
        self.places = term * self.n + self.who
        self.blocks = self.n // BLOCK + 1
        keys = term * self.blocks + self.who // BLOCK
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.block_keys = keys[first]
        self.block_top = np.maximum.reduceat(self.impact, np.nonzero(first)[0])

    def seek(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The item of each term's first posting at or after ``item``; the end's number where there is none."""
        at = np.searchsorted(self.places, term * self.n + item)
        found = self.who[np.minimum(at, len(self.who) - 1)]
        return np.where(at < self.starts[term + 1], found, self.n - 1)

    def impact_at(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        key = term * self.n + item
        at = np.minimum(np.searchsorted(self.places, key), len(self.places) - 1)
        return np.where(self.places[at] == key, self.impact[at], 0.0)

    def block_max(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        key = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.block_keys, key), len(self.block_keys) - 1)
        return np.where(self.block_keys[at] == key, self.block_top[at], 0.0)

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> list[tuple[int, int]]:
        """(passage, item) with a sum of impacts of 1 or more, by block-max WAND.

        ``passage`` ascends; each (passage, term) is there once.
        """
        item = self.who[self.starts[term]] if len(term) else term
        end, found = self.n - 1, []
        while len(passage):
            order = np.argsort(passage * self.n + item, kind="stable")
            passage, term, item = passage[order], term[order], item[order]
            heads = np.nonzero(np.concatenate(([True], passage[1:] != passage[:-1])))[0]
            sizes = np.diff(np.append(heads, len(passage)))
            summed = np.cumsum(self.top[term])
            summed -= np.repeat(summed[heads] - self.top[term[heads]], sizes)
            reach = np.where(summed >= 1 - SLACK, item, end)
            pivot = np.minimum.reduceat(reach, heads)
            at_pivot = np.repeat(pivot, sizes)
            open_ = at_pivot < end
            passage, term, item, at_pivot = passage[open_], term[open_], item[open_], at_pivot[open_]
            if not len(passage):
                break
            heads = np.nonzero(np.concatenate(([True], passage[1:] != passage[:-1])))[0]
            sizes = np.diff(np.append(heads, len(passage)))
            before = item <= at_pivot
            bound = np.zeros(len(item))
            bound[before] = self.block_max(term[before], at_pivot[before] // BLOCK)
            promising = np.add.reduceat(bound, heads) >= 1 - SLACK
            good = np.repeat(promising, sizes)
            scored = before & good
            value = np.zeros(len(item))
            value[scored] = self.impact_at(term[scored], at_pivot[scored])
            score = np.add.reduceat(value, heads)
            for k in np.nonzero(promising & (score >= 1 - SLACK))[0].tolist():
                found.append((int(passage[heads[k]]), int(at_pivot[heads[k]])))
            later = np.minimum.reduceat(np.where(before, end, item), heads)
            skip = np.minimum((at_pivot // BLOCK + 1) * BLOCK, np.repeat(later, sizes))
            goal = np.minimum(np.where(good, at_pivot + 1, skip), end)
            item[before] = self.seek(term[before], goal[before])
            left = item < end
            passage, term, item = passage[left], term[left], item[left]
        return found

    def candidates(self, ids: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, stretch, item) that retrieval finds; ``ids`` holds -1 for words of no item."""
        stretches = [len(i) // self.stride + 1 for i in ids]
        base = np.concatenate(([0], np.cumsum(stretches)))
        flat = np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64)
        text = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        cell = np.concatenate([np.arange(len(i)) // self.stride for i in ids] or [np.empty(0, int)]) + base[text]
        known = flat >= 0
        flat, cell = flat[known], cell[known]
        if not len(flat):
            return []
        # Without the terms' repetitions taken out this bounds a passage's score from above.
        loads = np.bincount(cell, self.top[flat], base[-1] + 1)
        first = np.zeros(base[-1] + 1, bool)
        first[base] = True
        hopeful = loads + np.where(np.append(first[1:], True), 0.0, np.append(loads[1:], 0.0)) >= 1 - SLACK
        after = ~first[cell] & hopeful[cell - 1]
        own = hopeful[cell]
        passage, term = np.concatenate((cell[own], cell[after] - 1)), np.concatenate((flat[own], flat[after]))
        pairs = np.unique(passage * len(self.top) + term)
        passage, term = pairs // len(self.top), pairs % len(self.top)
        found = []
        for part in self._parts(passage):
            for p, item in self.retrieve(passage[part], term[part]):
                doc = int(np.searchsorted(base, p, "right")) - 1
                found.append((doc, p - int(base[doc]), item))
        return found

    @staticmethod
    def _parts(passage: np.ndarray):
        """Runs of whole passages of about ``CURSORS`` cursors."""
        at = 0
        while at < len(passage):
            to = int(np.searchsorted(passage, passage[min(at + CURSORS, len(passage)) - 1], "right"))
            yield slice(at, to)
            at = to

    def hits(self, split: list[list[str]], ids: list[np.ndarray]) -> list[list[dict]]:
        """The leaked items of each text's words, with their best passage's score and overlaps."""
        out: list[dict[int, dict]] = [{} for _ in split]
        for doc, stretch, item in self.candidates(ids):
            place, name, copies, weights, parts = self.items[item]
            passage = split[doc][stretch * self.stride : (stretch + 2) * self.stride]
            shares = [share(p, passage) for p in parts]
            if leaks(shares):
                score = sum(weights.get(w, 0.0) for w in sorted(set(passage)))
                if score > out[doc].get(place, {"score": -1})["score"]:
                    out[doc][place] = dict(zip(FIELDS, (name, score, *shares), strict=True)) | {"copies": copies}
        return [[r for o in found.values() for r in [{k: o[k] for k in FIELDS}] * o["copies"]] for found in out]


class Shard:
    """The indexes of some items, one per length class, over one vocabulary."""

    def __init__(self, items: list[tuple[int, str, int]], df: dict[str, int], total: int, average: float):
        classes: dict[int, list] = {}
        for item, text, copies in items:
            if words := words_of(text.lower()):
                classes.setdefault(stride_of(len(words)), []).append((item, words, text, copies))
        self.indexes = [Index(stride, rows, df, total, average) for stride, rows in sorted(classes.items())]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in self.indexes for w in x.terms}))}
        self.local = [np.array([x.terms.get(w, -1) for w in self.vocabulary] + [-1]) for x in self.indexes]

    def hits(self, texts: list[str]) -> list[list[dict]]:
        split = [words_of(t.lower()) for t in texts]
        ids = [np.fromiter(map(self.vocabulary.get, w, repeat(-1)), dtype=np.int64, count=len(w)) for w in split]
        out: list[list[dict]] = [[] for _ in texts]
        for index, local in zip(self.indexes, self.local, strict=True):
            for row, found in zip(out, index.hits(split, [local[i] for i in ids]), strict=True):
                row += found
        return out


def build_shards(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, body, widths, keys): pickled indexes of about ``shard_words`` words at most each, built in tasks, and their items' ``signs``."""

    @F.arrow_udf(ArrayType(StringType()))
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array([words_of((t or "").lower()) for t in texts.to_pylist()], pa.list_(pa.string()))

    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("body"))
    items = items.groupBy("item", "body").agg(F.count("*").alias("copies")).withColumn("words", tokens("body")).where("size(words) > 0")
    items = write_table(items, "items")
    size = items.agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.size("words")).alias("words")).first()
    if not size["n"]:
        return items.select(F.lit(0).cast("long").alias("shard"), F.lit(b"").alias("body"), F.array(F.lit(0)).alias("widths"), F.lit(b"").alias("keys")).limit(0)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item", "body"), F.lit(-(-size["words"] // shard_words))))
    terms = items.select("item", "body", "copies", F.explode(F.array_distinct("words")).alias("term"))
    df = terms.groupBy("term").agg(F.sum("copies").alias("df"))
    known = terms.join(df, "term").groupBy("item", "body").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))  # an item's terms
    keyed = known.withColumnRenamed("item", "i").withColumnRenamed("body", "b")
    rows = items.join(keyed, F.col("item").eqNullSafe(F.col("i")) & (F.col("body") == F.col("b"))).select("item", "body", "copies", "shard", "df")
    n, average = size["n"], size["words"] / size["n"]

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["item", "body"])
        known = {t: c for pairs in f["df"] for t, c in dict(pairs).items()}
        of = [(None if pd.isna(i) else int(i), b, int(c)) for i, b, c in zip(f["item"], f["body"], f["copies"], strict=True)]
        widths, hashes = zip(*[signs(b) for b in f["body"]], strict=True)
        row = (int(key[0]), pickle.dumps(Shard(of, known, n, average)), sorted(set().union(*widths)), np.unique(np.concatenate(hashes)).tobytes())
        return pd.DataFrame([row], columns=["shard", "body", "widths", "keys"])

    return rows.groupBy("shard").applyInPandas(build, "shard long, body binary, widths array<int>, keys binary")


def sharing(texts: DataFrame, body: str, shards: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose column ``body`` has a shingle of the ``signs`` of ``shards``, as a written table."""
    rows = shards.select("widths", "keys").collect()  # 8 bytes a shingle, SCAN_SHARDS rows at most
    widths = sorted({w for r in rows for w in r["widths"]})
    keys = np.unique(np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in rows]))
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def meets(words: np.ndarray) -> bool:
        for width in widths:
            own = shingle_hashes(words, width)
            at = np.minimum(np.searchsorted(shared.value, own), len(shared.value) - 1)
            if (shared.value[at] == own).any():
                return True
        return False

    @F.arrow_udf(BooleanType())
    def run(column: pa.Array) -> pa.Array:
        out: list[bool] = []
        for part in slices([t or "" for t in column.to_pylist()]):
            out += map(meets, word_hashes([words_of(t.lower()) for t in part]))
        return pa.array(out, pa.bool_())

    found = write_table(texts.where(run(F.col(body))), "near")
    shared.destroy()
    return found


def _lookup(spark, body: bytearray):
    shared = spark.sparkContext.broadcast(bytes(body))

    @F.arrow_udf(HITS)
    def run(texts: pa.Array) -> pa.Array:
        shard, found = _shard(shared), []
        for part in slices([t or "" for t in texts.to_pylist()]):
            found += shard.hits(part)
        fields = [("item_id", pa.int64()), *((f, pa.float64()) for f in FIELDS[1:])]
        return pa.array(found, pa.list_(pa.struct(fields)))

    return shared, run


_kept: list[tuple[bytes, Shard]] = []


def _shard(shared) -> Shard:
    """The last broadcast shard of this process, unpickled once."""
    if not _kept or _kept[0][0] is not shared.value:
        _kept[:] = [(shared.value, pickle.loads(shared.value))]
    return _kept[0][1]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", out: str = "hits", shard_words: int = SHARD_WORDS, scan_shards: int = SCAN_SHARDS) -> DataFrame:
    """``docs`` with an array ``out`` of the test items leaked into each whole text.

    Null or empty texts and items leak nothing; a repeated item is reported as often as it is
    there; an empty benchmark gives empty arrays. Parts shorter than a shingle count as one
    shingle. Other columns and all rows pass through; a column named like ``out`` is replaced.
    ``shard_words`` bounds an index's memory, ``scan_shards`` that of a scan; neither ever changes a hit.
    """
    spark = docs.sparkSession
    shards = write_table(build_shards(benchmark, item_col, item_text_col, shard_words), "shards")
    names = [r["shard"] for r in shards.select("shard").orderBy("shard").collect()]
    load = lambda name: shards.where(F.col("shard") == name).first()["body"]
    empty = F.array().cast(HITS)
    if len(names) <= 1:
        return docs.withColumn(out, _lookup(spark, load(names[0]))[1](F.col(text_col)) if names else empty)
    key, body = fresh_name(docs, "key"), fresh_name(docs, "body")
    digest = F.md5(F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(digest.alias(key), F.col(text_col).alias(body))
    found = near = None
    for i, name in enumerate(names):
        if i % scan_shards == 0:
            near = sharing(texts, body, shards.where(F.col("shard").isin(names[i : i + scan_shards])))
        shared, run = _lookup(spark, load(name))
        some = near.select(key, run(F.col(body)).alias(out)).where(F.size(out) > 0).dropDuplicates([key])
        some = write_table(some, "hits")
        shared.destroy()
        found = some if found is None else found.unionByName(some)
    merged = write_table(found.groupBy(key).agg(F.flatten(F.collect_list(out)).alias(out)), "hits")  # a row per shard at most
    rest = docs.drop(out).withColumn(key, digest)
    return rest.join(merged, key, "left").drop(key).withColumn(out, F.coalesce(out, empty))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a test item; columns stay as they are."""
    hits = fresh_name(docs, "hits")
    return with_hits(docs, benchmark, text_col, out=hits).where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
