"""Token counts of a byte-level vocabulary by two lookups inside the scan.

A text falls into pre-tokens by the vocabulary's own pattern, and its count is the sum over
them. The first tier is a compact table of frequent pre-tokens and their counts, broadcast
once: every vocabulary entry that is a pre-token of its own (a single token, whatever the
corpus), and the pre-tokens that a bounded sample of documents repeats, encoded on the driver.
Both are bounded by ``FREQUENT`` entries however large the corpus is. The second tier is a
worker's cache of what the first one lacked; a miss there is encoded, in batches, by the
tokenizer itself. No pre-token is ever shuffled, and the table changes the speed only, never a
count.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .encoding import slices

FREQUENT = 1 << 17
SAMPLE_DOCS = 500
CACHE = 300_000
#: Longer pre-tokens are encoded each time and kept nowhere.
KEPT_LENGTH = 256
#: The byte-level pre-tokenizer's pattern, as the vocabulary's file fixes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class FrequentTable:
    """Pre-tokens and their counts in three flat buffers: text, ends, one byte per count."""

    def __init__(self, counts: dict[str, int]):
        keys = [k for k, n in counts.items() if n < 256]
        raw = [k.encode() for k in keys]
        self.text = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.uint32)
        self.counts = bytes(counts[k] for k in keys)

    def as_dict(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.text[a:b].decode(): n for a, b, n in zip([0, *ends], ends, self.counts, strict=False)}


class WorkerCounts:
    """A worker's two tiers: ``known`` starts as the frequent table and takes in the misses."""

    def __init__(self, path: str, frequent: FrequentTable | None = None):
        self.tokenizer = load_tokenizer(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(PATTERN).findall
        self.frequent = frequent.as_dict() if frequent else {}
        self.known = dict(self.frequent)

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special tokens inside it."""
        if self.special is None or not (parts := self.special.split(text))[1:]:
            return self.split(text), 0
        return [t for p in parts for t in self.split(p)], len(parts) - 1

    def encode(self, pre_tokens: list[str]) -> dict[str, int]:
        return {t: len(e.ids) for t, e in zip(pre_tokens, self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False), strict=True)}

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        new = set().union(*[s for s, _ in split]).difference(self.known)
        if len(self.known) + len(new) > len(self.frequent) + CACHE:
            self.known = dict(self.frequent)
            new = set().union(*[s for s, _ in split]).difference(self.known)
        self.known.update(self.encode(list(new)))
        out = [sum(map(self.known.__getitem__, s)) + n for s, n in split]
        for t in new:
            if len(t) > KEPT_LENGTH:
                del self.known[t]
        return out


def frequent_table(docs: DataFrame, path: str, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> FrequentTable:
    """The first tier: the vocabulary's own pre-tokens and the repeated ones of a bounded sample."""
    worker = WorkerCounts(path)
    decode = worker.tokenizer.decode
    vocabulary = [decode([i]) for i in range(min(worker.tokenizer.get_vocab_size(), FREQUENT))]
    own = [t for t in vocabulary if "�" not in t and worker.split(t) == [t]]
    seen: Counter[str] = Counter()
    for row in docs.where(F.length(text_col) < 1 << 16).select(text_col).limit(sample_docs).toLocalIterator():
        seen.update(worker.pre_tokens(row[0])[0])
    often = [t for t, n in seen.most_common(FREQUENT) if n > 1 and len(t) <= KEPT_LENGTH]
    return FrequentTable(worker.encode(list(dict.fromkeys([*own, *often]))[:FREQUENT]))


_kept: list[tuple[FrequentTable, WorkerCounts]] = []


def _worker(path: str, frequent: FrequentTable) -> WorkerCounts:
    if not _kept or _kept[0][0] is not frequent:
        _kept[:] = [(frequent, WorkerCounts(path, frequent))]
    return _kept[0][1]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a long ``out``: the tokens that the tokenizer file gives each whole text.

    No begin, end, truncation or padding; a special string inside a text is its one token, as
    the library has it by default. A null or empty text has none. Other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, text_col))

    @F.arrow_udf(LongType())
    def run(column: pa.Array) -> pa.Array:
        worker, counts = _worker(path, shared.value), []
        for part in slices([t or "" for t in column.to_pylist()]):
            counts += worker.count(part)
        return pa.array(counts, pa.int64())

    return docs.withColumn(out, run(F.col(text_col)))
