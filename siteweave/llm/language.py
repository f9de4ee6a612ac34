"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum, over all ways to cut it into pieces, of the product of the pieces'
probabilities; the forward algorithm gives it in one pass over the word, rescaled as it goes, so
that words of any length stay within doubles. Long words are first cut where no piece holds the
two characters: no segmentation crosses such a place, so the product of the parts is exact. A
text's score for a language is the sum of its words' log-probabilities; softmax turns the scores
into a posterior.

Probabilities are learned by expectation-maximisation. ``DOCS_PER_LANG`` bounds the labelled
documents of each language that take part (chosen by a hash of the id, in expectation that
many); everything else, scoring above all, covers every row and whole texts.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import write_table
from .encoding import SPACE, slices
from .pieces import PieceTable, code_matrix, equal_lengths, load_pieces

DOCS_PER_LANG = 400
ROUNDS = 3
#: Longer words are cut where no piece crosses; places between two rescalings, and of a long word at a time.
LONG, RESCALE, STRETCH = 32, 16, 1 << 14
#: A code point that no piece covers, and what each piece counts besides its expected count.
UNSEEN, SMOOTH = 1e-7, 0.1
#: Words that a worker keeps, and the length up to which it keeps them.
CACHE_WORDS, KEPT_LENGTH = 200_000, 256

_LETTER = regex.compile(r"\p{L}")


def words_of(text: str) -> list[str]:
    """Lower-cased words, marked after a space."""
    return (SPACE + text.lower().replace(SPACE, " ").replace(" ", " " + SPACE)).split()


class Lattice:
    """Forward sums over all segmentations, for any number of languages at once."""

    def __init__(self, pieces: list[str]):
        self.table = PieceTable(pieces, list(range(len(pieces))))
        self.pieces, self.size = pieces, len(pieces)
        self.inside = {p[j : j + 2] for p in pieces for j in range(len(p) - 1)}

    def split(self, text: str) -> list[str]:
        """The words of a text; long ones in parts that no piece crosses."""
        words = words_of(text) if text.strip() else []
        if max(map(len, words), default=0) <= LONG:
            return words
        return [part for w in words for part in ([w] if len(w) <= LONG else self._cut(w))]

    def _cut(self, word: str) -> list[str]:
        out, at = [], 0
        for j in range(1, len(word)):
            if word[j - 1 : j + 1] not in self.inside:
                out.append(word[at:j])
                at = j
        return [*out, word[at:]]

    def _arcs(self, codes: np.ndarray) -> list:
        arcs = self.table.lattice(codes)
        arcs[1] = np.where(arcs[1] < 0, self.size, arcs[1])
        return arcs

    def log_probability(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """(words, languages). ``prob`` is (pieces + 1, languages), the last row for the unseen."""
        out, where = np.empty((len(words), prob.shape[1])), {w: i for i, w in enumerate(words)}
        for group in equal_lengths(words):
            out[[where[w] for w in group]] = self._forward(code_matrix(group, len(group[0])), prob)
        return out

    def _forward(self, codes: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Log of the sum over all segmentations of words of one length, with the last places' sums alone in memory."""
        count, n, width = codes.shape[0], codes.shape[1], self.table.width
        ring = np.zeros((width + 1, count, prob.shape[1]))
        ring[0] = 1.0
        logs = np.zeros((count, prob.shape[1]))
        for first in range(0, n, STRETCH):
            # Arcs that end in this stretch start up to ``width`` places before it.
            low = max(0, first - width)
            arcs = self._arcs(codes[:, low : first + STRETCH])
            for end in range(first + 1, min(first + STRETCH, n) + 1):
                now = ring[end % (width + 1)]
                for length in range(1, min(end, len(arcs) - 1) + 1):
                    piece, before = arcs[length][:, end - length - low], ring[(end - length) % (width + 1)]
                    if length == 1:
                        np.multiply(before, prob[piece], out=now)
                    elif len(at := np.nonzero(piece >= 0)[0]):
                        now[at] += before[at] * prob[piece[at]]
                if end % RESCALE == 0:
                    top = ring.max(axis=0)
                    ring /= top
                    logs += np.log(top)
        return logs + np.log(ring[n % (width + 1)])

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, taken ``counts`` times; ``prob`` is (pieces + 1,).

        Forward and backward sums are kept as logarithms.
        """
        out, where, log_prob = np.zeros(self.size + 1), {w: i for i, w in enumerate(words)}, np.log(prob)
        for group in equal_lengths(words):
            n = len(group[0])
            arcs = self._arcs(code_matrix(group, n))
            alpha = np.full((len(group), n + 1), -np.inf)
            alpha[:, 0] = 0.0
            for end in range(1, n + 1):
                for length in range(1, min(end, len(arcs) - 1) + 1):
                    piece = arcs[length][:, end - length]
                    at = np.nonzero(piece >= 0)[0]
                    alpha[at, end] = np.logaddexp(alpha[at, end], alpha[at, end - length] + log_prob[piece[at]])
            beta = np.full_like(alpha, -np.inf)
            beta[:, n] = 0.0
            weight, whole = counts[[where[w] for w in group]], alpha[:, n]
            for start in range(n - 1, -1, -1):
                for length in range(1, min(n - start, len(arcs) - 1) + 1):
                    piece = arcs[length][:, start]
                    at = np.nonzero(piece >= 0)[0]
                    used = log_prob[piece[at]] + beta[at, start + length]
                    beta[at, start] = np.logaddexp(beta[at, start], used)
                    out += np.bincount(piece[at], np.exp(alpha[at, start] + used - whole[at]) * weight[at], self.size + 1)
        return out


class Scorer:
    """A worker's scorer: languages, probabilities and the words scored so far."""

    def __init__(self, lattice: Lattice, langs: list[str], prob: np.ndarray):
        self.lattice, self.langs, self.prob = lattice, langs, prob
        self.index: dict[str, int] = {}
        self.logs = np.empty((0, len(langs)))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text in each language."""
        split = [self.lattice.split(t) for t in texts]
        new = list(set().union(*split).difference(self.index))
        if len(self.index) + len(new) > CACHE_WORDS:
            self.index.clear()
            self.logs = self.logs[:0]
            new = list(set().union(*split))
        self.index.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        if new:
            self.logs = np.concatenate((self.logs, self.lattice.log_probability(new, self.prob)))
        out = np.zeros((len(texts), len(self.langs)))
        for i, words in enumerate(split):
            if words:
                out[i] = self.logs[list(map(self.index.__getitem__, words))].sum(axis=0)
        if any(len(w) > KEPT_LENGTH for w in new):
            self.index.clear()
            self.logs = self.logs[:0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its posterior; ``und`` and 0 without a letter."""
        real = [t or "" for t in texts]
        logs = np.concatenate([self.scores(part) for part in slices(real)] or [np.zeros((0, len(self.langs)))])
        best = logs.argmax(axis=1) if len(self.langs) else np.zeros(len(real), int)
        post = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1) if len(self.langs) else np.zeros(len(real))
        said = [bool(self.langs) and _LETTER.search(t) is not None for t in real]
        return [self.langs[b] if s else "und" for b, s in zip(best, said, strict=True)], np.where(said, post, 0.0)


def learn(docs: DataFrame, pieces_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          docs_per_lang: int = DOCS_PER_LANG, rounds: int = ROUNDS) -> Scorer:
    """Fit on labelled ``docs``. Rows with a null text, language or id take no part.

    At most about ``docs_per_lang`` documents of a language are read into the counts. The
    languages and the 32,000 pieces bound what the driver gets.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(F.col(lang_col).alias("lang")).count()
    share = {r["lang"]: docs_per_lang / r["count"] for r in sizes.collect()}
    langs = sorted(share)
    names, _, ordinary = load_pieces(pieces_path)
    pieces = sorted({p.lower() for p, o in zip(names, ordinary, strict=True) if o and p.strip(SPACE)} | {SPACE})
    lattice = Lattice(pieces)
    prob = np.full((lattice.size + 1, len(langs)), 1.0 / max(1, lattice.size))
    prob[-1] = UNSEEN
    if not langs:
        return Scorer(lattice, langs, prob)
    take = F.create_map([x for lang in langs for x in (F.lit(lang), F.lit(share[lang]))])
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit("learn")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(chance < take[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    fixed = spark.sparkContext.broadcast(lattice)

    def count(batches):
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in fixed.value.split(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long")
    words = write_table(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def expect(batches, now=now):
            for batch in batches:
                lang = np.array(batch.column(0).to_pylist(), dtype=object)
                word = np.array(batch.column(1).to_pylist(), dtype=object)
                n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                for k, name in enumerate(langs):
                    at = np.nonzero(lang == name)[0]
                    if len(at):
                        got = fixed.value.expected(word[at].tolist(), n[at], now.value[:, k])
                        some = np.nonzero(got)[0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), k)), pa.array(some), pa.array(got[some])], names=["lang", "piece", "n"]
                        )

        summed = words.mapInArrow(expect, "lang long, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        got = summed.toPandas()
        counts = np.full((lattice.size + 1, len(langs)), SMOOTH)
        counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        prob = counts / counts[:-1].sum(axis=0)
        prob[-1] = UNSEEN
    return Scorer(lattice, langs, prob)


def predict(docs: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of lang_pred and score (the posterior, 0 to 1).

    ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned.
    Ties go to the language that sorts first. Other columns pass through; one named like ``out``
    is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        langs, score = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return docs.withColumn(out, run(F.col(text_col)))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 4
