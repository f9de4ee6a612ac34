"""SentencePiece encoding and decoding with a batched Viterbi search.

Words of one length advance together. At each end position the candidate arcs are the pieces
that end there (``pieces.PieceTable``); the vectorised maximum over the arcs stores the
backpointers.

The public model is of the byte-pair kind, whose segmentation is not the one with the best sum
of scores. What makes a segmentation right there is local: it is the model's exactly if each
two neighbouring pieces are what merging gives on the two alone. So an arc scores by its length
if its piece can follow the best last piece of its start, and minus infinity if not; exactly one
arc survives at each position. Whether a piece can follow another is found by undoing the two
merge histories along their common border, latest merge first, and asking at each step whether
a merge across the border would have come first; answers are kept in a direct-mapped table.

Runs of spaces, whose pieces all share the lowest score, merge last and from the left, and are
cut off first. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .pieces import PieceTable, code_matrix, equal_lengths, load_pieces

SPACE = "▁"
#: Words longer than this are cut where no piece holds the two characters, and aren't kept.
LONG = 64
#: Words that a worker keeps encoded, and code points of text that it takes at a time.
CACHE_WORDS = 300_000
SLICE = 1 << 21
MEMO_BITS = 21


class PieceModel:
    """What encoding needs of a byte-pair model; plain arrays, so that Spark can broadcast it."""

    def __init__(self, pieces: list[str], scores: np.ndarray, ordinary: np.ndarray):
        if len(pieces) >= 1 << 16:
            raise ValueError(f"{len(pieces)} pieces don't fit into 16 bits")
        if missing := [f"<0x{b:02X}>" for b in range(256) if f"<0x{b:02X}>" not in pieces]:
            raise ValueError(f"the model has no byte fallback: {missing[:3]}")
        self.pieces = pieces
        self.unknown = len(pieces)
        self.byte_ids = np.array([pieces.index(f"<0x{b:02X}>") for b in range(256)], dtype=np.uint16)
        order = sorted((i for i in range(len(pieces)) if ordinary[i]), key=lambda i: (-scores[i], i))
        self.rank = np.full(len(pieces) + 1, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        ids = {pieces[i]: i for i in order}
        runs = {p for p in ids if len(p) > 1 and set(p) == {SPACE}}
        self.runs = {len(p): ids[p] for p in runs} | {1: ids[SPACE]}
        self.left = np.full(len(pieces) + 1, -1, dtype=np.int32)
        self.right = self.left.copy()
        self.formed = self.rank.copy()
        alone = np.array([len(p) == 1 for p in pieces] + [True])
        self.formed[alone] = -1
        usable = []
        for i in sorted(order, key=lambda i: len(pieces[i])):
            if len(pieces[i]) == 1:
                usable.append(i)
            elif pieces[i] not in runs and (split := self._last_merge(pieces[i], ids)):
                self.left[i], self.right[i] = split
                self.formed[i] = max(self.rank[i], self.formed[split[0]], self.formed[split[1]])
                usable.append(i)
        self.table = PieceTable([pieces[i] for i in usable], usable)
        pairs = {}
        for i in order:
            p = pieces[i]
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None and p not in runs:
                    pairs[a * (self.unknown + 1) + b] = self.rank[i]
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], dtype=np.int64)
        self.inside = {p[j : j + 2] for p in ids for j in range(len(p) - 1)}

    def _last_merge(self, piece: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that merging joins last to make ``piece``; None if it never makes it."""
        parts = list(piece)
        if any(p not in ids for p in parts):
            return None
        while len(parts) > 1:
            joined = [self.rank[ids[m]] if (m := a + b) in ids else 1 << 40 for a, b in zip(parts, parts[1:], strict=False)]
            at = int(np.argmin(joined))
            if joined[at] == 1 << 40:
                return None
            if len(parts) == 2:
                return ids[parts[0]], ids[parts[1]]
            parts[at : at + 2] = ["".join(parts[at : at + 2])]
        return None

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between ``first`` and ``second`` standing."""
        first, second = first.astype(np.int64), second.astype(np.int64)
        out = np.ones(len(first), dtype=bool)
        never = np.int64(1 << 40)
        before, after = np.full(len(first), never), np.full(len(first), never)
        live = np.arange(len(first))
        while len(live):
            a, b = first[live], second[live]
            key = a * (self.unknown + 1) + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[place] == key, self.pair_rank[place], never)
            crossed = (across < before[live]) & (across <= after[live])
            out[live[crossed]] = False
            undo_right = self.formed[b] >= self.formed[a]
            made = np.where(undo_right, self.formed[b], self.formed[a])
            go = ~crossed & (made >= 0)
            live, a, b, undo_right = live[go], a[go], b[go], undo_right[go]
            r, s = live[undo_right], live[~undo_right]
            after[r], second[r] = self.rank[b[undo_right]], self.left[b[undo_right]]
            before[s], first[s] = self.rank[a[~undo_right]], self.right[a[~undo_right]]
        return out


class Encoder:
    """A worker's encoder: the model, the table of answered pairs and the words kept encoded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.cache: dict[str, bytes] = {}
        self.memo = np.full(1 << MEMO_BITS, -1, dtype=np.int64)
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode()
            for p in model.pieces
        ]

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.model.unknown + 1) + b
        slot = (key * 0x9E3779B1 >> 7) & ((1 << MEMO_BITS) - 1)
        kept = self.memo[slot]
        out = (kept & 1).astype(bool)
        new = np.nonzero(kept >> 1 != key)[0]
        if len(new):
            out[new] = self.model.follows(a[new], b[new])
            self.memo[slot[new]] = key[new] << 1 | out[new]
        return out

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as little-endian 16-bit integers."""
        n, count, model = len(words[0]), len(words), self.model
        codes = code_matrix(words, n)
        lattice = model.table.lattice(codes)
        lattice[1] = np.where(lattice[1] < 0, model.unknown, lattice[1])
        last = np.empty((count, n + 1), dtype=np.int32)
        size = np.zeros((count, n + 1), dtype=np.int8)
        for end in range(1, n + 1):
            for length in range(1, min(end, len(lattice) - 1) + 1):
                start = end - length
                piece = lattice[length][:, start]
                at = np.nonzero(piece >= 0)[0]
                if start and len(at):
                    at = at[self._follows(last[at, start], piece[at])]
                better = at[size[at, end] < length]
                size[better, end], last[better, end] = length, piece[better]
        out: list[bytes] = []
        steps = []
        at = np.full(count, n)
        rows = np.arange(count)
        while len(rows):
            steps.append((rows, last[rows, at[rows]], at[rows]))
            at[rows] -= size[rows, at[rows]]
            rows = rows[at[rows] > 0]
        who = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        end = np.concatenate([s[2] for s in steps])
        order = np.lexsort((end, who))
        who, ids, end = who[order], ids[order], end[order]
        cut = np.searchsorted(who, np.arange(count + 1))
        strange = ids == model.unknown
        small = ids.astype("<u2")
        odd = set(who[strange].tolist())
        raw = small.tobytes()
        for k in range(count):
            lo, hi = cut[k], cut[k + 1]
            if k in odd:
                out.append(b"".join(
                    model.byte_ids[list(chr(codes[k, end[j] - 1]).encode("utf-8", "surrogatepass"))].tobytes()
                    if strange[j] else small[j : j + 1].tobytes()
                    for j in range(lo, hi)
                ))
            else:
                out.append(raw[2 * lo : 2 * hi])
        return out

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Words as ``_WORD`` gives them: spaces, then a body without spaces."""
        plain = [w for w in words if len(w) <= LONG and not w.startswith(SPACE * 2)]
        bodies: dict[str, list[str]] = {}
        for w in set(words).difference(plain):
            body = w.lstrip(SPACE)
            bodies[w] = self._cut((SPACE if len(body) < len(w) else "") + body)
        parts = list(set(plain).union(*bodies.values()))
        done: dict[str, bytes] = {}
        for group in equal_lengths(parts):
            done.update(zip(group, self._viterbi(group), strict=True))
        one = np.uint16(self.model.runs[1]).tobytes()
        longest = max(self.model.runs)
        out = done if not bodies else {w: done[w] for w in plain}
        for w, cut in bodies.items():
            ids = b"".join([done[p] for p in cut])
            spaces = len(w) - len(w.lstrip(SPACE))
            if spaces > 1:
                if ids[:2] == one:
                    ids = ids[2:]
                else:
                    spaces -= 1
                runs = [longest] * (spaces // longest) + ([spaces % longest] if spaces % longest else [])
                ids = b"".join(np.uint16(self.model.runs[r]).tobytes() for r in runs) + ids
            out[w] = ids
        return out

    def _cut(self, word: str) -> list[str]:
        if len(word) <= LONG:
            return [word]
        inside, cut, at = self.model.inside, [], 0
        for j in range(1, len(word)):
            if word[j - 1 : j + 1] not in inside:
                cut.append(word[at:j])
                at = j
        return [*cut, word[at:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, with the model's leading space; nothing for an empty text."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*split).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = set().union(*split)
        self.cache.update(self._encode_words(list(new)))
        out = [b"".join(map(self.cache.__getitem__, words)) for words in split]
        if len(self.cache) > CACHE_WORDS or any(len(w) > 4 * LONG for w in new):
            self.cache.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids from ``encode``; byte pieces that are not UTF-8 become U+FFFD."""
        return self.text_of(np.frombuffer(ids, "<u2").tolist())

    def text_of(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < len(self.bytes_of):
            raise ValueError(f"no piece has the id {max(ids)}")
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


_WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_kept: list[Encoder] = []


def _worker(model: PieceModel) -> Encoder:
    """The encoder of this process; it outlives tasks, as Spark keeps workers and broadcasts."""
    if not _kept or _kept[0].model is not model:
        _kept[:] = [Encoder(model)]
    return _kept[0]


def slices(texts: list[str], most: int = SLICE):
    """``texts`` in runs of about ``most`` code points; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


#: Texts on which a model must agree with the search before it is used.
_PROBES = ["", " a", "The  quick brown fox, 12 times.", "naïve façade – über Ñandú", "x\n\ty  z", "unbelievably internationalisation", "ﬁ①Å é"]


def checked_model(path: str) -> PieceModel:
    """The model of a file; ValueError unless it is of the byte-pair kind with byte fallback and no normaliser.

    The kind is told by what the library gives for a few texts, which a unigram model or a
    normaliser would change.
    """
    import sentencepiece

    model = PieceModel(*load_pieces(path))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [np.frombuffer(b, "<u2").tolist() for b in Encoder(model).encode(_PROBES)]
    if own != [library.encode(t) for t in _PROBES]:
        raise ValueError(f"{path} is no byte-pair model with an identity normaliser")
    return model


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "encoded") -> DataFrame:
    """``docs`` with a struct ``out``: ids, n_tokens, and whether the ids decode to the text.

    A null text counts as empty, as the model has it: no ids. U+2581 is the model's space, so
    it decodes to a space, and the comparison allows for that. Texts of any length are encoded
    whole; other columns pass through, and one named like ``out`` is replaced.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(checked_model(model_path))
    kind = StructType([
        StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()),
        StructField("round_trip", BooleanType()),
    ])

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        worker = _worker(shared.value)
        texts = [t or "" for t in column.to_pylist()]
        ids: list[bytes] = []
        for part in slices(texts):
            ids += worker.encode(part)
        same = [worker.decode(i) == t.replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
        counts = np.array([len(i) // 2 for i in ids], dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), "<u2").astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.StructArray.from_arrays([lists, pa.array(counts), pa.array(same, pa.bool_())], names=["ids", "n_tokens", "round_trip"])

    return docs.withColumn(out, run(F.col(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with a string ``out``: the text of an array of ids, as ``encode`` gives them.

    Null ids give null, no ids the empty text, and byte pieces that are no UTF-8 U+FFFD. An id
    outside the vocabulary fails the job. Other columns pass through; one named like ``out`` is
    replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(checked_model(model_path))

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        worker = _worker(shared.value)
        return pa.array([None if ids is None else worker.text_of(ids) for ids in column.to_pylist()], pa.string())

    return rows.withColumn(out, run(F.col(ids_col)))
