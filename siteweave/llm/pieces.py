"""A vocabulary of pieces as sorted hash keys, and the lattice of pieces over equal-length words.

Words of one length form a matrix of code points. The polynomial hash of every substring comes
from prefix hashes, a bit table drops most substrings that are no piece, and a binary search in
the sorted keys of the substring's length finds the rest. Keys are 64 bits wide: for a
vocabulary of 32,000 pieces a wrong match is expected once in about 10**14 probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
#: Code points in one matrix; bounds the memory of a lattice.
MATRIX = 1 << 18


class PieceTable:
    """Sorted hash keys of ``pieces`` by length; ids are positions in ``pieces``."""

    def __init__(self, pieces: list[str], ids: list[int]):
        self.width = max(map(len, pieces))
        self.powers = np.cumprod(np.full(self.width + 1, BASE), dtype=np.uint64)
        self.powers = np.concatenate((np.ones(1, np.uint64), self.powers[:-1]))
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.ids: list[np.ndarray] = [np.empty(0, np.int32)]
        self.codes: list[np.ndarray] = [np.empty((0, 0), np.uint32)]
        self.filters: list[np.ndarray] = [np.zeros(1, bool)]
        by_length: dict[int, list[tuple[str, int]]] = {}
        for piece, i in zip(pieces, ids, strict=True):
            by_length.setdefault(len(piece), []).append((piece, i))
        for length in range(1, self.width + 1):
            found = by_length.get(length, [])
            codes = code_matrix([p for p, _ in found], length)
            keys = self._prefix(codes)[:, -1] if found else np.empty(0, np.uint64)
            order = np.argsort(keys)
            self.keys.append(keys[order])
            self.ids.append(np.array([i for _, i in found], dtype=np.int32)[order])
            self.codes.append(codes[order])
            if len(np.unique(keys)) < len(keys):
                raise ValueError(f"two pieces of length {length} are equal or share a key")
            bits = np.zeros(1 << FILTER_BITS, dtype=bool)
            bits[self._slot(keys)] = True
            self.filters.append(bits)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - FILTER_BITS)

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * BASE + mixed[:, i]
        return out

    def lattice(self, codes: np.ndarray) -> list[np.ndarray | None]:
        """Element ``length``: ids of the pieces of that length by word and start, -1 where none."""
        prefix, n = self._prefix(codes), codes.shape[1]
        out: list[np.ndarray | None] = [None]
        for length in range(1, min(self.width, n) + 1):
            sub = prefix[:, length:] - prefix[:, : n + 1 - length] * self.powers[length]
            ids = np.full(sub.shape, -1, dtype=np.int32)
            keys = self.keys[length]
            if len(keys):
                at = np.nonzero(self.filters[length][self._slot(sub)])
                probe = sub[at]
                place = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                hit = np.nonzero(keys[place] == probe)[0]
                row, start, place = at[0][hit], at[1][hit], place[hit]
                true = (codes[row[:, None], start[:, None] + np.arange(length)] == self.codes[length][place]).all(axis=1)
                ids[row[true], start[true]] = self.ids[length][place[true]]
            out.append(ids)
        return out


def code_matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, length)


def equal_lengths(words: list[str]) -> Iterator[list[str]]:
    """``words`` in groups of one length whose matrices stay within ``MATRIX`` code points."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for length, group in by_length.items():
        if length:
            step = max(1, MATRIX // length)
            for at in range(0, len(group), step):
                yield group[at : at + step]


def load_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and the mask of ordinary pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(size)]
    return (
        [model.id_to_piece(i) for i in range(size)],
        np.array([model.get_score(i) for i in range(size)]),
        ~np.array(special),
    )
