"""Chat formatting on the level of tokens, and reading the result back.

Each turn is a segment that is encoded by itself: its text is escaped, encoded as ordinary
tokens, and framed by reserved ids beyond the vocabulary, which no text can produce. Segments
are encoded before any shuffle, so a conversation with many turns costs no task more than its
share. Offsets of segments and of their loss spans are prefix sums of segment lengths over the
conversation; the loss mask of a token is what the prefix sum of the spans' starts (+1) and ends
(-1) leaves open. Only assistants' texts are open.

A control string inside a text gets an escape character after its first character, behind any
that are there already; taking one away again restores every text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Control strings in the order of their reserved ids, which follow the vocabulary.
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
#: Control strings around a text by role; any other role is written out after [ROLE].
FRAMES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ESCAPE = "␛"
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_PLAIN = re.compile(f"([\\[<])({ESCAPE}*)({_TAILS})")
_ESCAPED = re.compile(f"([\\[<])({ESCAPE}*){ESCAPE}({_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(rf"\1\2{ESCAPE}\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Codec:
    """Ordinary tokens of a byte-level vocabulary and the reserved ids after them."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.text = tiktoken.Encoding("ordinary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.reserved = {c: first + i for i, c in enumerate(CONTROLS)}
        self.control = {i: c for c, i in self.reserved.items()}
        self.first = first

    def segment(self, role: str, text: str) -> tuple[list[int], int, int, int]:
        """Ids of a turn, start and end of its loss span, and its length as a string."""
        said = escape(text)
        body = self.text.encode_ordinary(said)
        if role in FRAMES:
            opening, closing = FRAMES[role]
            ids, chars = [self.reserved[opening]], len(opening)
        else:
            name, closing = escape(role), "[/TURN]"
            ids = [self.reserved["[ROLE]"], *self.text.encode_ordinary(name), self.reserved["[/ROLE]"]]
            chars = len("[ROLE]") + len(name) + len("[/ROLE]")
        start = len(ids)
        ids += body
        end = len(ids)
        ids.append(self.reserved[closing])
        return ids, start if role == "assistant" else end, end, chars + len(said) + len(closing)

    def read(self, ids: list[int]) -> tuple[str, str]:
        """Role and text of a segment, from its ids alone."""
        opening = self.control[ids[0]]
        if opening == "[ROLE]":
            cut = ids.index(self.reserved["[/ROLE]"])
            return self.plain(ids[1:cut]), self.plain(ids[cut + 1 : -1])
        role = next(r for r, (o, _) in FRAMES.items() if o == opening)
        return role, self.plain(ids[1:-1])

    def plain(self, ids: list[int]) -> str:
        return unescape(self.text.decode(ids))

    def written(self, ids: list[int]) -> str:
        """Ids as the formatted string."""
        out, run = [], []
        for i in [*ids, self.first]:
            if i >= self.first:
                out += [self.text.decode(run), self.control.get(i, "")]
                run = []
            else:
                run.append(i)
        return "".join(out[:-1])


_kept: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    if (ranks_path, pattern) not in _kept:
        _kept[ranks_path, pattern] = Codec(ranks_path, pattern)
    return _kept[ranks_path, pattern]


def format_turns(turns: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Segments of all conversations of ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, turn, at (place of the turn in the conversation, from 0), ids, loss_start
    and loss_end (the open span within the segment, empty unless an assistant's), chars, and
    offset (ids before the segment in its conversation). Null texts and roles count as empty.
    Turns of equal number go by a hash of role and text, repeated rows stay; turns without a number
    come first, and rows without a conversation form one. Further columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            done = [coder.segment(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ids, starts, ends, chars = zip(*done, strict=True) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.int32()),
                 pa.array(ends, pa.int32()), pa.array(chars, pa.int64())],
                names=["conv_id", "turn", "key", "ids", "loss_start", "loss_end", "chars"])

    tie = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", tie.alias("key"))
    segments = kept.mapInArrow(encode, "conv_id long, turn long, key long, ids array<int>, loss_start int, loss_end int, chars long")
    order = Window.partitionBy("conv_id").orderBy("turn", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return segments.select(
        "conv_id", "turn", F.row_number().over(order).alias("at"), "ids", "loss_start", "loss_end", "chars",
        F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).alias("offset"),
    )


def loss_mask(lengths: list[int], starts: list[int], ends: list[int]) -> np.ndarray:
    """The mask of a run of segments: the prefix sum of +1 at span starts and -1 at span ends."""
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    steps = np.zeros(offsets[-1] + 1, dtype=np.int32)
    np.add.at(steps, offsets[:-1] + starts, 1)
    np.add.at(steps, offsets[:-1] + ends, -1)
    return np.cumsum(steps[:-1]) > 0


def read_back(segments: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per conversation what its ids and mask say: counts and digests of turns and of the open text.

    A task streams its conversations turn by turn in the order that the formatting left, and
    holds one batch and one running digest; a long conversation is never gathered.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "offset", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, state = codec(ranks_path, pattern), object(), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row(conv, s):
            values = [conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]

        for batch in batches:
            done = []
            convs, all_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            mask = loss_mask([len(i) for i in all_ids], batch.column(2).to_pylist(), batch.column(3).to_pylist())
            at = 0
            for conv, ids in zip(convs, all_ids, strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(row(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = coder.read(ids)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                open_ = mask[at : at + len(ids)]
                at += len(ids)
                if open_.any():
                    learned = coder.plain([i for i, m in zip(ids, open_, strict=True) if m])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(coder.written(ids))
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays(row(now, state), names=names)

    return ordered.select("conv_id", "ids", "loss_start", "loss_end").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
