"""Where patterns match in a text, with DataFrame functions alone, in time linear in the text.

Offsets count code points, ends are exclusive. ``regexp_extract_all`` gives the leftmost
non-overlapping matches and ``split`` the gaps between the same matches; the running sum of
their lengths is the position. A span is a struct of start, rank (the kind's place in its list),
end, kind and match, which sorts by start and then kind.

Nothing here appends to an array match by match, which would copy it each time: running sums and
maxima double their reach in each pass (n log n), overlaps are found in sorted order, and a text is
rebuilt by joining pieces that are cut from chunks of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"
NONE = f"array<{SPAN}>"
#: Code points of a chunk from which pieces of a text are cut.
CHUNK = 2048


def no_spans() -> Column:
    return F.array().cast(NONE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running combination of an array by an associative function: pass k reaches back 2**k places."""

    def double(acc: Column, k: Column) -> Column:
        return let(F.call_function("shiftleft", F.lit(1), k), lambda d: F.transform(acc, lambda v, i: F.when(i >= d, combine(F.get(acc, i - d), v)).otherwise(v)))

    passes = lambda v: F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)
    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(passes(v), v, double)))


def running_sum(values: Column) -> Column:
    return scan(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return scan(values, F.greatest)


def located(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Spans of all matches of a Java pattern that never matches the empty string."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running_sum(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(
            ends, found,
            lambda e, m: F.struct((e - F.length(m)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("match")),
        )

    return F.when(text.rlike(pattern), let(matches, spans)).otherwise(no_spans())


def beside(spans: Column, others: Column, inside: bool = False) -> Column:
    """Structs of span and ``hit``: whether one of ``others`` overlaps the span (covers it, if ``inside``).

    Both are put in order of place; the furthest end so far tells whether any earlier start reaches
    into a span.
    """
    key = (lambda s: s["start"]) if inside else (lambda s: s["end"])
    # At equal places a start counts for covering and doesn't for overlapping.
    asked, known = (1, 0) if inside else (0, 1)
    event = lambda at, tag, reach, span: F.struct(at.alias("at"), F.lit(tag).alias("tag"), reach.alias("reach"), span.alias("span"))
    nothing = F.lit(None).cast(SPAN)

    def mark(events: Column) -> Column:
        return let(
            running_max(F.transform(events, lambda e: e["reach"])),
            lambda far: F.filter(
                F.zip_with(
                    events, far,
                    lambda e, r: F.struct(e["span"].alias("span"), (r >= e["span"]["end"] if inside else r > e["span"]["start"]).alias("hit")),
                ),
                lambda x: x["span"].isNotNull(),
            ),
        )

    def compare(s: Column, o: Column) -> Column:
        events = F.concat(
            F.transform(s, lambda x: event(key(x), asked, F.lit(-1), x)), F.transform(o, lambda x: event(x["start"], known, x["end"], nothing))
        )
        alone = F.transform(s, lambda x: F.struct(x.alias("span"), F.lit(False).alias("hit")))
        return F.when((F.size(s) == 0) | (F.size(o) == 0), alone).otherwise(let(F.array_sort(events), mark))

    return let(spans, lambda s: let(others, lambda o: compare(s, o)))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of ``others``."""
    return F.transform(F.filter(beside(spans, others), lambda x: ~x["hit"]), lambda x: x["span"])


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    said = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(said, ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to ``end``, cut from its chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    head = chunk(first).substr(start - first * CHUNK + 1, F.lit(CHUNK))
    middle = F.when(last - first > 1, F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(1))), "")).otherwise("")
    within = chunk(first).substr(start - first * CHUNK + 1, end - start)
    return F.when(first == last, within).otherwise(F.concat(head, middle, chunk(last).substr(F.lit(1), end - last * CHUNK)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""

    def rebuild(chunks: Column, s: Column, far: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(far, i - 1)).otherwise(0)
        parts = F.transform(
            s,
            lambda x, i: F.when(
                x["start"] >= before(i), F.concat(_piece(chunks, before(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
            ).otherwise(""),
        )
        return F.concat(F.array_join(parts, ""), _piece(chunks, F.element_at(far, -1), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    done = let(
        F.array_sort(spans),
        lambda s: let(running_max(F.transform(s, lambda x: x["end"])), lambda far: let(chunks, lambda c: rebuild(c, s, far))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
