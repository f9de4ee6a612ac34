"""Personal data in texts by patterns and by learned contexts, with DataFrame functions alone.

The base kinds (e-mail, IP, card and phone) are found by pattern and check. Their findings seed
a bootstrap over slots. A slot is an identifier-shaped filling (it holds a digit or @, and may go
on over spaces in groups of digits) with its lexical patterns:

- a label in front of it, one or two words and one of ``: = #``, as in ``contact: x``,
- two words of prose in front of it, as in ``number is x``,
- two words of prose after it, as in ``x or write``.

Spark scores the graph of patterns and instances in rounds. A pattern is worth the mean score of
its distinct instances; a base finding is worth 1, any other instance the noisy-or of the contexts
that it has elsewhere, each at its best pattern. A context that the pattern itself matches has no
vote, so a pattern never proves itself. Trusted are the patterns with enough support (base findings)
and confidence; prose must also be specific: an identifier stands beside most occurrences of its
two words in the corpus. Trusted patterns then discover the identifiers in their other slots that
overlap no base finding. Discovered identifiers hold a digit, which tells them from words.

The graph is counted over every slot of the corpus; edges are distinct before any score, so copies
and frequent labels add nothing. The regular expressions are written so that Java reads each text
in one linear pass: possessive where that changes no match, and starting only where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, write_table
from .spans import SPAN, apart, beside, let, located, no_spans, redacted

KINDS = ["email", "ip", "card", "phone", "context"]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"(?:0++|0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?))"
_IN = r"""[^\s"'<>,;]"""
_FILLING = rf"""({_IN}{{0,40}}?[0-9@]{_IN}{{0,64}}(?:\x20\(?[0-9]{_IN}{{0,24}}){{0,5}})(?!{_IN})"""
_LABEL = r"""(?<![\p{L}\p{N}])((?:\p{L}{2,24}[\x20_-])?\p{L}{2,24})["']?\x20?([:=#])\x20?["'(]?"""
_PROSE = r"(?<!\S)(\p{L}{1,24}\x20\p{L}{1,24})\x20"
#: Groups: label, separator, prose before, filling, prose after.
SLOT = rf"(?:{_LABEL}|{_PROSE}|(?<!\S)){_FILLING}(?=(?:\x20(\p{{L}}{{1,24}}\x20\p{{L}}{{1,24}})(?!\S))?)"
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.6
#: The share of a prose pattern's occurrences that must be slots.
SPECIFIC = 0.5
#: Bits of the map that keeps words of no pattern in the scan.
BITS = 1 << 21
#: Trusted patterns that a plan holds.
MOST_PATTERNS = 1000


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")

    def worth(d: Column, i: Column) -> Column:
        n = F.coalesce(d.try_cast("int"), F.lit(0))
        twice = n * 2
        return F.when(i % 2 == 0, n).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(backwards, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_spans(text: Column) -> Column:
    """Base findings: leftmost non-overlapping matches of each kind that pass its check."""
    digits = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    octets = "^" + r"\.".join([OCTET] * 4) + "$"
    email = F.when(text.contains("@"), located(text, EMAIL, "email", 0)).otherwise(no_spans())
    ip = F.filter(located(text, IP, "ip", 1), lambda s: s["match"].rlike(octets))
    card = F.filter(located(text, CARD, "card", 2), lambda s: F.length(digits(s)).between(12, 19) & luhn(digits(s)))
    phone = F.filter(located(text, PHONE, "phone", 3), lambda s: F.length(digits(s)).between(9, 15))
    return F.concat(email, ip, card, F.when(text.contains("+"), phone).otherwise(no_spans()))


def slots(text: Column) -> Column:
    """Slots with a pattern, as spans of their fillings (without closing punctuation).

    ``match`` is the lower-cased filling and ``kind`` its patterns, joined by tabs: ``label:_``,
    ``two words _`` and ``_ two words``.
    """
    group = lambda s, i: F.regexp_extract(s["match"], SLOT, i)

    def slot(s: Column, after: Column) -> Column:
        raw = group(s, 4)
        filling = F.regexp_replace(raw, r"[.:!?)\]}]+$", "")
        start = s["end"] - F.length(raw)
        label = F.when(group(s, 1) != "", F.concat(F.lower(group(s, 1)), group(s, 2), F.lit("_")))
        prose = F.when(group(s, 3) != "", F.concat(F.lower(group(s, 3)), F.lit(" _")))
        right = F.when(after != "", F.concat(F.lit("_ "), F.lower(after)))
        return F.struct(
            start.alias("start"), F.lit(4).alias("rank"), (start + F.length(filling)).alias("end"),
            F.array_join(F.array_compact(F.array(label, prose, right)), "\t").alias("kind"), F.lower(filling).alias("match"),
        )

    after = F.regexp_extract_all(text, F.lit(SLOT), F.lit(5))
    found = F.zip_with(located(text, SLOT, "slot", 4), after, slot)
    long_enough = lambda s: (s["kind"] != "") & F.length(s["match"]).between(4, 64) & s["match"].rlike("[0-9@]")
    return F.when(text.rlike("[0-9@]"), F.filter(found, long_enough)).otherwise(no_spans())


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(label, confidence, seeds) from distinct ``edges`` (context, instance, seed boolean).

    ``context`` holds the labels (patterns) of a slot, joined by tabs. ``seeds`` counts a label's
    instances that are base findings; a label with fewer than ``support`` of them has confidence 0.
    The contexts that a label matches have no vote in its own instances' scores, so the confidence
    of a label whose instances stand nowhere else is its share of seeds.
    """
    proven = edges.groupBy("instance").agg(F.max("seed").alias("proven"))
    edges = write_table(edges.select("context", "instance").join(proven, "instance"), "edges")
    labels = edges.select("context").distinct().withColumn("label", F.explode(F.split("context", "\t")))
    votes = edges.select("context").distinct().withColumn("vote", F.lit(0.0))
    patterns = None
    for _ in range(rounds):
        voted = edges.join(votes, "context")
        total = voted.groupBy("instance").agg(F.sum("vote").alias("votes"))
        own = voted.join(labels, "context").groupBy("label", "instance").agg(F.max("proven").alias("proven"), F.sum("vote").alias("own"))
        score = F.when(F.col("proven"), 1.0).otherwise(1 - F.exp(F.least(F.col("own") - F.col("votes"), F.lit(0.0))))
        patterns = own.join(total, "instance").groupBy("label").agg(F.avg(score).alias("mean"), F.count_if("proven").alias("seeds"))
        patterns = write_table(patterns.select("label", "seeds", F.when(F.col("seeds") >= support, F.col("mean")).otherwise(0.0).alias("confidence")), "patterns")
        best = labels.join(patterns, "label").groupBy("context").agg(F.max("confidence").alias("confidence"))
        votes = best.select("context", (-F.log1p(-F.least("confidence", F.lit(0.999)))).alias("vote"))
    return patterns


def bitmap(pairs: DataFrame, bits: int = BITS) -> Column:
    """A constant array of longs with the bit of every ``pair``'s hash set; its size doesn't depend on the pairs."""
    place = F.pmod(F.xxhash64("pair"), F.lit(bits))
    words = pairs.groupBy(F.floor(place / 64).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("w"))
    found = {r["at"]: r["w"] for r in words.collect()}  # bits / 64 at most
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")


def specific(patterns: DataFrame, texts: DataFrame, filled: DataFrame, least: float = SPECIFIC) -> DataFrame:
    """The labels of ``patterns`` that are no prose, or prose whose occurrences in ``texts`` (text) are mostly slots.

    An occurrence is two neighbouring words, apart by one space, that are letters alone. A bitmap
    of the patterns' hashes keeps other words from leaving the scan; what passes is counted before
    it meets the patterns, so words that many patterns share cost no more than their count.
    """
    words = F.trim(F.translate("label", "_", ""))
    prose = write_table(patterns.where("label like '% \\_' or label like '\\_ %'").select("label", words.alias("pair")), "prose")
    if prose.isEmpty():
        return patterns.select("label")
    neighbours = lambda w: F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    pairs = F.flatten(F.transform(F.split(F.lower("text"), r"[^\S\x20]"), lambda line: let(F.split(line, " "), neighbours)))
    known = bitmap(prose)
    place = F.pmod(F.xxhash64("pair"), F.lit(BITS))
    marked = F.call_function("bit_get", F.get(known, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1
    found = texts.where("text is not null").select(F.explode(pairs).alias("pair")).where(marked)
    seen = found.groupBy("pair").agg(F.count("*").alias("n"))
    used = filled.select(F.explode(F.split("slot.kind", "\t")).alias("label")).groupBy("label").agg(F.count("*").alias("used"))
    rated = prose.join(seen, "pair").join(used, "label").where(F.col("used") >= least * F.col("n")).select("label")
    return patterns.join(prose, "label", "left_anti").select("label").union(rated)


def _learn(docs: DataFrame, id_col: str, text_col: str, confidence: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base spans and slots per row, the slots that are free of base spans, and the trusted labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = lambda s: s.withField("match", F.lit(None).cast("string"))
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), base_spans(text).alias("base"), slots(text).alias("slots"))
    found = write_table(found.select("id", "h", F.transform("base", bare).alias("base"), "slots"), "pii")
    base = F.col("base")
    texts = found.where("size(slots) > 0").dropDuplicates(["id", "h"])
    filled = texts.select(F.explode(beside(F.col("slots"), base, inside=True)).alias("x")).select(F.col("x.span").alias("slot"), F.col("x.hit").alias("seed"))
    filled = write_table(filled, "slots")
    edges = filled.groupBy(F.col("slot.kind").alias("context"), F.col("slot.match").alias("instance")).agg(F.max("seed").alias("seed"))
    likely = write_table(score_patterns(edges).where(F.col("confidence") >= confidence).select("label"), "likely")
    trusted = write_table(specific(likely, docs.select(F.col(text_col).alias("text")), filled), "trusted")
    free = texts.select("id", "h", F.explode(F.filter(apart(F.col("slots"), base), lambda s: s["match"].rlike("[0-9]"))).alias("slot"))
    return found, free, trusted


def _context(slot: Column) -> Column:
    return slot.withField("kind", F.lit("context")).withField("match", F.lit(None).cast("string"))


def _joined(found: DataFrame, free: DataFrame, trusted: DataFrame) -> DataFrame:
    labelled = free.select("id", "h", "slot", F.explode(F.split("slot.kind", "\t")).alias("label")).join(trusted, "label")
    added = (
        labelled.select("id", "h", _context(F.col("slot")).alias("slot")).distinct().groupBy("id", "h")
        .agg(F.collect_list("slot").cast(f"array<{SPAN}>").alias("added"))
        .select(F.col("id").alias("id2"), F.col("h").alias("h2"), "added")
    )
    joined = found.join(added, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    return joined.select("id", "h", "base", F.coalesce("added", no_spans()).alias("added"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """(id, h, base, added): spans of each row of ``docs`` as ``spans.SPAN`` arrays; h is the text's hash.

    A null text counts as empty. Rows with equal id and text find the same; rows that share an
    id, or have none, are kept apart by the text's hash. Texts are read whole; other columns are
    not read; an empty table gives an empty one.
    """
    return _joined(*_learn(docs, id_col, text_col, confidence))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with every finding in its text replaced by the kind in brackets; null texts stay null.

    Columns and rows stay as they are otherwise, whatever the columns are called. Texts are not
    shuffled: a second scan finds the spans again, with the trusted patterns in the plan. Should
    there be more than ``MOST_PATTERNS`` of them, the spans come by a join instead.
    """
    learned = _learn(docs, id_col, text_col, confidence)
    labels = [r["label"] for r in learned[2].limit(MOST_PATTERNS + 1).collect()]
    text = F.col(text_col)
    replaced = lambda df, new: df.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    if len(labels) > MOST_PATTERNS:
        name = {k: fresh_name(docs, k) for k in ("id", "h", "spans")}
        spans = _joined(*learned).select(F.col("id").alias(name["id"]), F.col("h").alias(name["h"]), F.concat("base", "added").alias(name["spans"]))
        spans = write_table(spans.where(F.size(name["spans"]) > 0).dropDuplicates([name["id"], name["h"]]), "pii-spans")
        same = F.col(id_col).eqNullSafe(F.col(name["id"])) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(name["h"]))
        return replaced(docs.join(spans, same, "left"), F.when(F.col(name["spans"]).isNull(), text).otherwise(redacted(text, F.col(name["spans"]))))
    base = base_spans(text)
    if not labels:
        return replaced(docs, F.when(text.isNotNull(), let(base, lambda b: redacted(text, b))))
    known = F.array(*[F.lit(x) for x in labels])
    taken = lambda s: s["match"].rlike("[0-9]") & F.arrays_overlap(F.split(s["kind"], "\t"), known)
    fresh = lambda b: F.transform(apart(F.filter(slots(text), taken), b), _context)
    return replaced(docs, F.when(text.isNotNull(), let(base, lambda b: let(F.concat(b, fresh(b)), lambda s: redacted(text, s)))))
