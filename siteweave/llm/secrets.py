"""Secrets in texts, and the weak parts of multipart credentials, with DataFrame functions alone.

Base findings stand on their own: assignments, access identifiers and long hexadecimal runs.
Weak candidates (an account name, a bare 40-character token, an endpoint) mean nothing alone.
They are linked by an interval join: candidates of a text meet within ``SCOPE`` code points of
each other, through an equality join on the text and on every window of that width that a weak
span covers, so a long endpoint meets what stands at either end. A weak secret is reported only
next to an identifier, a weak identifier only next to a secret, an endpoint only next to both. A
window holds a bounded number of candidates, so no group of the join is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .spans import SPAN, apart, located, no_spans

SCOPE = 256
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
WEAK = {
    "weak_id": r"""\b(?i:client[_-]?id|account[_-]?id|access[_-]?id|user[_-]?name|login)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._@-]{3,64}""",
    "weak_secret": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"\b(?i:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp)(?::[a-z]{2,16})?://[^\s\"'<>]+",
}
#: What each kind is in a credential.
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}


def base_spans(text: Column) -> Column:
    """Base findings of a text; the leftmost non-overlapping matches of each kind that pass its length."""
    assign = F.filter(located(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6)
    access = F.when(text.contains("AKIA"), F.filter(located(text, ACCESS, "access", 1), lambda s: F.length(s["match"]) >= 20))
    return F.concat(assign, F.coalesce(access, no_spans()), located(text, HEX, "hex", 2))


def weak_spans(text: Column) -> Column:
    return F.concat(
        located(text, WEAK["weak_id"], "weak_id", 3),
        located(text, WEAK["weak_secret"], "weak_secret", 4),
        F.when(text.contains("://"), located(text, WEAK["endpoint"], "endpoint", 5)).otherwise(no_spans()),
    )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, base, added): the spans of each row of ``docs``, as ``spans.SPAN`` arrays.

    A null text counts as empty. Rows with equal id and text find the same; rows that share an
    id with different texts, or have none, are kept apart by the text's hash. Texts are read
    whole; other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), base_spans(text).alias("base"), weak_spans(text).alias("weak")
    )
    bare = lambda spans: F.transform(spans, lambda s: s.withField("match", F.lit(None).cast("string")))
    found = write_table(found.select("id", "h", bare(F.col("base")).alias("base"), bare(F.col("weak")).alias("weak")), "secrets")
    role = F.create_map([F.lit(x) for pair in ROLES.items() for x in pair])
    parts = found.where("size(weak) > 0 and size(weak) + size(base) > 1").dropDuplicates(["id", "h"])
    alone = apart(F.col("weak"), F.col("base"))
    window = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.select("id", "h", F.explode(alone).alias("w")).withColumn("window", window(F.col("w.start"), F.col("w.end")))
    others = parts.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.explode(F.concat("base", alone)).alias("o"))
    others = others.select("id2", "h2", "o", role[F.col("o.kind")].alias("role")).where("role <> 'endpoint'")
    others = others.withColumn("window2", window(F.col("o.start") - scope, F.col("o.end") + scope))
    near = weak.join(
        others,
        F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("window") == F.col("window2"))
        & (F.col("o.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("o.end") <= scope),
    )
    by_id, by_secret = F.max(F.col("role") == "id"), F.max(F.col("role") == "secret")
    linked = (
        near.groupBy("id", "h", "w")
        .agg(by_id.alias("by_id"), by_secret.alias("by_secret"))
        .where(
            "(w.kind = 'weak_secret' and by_id) or (w.kind = 'weak_id' and by_secret) or (w.kind = 'endpoint' and by_id and by_secret)"
        )
        .groupBy("id", "h")
        .agg(F.collect_list("w").cast(f"array<{SPAN}>").alias("added"))
        .select(F.col("id").alias("id2"), F.col("h").alias("h2"), "added")
    )
    joined = found.join(linked, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    return joined.select("id", "base", F.coalesce("added", no_spans()).alias("added"))
