"""The corpus pipeline over ``documents``: language, near-duplicates, benchmark, PII, encoding.

Every stage but the last returns the columns of ``documents``; what it rejects or rewrites is
gone or rewritten for the stages after it. Repeated rows are judged alike; columns of any name pass
through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siteweave.llm import decontaminate, encoding, language, pii, simhash
from siteweave.llm.common import fresh_name, table, write_table
from siteweave.llm.registry import PIECE_MODEL

#: A document stays if its best language has at least this posterior.
LEAST_POSTERIOR = 0.5


def identify_language(spark, docs, sf_dir):
    """Rejects documents without a letter (null and empty texts among them) and those of no clear language."""
    scorer = language.learn(docs.where(language.fold() != 2), PIECE_MODEL)
    name = fresh_name(docs, "language")
    found = language.predict(docs, scorer, out=name)
    clear = (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= LEAST_POSTERIOR)
    return found.where(clear).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each near-duplicate component; null texts count as empty."""
    return simhash.keep_one(docs)


def drop_benchmark(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item; null and empty texts hold none."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark, docs, sf_dir):
    """Replaces personal data by its kind; ``n_chars`` follows the text, null for a null text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark, docs, sf_dir):
    """Ids of every kept text; a null text has none."""
    return encoding.encode(docs.select("doc_id", "text"), PIECE_MODEL).select("doc_id", "encoded.*")


STAGES = [
    ("language", identify_language),
    ("simhash", near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", redact_pii),
    ("sentencepiece", encode),
]
#: Fingerprints, learned models and segmentations are beyond SQL; a test holds each stage to brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
