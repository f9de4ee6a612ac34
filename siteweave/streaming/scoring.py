"""Scoring a stream of sites.

A score needs its own row and the frozen tables only, so the batch expressions run unchanged on
a streaming frame. Percentiles within the input need all of it and stay with the batch scorer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.portability import with_score


def score_stream(sites: DataFrame, model: list[dict], fingerprint: DataFrame, technologies: list[str], direction: tuple[str, str]) -> DataFrame:
    """``sites`` (motif, source_assay) with sources, domain status and score; null outside the domain or for unknown sources.

    A stream can't be stopped for one bad row, so rows with an unknown source stay, unscored.
    """
    assay = F.upper(F.trim("source_assay"))
    known = assay.isin(*technologies)
    flags = {f"source_{t}": F.when(known, (assay == t).cast("int")) for t in technologies}
    rows = sites.withColumns(flags | {"motif": fn.rna("motif"), "source_breadth": F.when(known, F.lit(1))})
    learned = fingerprint.select("motif", F.col("log_ratio").alias("fp"))
    rows = rows.join(learned, "motif", "left").withColumn("fp_seen", F.col("fp").isNotNull().cast("int")).fillna(0.0, ["fp"])
    rows = rows.withColumns({
        "domain_status": fn.domain_status(F.col("motif")), "fp_abs": F.abs("fp"),
        "fp_source_alignment": F.col("fp") * (F.col(f"source_{direction[0]}") - F.col(f"source_{direction[1]}")),
    }).select("*", *fn.flank_onehot(F.col("motif")))
    scored = with_score(rows, model, "__raw")
    return scored.withColumn("score", F.when(F.col("domain_status") == "in_validated_domain", F.col("__raw"))).drop("__raw")
