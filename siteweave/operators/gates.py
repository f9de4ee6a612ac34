"""Quality gates: every check of a stage is a column of one aggregate, and a failure stops the run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stable

QC = "check_id string, dataset string, status string, observed string, expected string"


class GateError(ValueError):
    """A gate that failed, with its checks."""


def checks(spark: SparkSession, df: DataFrame, dataset: str, tests: dict[str, tuple]) -> DataFrame:
    """QC-01, 02, 03, 04, 07: a row per check, from one aggregate over ``df``.

    A check is an aggregate, one of ==, >=, <=, the expected value and, where a miss doesn't stop
    the run, the status of a miss (WARN or REVIEW instead of FAIL). A null result is a miss.
    """
    row = df.agg(*[t[0].cast("double").alias(name) for name, t in tests.items()]).first()
    tell = {"==": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    out = []
    for name, (_, op, want, *miss) in tests.items():
        good = row[name] is not None and tell[op](row[name], want)
        out.append((name, dataset, "PASS" if good else (miss[0] if miss else "FAIL"), str(row[name]), f"{op} {want}"))
    return spark.createDataFrame(out, QC)


def run_status(qc: DataFrame) -> str:
    """QC-01: FAIL if any check failed, else REVIEW or WARN if there is one, else PASS."""
    found = {r["status"] for r in qc.select("status").distinct().collect()}
    return next((s for s in ("FAIL", "REVIEW", "WARN") if s in found), "PASS")


def require(qc: DataFrame) -> None:
    """Raises GateError with the checks that failed."""
    if failed := qc.where("status = 'FAIL'").collect():
        raise GateError("; ".join(f"{r['dataset']}/{r['check_id']}: {r['observed']}, expected {r['expected']}" for r in failed))


def expected_counts(df: DataFrame, key: str, expected: DataFrame, n: str = "expected_n") -> DataFrame:
    """QC-02, 06: counts by key against an expected table; a key missing on either side fails."""
    joined = df.groupBy(key).agg(F.count("*").alias("observed_n")).join(expected, key, "full_outer")
    good = F.coalesce(F.col("observed_n") == F.col(n), F.lit(False))
    return joined.select(key, "observed_n", n, F.when(good, "PASS").otherwise("FAIL").alias("status"))


def reproduced(observed: float | None, expected: float, tolerance: float = 0.035) -> bool:
    """QC-06: whether a statistic is within the tolerance of its frozen value."""
    return observed is not None and abs(observed - expected) <= tolerance


def unique(column: str) -> Column:
    """QC-07: rows beyond the distinct values of a key."""
    return F.count(column) - F.count_distinct(column)


def redundancy(breadth: str, supports: list[str]) -> Column:
    """QC-07: rows whose breadth isn't the sum of their support flags."""
    return F.count_if(F.col(breadth) != sum((F.col(s) for s in supports), F.lit(0)))


def require_columns(df: DataFrame, columns: list[str], label: str) -> None:
    """QC-09: GateError before any plan runs if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise GateError(f"{label} lacks {missing}")


def require_frozen(contract: DataFrame, status: str = "status", wanted: str = "FROZEN") -> None:
    """QC-10: GateError unless every row of an earlier stage's contract has the wanted status."""
    rows = contract.groupBy(status).count().collect()
    if not rows or any(r[status] != wanted for r in rows):
        raise GateError(f"the earlier stage isn't {wanted}: {[r[status] for r in rows]}")


def centre_u(motif: str) -> Column:
    """QC-03: share of motifs with U in the middle, among those that are known."""
    m = F.col(motif)
    return F.avg(F.when(m.isNotNull(), ((F.length(m) == 5) & (F.substring(m, 3, 1) == "U")).cast("double")))


def one_base(start: str, end: str) -> Column:
    """QC-03: share of one-base intervals among those with both ends."""
    return F.avg((F.col(end) - F.col(start) == 1).cast("double"))


def replicates_agree(df: DataFrame, first: str, second: str, least: float = 0.85) -> DataFrame:
    """QC-05: (n, spearman, status) of two replicates over the rows that have both; FAIL below ``least`` or where it is undefined.

    The rows are checkpointed, as ranks are joined to them by value: an average's last digits depend on
    the order in which partial sums arrive, so a second evaluation may give others.
    """
    from .ranks import percentile_ranks

    known = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    both = stable(known.select(F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")))
    ranked = percentile_ranks(percentile_ranks(both, "a", out="ra"), "b", out="rb")
    found = ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("spearman"))
    return found.withColumn("status", F.when(F.coalesce(F.col("spearman") >= least, F.lit(False)), "PASS").otherwise("FAIL"))


def direction_flags(table: DataFrame, order: str, value: str, low: str, group: list[str] = ()) -> DataFrame:
    """QC-08: per group whether all values lie on one side of one half, whether all intervals lie above it, and whether
    values never fall along ``order`` (null values are left out)."""
    group = list(group)
    known = table.where(F.col(value).isNotNull())
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(order))  # a result table: a handful of rows per group
    side = F.signum(F.col(value) - 0.5)
    return known.withColumn("__rises", F.coalesce(F.col(value) >= before, F.lit(True))).groupBy(*group).agg(
        (F.min(side) == F.max(side)).alias("direction_consistent"), F.min(F.col(low) > 0.5).alias("interval_above_half"), F.min("__rises").alias("monotone")
    )


def flags(row: dict) -> dict[str, bool | None]:
    """QC-08: descriptive flags of a metrics row: interval above chance, enriched top."""
    low, lift = row.get("auroc_low"), row.get("lift_0.1")
    return {"interval_above_half": None if low is None else low > 0.5, "top_enriched": None if lift is None else lift > 1}
