"""The driver tables in the role of call tables, for Spark and for SQL.

Cells are line statuses, technologies return flags, loci a part and a supplier slot, motifs a
part's brand and type, the held-out platform the lines with high tax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import loci

TECHNOLOGIES = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with cell, tech, gene, slot, locus, motif and a score with ties."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_brand", F.lit("-"), "p_type").alias("motif"))
    slot = F.col("l_suppkey") % 16
    return table(spark, sf_dir, "lineitem").join(parts, "l_partkey").select(
        F.col("l_linestatus").alias("cell"), F.col("l_returnflag").alias("tech"), F.col("l_partkey").alias("gene"), slot.alias("slot"),
        F.concat_ws(":", "l_partkey", slot).alias("locus"), "motif", "l_tax", "l_quantity", "l_extendedprice",
        (F.col("l_suppkey") % 5).alias("dataset"), ((F.col("l_partkey") * 31 + slot * 17) % 97).cast("double").alias("score"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("l_tax < 0.06").select("cell", "tech", "gene", "locus", "motif", "score").distinct()


def heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("l_tax >= 0.06").select("cell", "locus").distinct()


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci by cell with support flags, breadth, pattern and held-out support y."""
    found, _ = loci.technology_union(
        calls(spark, sf_dir), ["cell", "locus"], "tech", TECHNOLOGIES, {"gene": "gene", "motif": "motif", "score": "score"}
    )
    held = heldout(spark, sf_dir).withColumn("seen", F.lit(1))
    return loci.attach_heldout(found, held, ["cell", "locus"], "seen", "y").drop("y_present").withColumnRenamed("y_support", "y")


SQL = """
ln as (select l_linestatus as cell, l_returnflag as tech, l_partkey as gene, l_suppkey % 16 as slot,
  l_partkey || ':' || (l_suppkey % 16) as locus, p_brand || '-' || p_type as motif, l_tax, l_quantity, l_extendedprice,
  l_suppkey % 5 as dataset, ((l_partkey * 31 + (l_suppkey % 16) * 17) % 97)::double as score
  from lineitem join part on l_partkey = p_partkey),
calls as (select distinct cell, tech, gene, locus, motif, score from ln where l_tax < 0.06),
held as (select distinct cell, locus from ln where l_tax >= 0.06),
un as (select cell, locus, min(gene) as gene, min(motif) as motif, min(score) as score,
  max((tech = 'A')::int) as a, max((tech = 'N')::int) as n, max((tech = 'R')::int) as r from calls group by 1, 2),
u as (select un.cell, un.locus, gene, motif, score, a, n, r, a + n + r as breadth,
  concat_ws('+', case when a = 1 then 'A' end, case when n = 1 then 'N' end, case when r = 1 then 'R' end) as pattern,
  (held.locus is not null)::int as y from un left join held on un.cell = held.cell and un.locus = held.locus)
"""
