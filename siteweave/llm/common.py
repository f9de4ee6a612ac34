"""What the operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a new temporary folder becomes the session's checkpoint folder
    if the master is local; on a cluster that folder would not be shared, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-siteweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read from there.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation of what
    stands before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name for internal use that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"__{wanted}"
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; nodes of one component share their root.

    Each round hooks every node to the neighbour (or itself) of the least random priority and
    contracts the edges along the hooks. A fresh priority per round shrinks any graph, paths
    included, by a constant factor in expectation, so the rounds grow with the logarithm of the
    longest path. Rounds are written tables; a star's centre is only ever the key of a minimum,
    which is combined before the shuffle. Loops and null ends are ignored.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return (
            e.where("a is not null and b is not null and a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    current = write_table(tidy(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "edges")
    hooks: list[DataFrame] = []
    while not current.isEmpty():
        salt = F.lit(len(hooks))
        ranked = lambda c: F.struct(F.xxhash64(c, salt).alias("p"), F.col(c).alias("target"))
        ends = current.select(F.col("a").alias("node"), ranked("b").alias("best")).union(
            current.select(F.col("b"), ranked("a"))
        )
        hook = write_table(
            ends.groupBy("node")
            .agg(F.min("best").alias("best"))
            .select("node", F.least("best", ranked("node"))["target"].alias("target")),
            "hooks",
        )
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("target").alias("ta"))
        right = hook.select(F.col("node").alias("b"), F.col("target").alias("tb"))
        moved = current.join(left, "a").join(right, "b")
        current = write_table(tidy(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
    if not hooks:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = hooks[-1].select("node", F.col("target").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("node").alias("target"), "root")
        roots = hook.join(later, "target", "left").select("node", F.coalesce("root", "target").alias("root"))
    return roots
