"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.shared import kept
from placebook.session import remove


def components(edges: DataFrame, folder: str, most_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Each round joins every node's neighbours to the least node it sees, first the larger ones, then
    the smaller ones, until every edge points at the least node of its component. The edges of a
    round are stored in ``folder``, so that no round depends on the one before it. The least
    neighbour is found by a partial aggregate: a hub sends one row per task. It is stored as well, as
    Spark splits a hub's rows in a join only if both sides come from a shuffle.
    """
    spark = edges.sparkSession
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = kept(edges.where(F.col("a") != F.col("b")).select(a.alias("a"), b.alias("b")).distinct(), f"{folder}/round-0")

    def summary(df: DataFrame) -> tuple:
        # Sets of edges of equal size, sum and exclusive or of 64-bit hashes are taken for equal.
        code = F.xxhash64("a", "b")
        return tuple(df.agg(F.count("*"), F.sum(code.cast("decimal(38,0)")), F.bit_xor(code)).first())

    before = summary(now)
    for n in range(1, most_rounds + 1):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), f"{folder}/least-{n}")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        large = kept(large.distinct(), f"{folder}/large-{n}")
        low = kept(large.groupBy("a").agg(F.min("b").alias("low")), f"{folder}/low-{n}")
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        )
        now = kept(small.select("e.a", "e.b").where("a <> b").distinct(), f"{folder}/round-{n}")
        after = summary(now)
        for table in (f"round-{n - 1}", f"least-{n}", f"large-{n}", f"low-{n}"):
            remove(spark, f"{folder}/{table}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
