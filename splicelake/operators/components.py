"""Connected components, cluster merging and cluster relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b): the least node reachable.

    Rounds of two star steps: every node sends its larger neighbours to its
    least one, then its smaller neighbours and itself.  Both keep connectivity
    and shorten paths; edges never outnumber those before.  Only aggregates meet
    at a node of high degree.  Each round is written, so that a lost executor
    costs one round at most.  A node with no edge but to itself is a component.
    """
    # written first: what finds the edges runs once
    ends = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    alone = ends.where("a = b").select(F.col("a").alias("node"))
    e = ends.where("a <> b")
    before = _signature(e)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        sent = F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        e = materialize(large.join(least, "a").select(sent.alias("x")).select("x.a", "x.b").where("a <> b").distinct(), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return found.unionByName(alone.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def _signature(e: DataFrame) -> tuple:
    """Number of edges and the sums of both halves of their hashes: equal for equal edge sets."""
    h = e.select(F.xxhash64("a", "b").alias("h"))
    return tuple(h.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))), F.lit(0)), F.coalesce(F.sum(F.shiftright("h", 31)), F.lit(0))).first())


def merge_clusters(rows: DataFrame, item: str, cluster: str) -> DataFrame:
    """Clusters that share an item become one, named by the least; 0 stands for no cluster.

    Returns rows with ``cluster`` rewritten.
    """
    used = rows.where(F.col(cluster) != 0)
    firsts = used.groupBy(item).agg(F.min(cluster).alias("b"))
    links = used.join(firsts, item).select(F.col(cluster).alias("a"), "b").distinct()
    found = components(links).select(F.col("node").alias(cluster), F.col("component").alias("__to"))
    return rows.join(found, cluster, "left").withColumn(cluster, F.coalesce("__to", cluster)).select(*rows.columns)


def representatives(pairs: DataFrame) -> DataFrame:
    """Ids to delete: all but the least of each group of linked ids."""
    return components(pairs).where("node <> component").select(F.col("node").alias("id"), F.col("component").alias("kept"))
