"""Many trees at once, as tables of nodes in preorder.

A node is (tree, node, parent, name, length, pre, post): ``pre`` numbers the
nodes of a tree from its root on, parents before children, and ``post`` is the
last number below a node, so that [pre, post] holds those of its subtree and a
leaf has pre = post.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import parse_newick

NODE = "node long, parent long, name string, length double, pre long, post long"


def read_newick(df: DataFrame, tree: str, text: str) -> DataFrame:
    """The nodes of the Newick text of each row; a null text has none."""
    kind = dict(df.dtypes)[tree]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, source in zip(pdf[tree], pdf[text]):
                nodes = parse_newick(source) if source is not None else []
                last = list(range(len(nodes)))
                for i, parent, _, _ in reversed(nodes):
                    if parent is not None:
                        last[parent] = max(last[parent], last[i])
                rows += [(name, *n, n[0], last[n[0]]) for n in nodes]
            yield pd.DataFrame(rows, columns=[tree, "node", "parent", "name", "length", "pre", "post"], dtype=object)

    return df.select(tree, text).mapInPandas(run, f"`{tree}` {kind}, {NODE}")


def prune(nodes: DataFrame, tree: str, keep: DataFrame) -> DataFrame:
    """The nodes that stay if only the leaves named in ``keep`` (name, label) do, under their labels.

    ``keep`` may hold the tree as well.  A node with one child left is
    contracted into it, their lengths added (null if no one has one).  With the
    leaves that stay numbered in preorder, a node holds an interval of them, and
    nodes that hold the same one are the chain that becomes one node: no
    iteration, whatever the depth.  Nodes are dealt out once, by tree.  A tree
    without a leaf that stays is gone.
    """
    leaf = F.col("pre") == F.col("post")
    plain = ("node", "parent", "name", "length", "pre", "post")
    nodes = nodes.where(F.col(tree).isNotNull())
    if tree in keep.columns:  # labels come along where nodes are dealt out, by tree; all that follows stays there
        asked = keep.where(F.col("name").isNotNull()).select(tree, "name", "label")
        both = nodes.select(tree, *plain).unionByName(asked, allowMissingColumns=True).repartition(tree)
        named = both.withColumn("label", F.max("label").over(Window.partitionBy(tree, "name"))).where("node is not null")
        named = named.withColumn("label", F.when(F.col("name").isNotNull(), F.col("label")))
    else:
        named = nodes.join(keep.dropDuplicates(["name"]), "name", "left").select(tree, *plain, "label").repartition(tree)
    named = named.withColumn("__kept", (leaf & F.col("label").isNotNull()).cast("long"))
    # a node comes twice, where its subtree begins and where it ends: leaves that stay are counted before and up to there
    ends = F.explode(F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("out")), F.struct(F.col("post").alias("at"), F.lit(1).alias("out")))).alias("__e")
    twice = named.select("*", ends).withColumn("__n", F.when(F.col("__e.out") == 0, F.col("__kept")).otherwise(0))
    twice = twice.withColumn("__upto", F.sum("__n").over(Window.partitionBy(tree).orderBy("__e.at", "__e.out", "pre").rowsBetween(Window.unboundedPreceding, 0)))
    one = F.max(F.struct("parent", "name", "label", "length", "post"))
    held = twice.groupBy(tree, "node", "pre").agg(one.alias("v"), F.max(F.when(F.col("__e.out") == 0, F.col("__upto") - F.col("__kept"))).alias("__lo"), F.max(F.when(F.col("__e.out") == 1, F.col("__upto"))).alias("__hi"))
    held = held.where("__hi > __lo").select(tree, "node", "pre", "v.*", "__lo", "__hi")
    chain = Window.partitionBy(tree, "__lo", "__hi")
    held = held.withColumns({"__head": F.max_by("node", "pre").over(chain), "__above": F.min_by("parent", "pre").over(chain), "__sum": F.sum("length").over(chain)})
    # each tells what head it has, and heads ask the node above their chain for its own
    tells = F.struct(F.col("node").alias("key"), F.col("__head").alias("head"), F.lit(False).alias("asks"))
    asks = F.when(F.col("node") == F.col("__head"), F.struct(F.col("__above").alias("key"), F.lit(None).cast(nodes.schema["node"].dataType).alias("head"), F.lit(True).alias("asks")))
    title = F.when(leaf, F.col("label")).otherwise(F.col("name")).alias("name")
    x = held.select(tree, "node", title, F.col("__sum").alias("length"), "pre", "post", F.explode(F.array_compact(F.array(tells, asks))).alias("__x"))
    x = x.withColumn("parent", F.max("__x.head").over(Window.partitionBy(tree, "__x.key"))).where("__x.asks")
    return x.select(tree, "node", "parent", "name", F.when(F.col("parent").isNotNull(), F.col("length")).alias("length"), "pre", "post")


def _number(length: Column) -> Column:
    return F.when(length == F.floor(length), F.floor(length).cast("string")).otherwise(length.cast("string"))


def newick(nodes: DataFrame, tree: str) -> DataFrame:
    """(tree, newick): each tree as text, from what is written on the way into a node and out of it."""
    first = F.col("__place") == 1
    leaf = F.col("pre") == F.col("post")
    title = F.concat(F.coalesce("name", F.lit("")), F.coalesce(F.concat(F.lit(":"), _number(F.col("length"))), F.lit("")))
    comma = F.when(first | F.col("parent").isNull(), "").otherwise(",")
    into = F.struct(F.col("pre").alias("at"), F.lit(0).alias("out"), F.lit(0).cast("long").alias("order"), F.concat(comma, F.when(leaf, title).otherwise("(")).alias("t"))
    out = F.when(~leaf, F.struct(F.col("post").alias("at"), F.lit(1).alias("out"), (-F.col("pre")).alias("order"), F.concat(F.lit(")"), title).alias("t")))
    placed = nodes.withColumn("__place", F.row_number().over(Window.partitionBy(tree, "parent").orderBy("pre")))
    steps = placed.select(tree, F.explode(F.array_compact(F.array(into, out))).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "")
    return steps.groupBy(tree).agg(F.concat(text, F.lit(";")).alias("newick"))
