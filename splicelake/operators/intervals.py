"""Closed-interval operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranks


def disjoint(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Elementary intervals (keys, lo, hi, n_cover) between consecutive boundaries, gaps with n_cover 0.

    A sweep: +1 at each start, -1 after each end, summed at equal places and
    then in order.  One shuffle by key and no join, however deep intervals nest.
    """
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("lo"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("lo"), F.lit(-1).alias("d")))).alias("s"))
    marks = steps.groupBy(*keys, F.col("s.lo").alias("lo")).agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("lo")
    swept = marks.withColumn("hi", F.lead("lo").over(w) - 1).withColumn("n_cover", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return swept.where("hi is not null").select(*keys, "lo", "hi", "n_cover")


def members(df: DataFrame, keys: Sequence[str], start: str, end: str, item: str, width: int) -> DataFrame:
    """(keys, lo, hi, item) for the items that cover each elementary interval.

    Both sides meet in bins of ``width``, so that the range join is an equi-join
    on (keys, bin) with a residual test.
    """
    grid = disjoint(df, keys, start, end).where("n_cover > 0").withColumn("__bin", F.floor(F.col("lo") / width))
    spread = df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), item).withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__s") / width), F.floor(F.col("__e") / width))))
    hit = grid.join(spread, [*keys, "__bin"]).where("__s <= lo and hi <= __e")
    return hit.select(*keys, "lo", "hi", item)


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covered elementary intervals with a 0-based interval number for each key."""
    return ranks(df.where("n_cover > 0"), keys, ["lo"], "interval_number")


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    covered = disjoint(df, keys, start, end).where("n_cover > 0")
    w = Window.partitionBy(*keys).orderBy("lo")
    new = F.coalesce((F.col("lo") != F.lag("hi").over(w) + 1).cast("int"), F.lit(1))
    runs = covered.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run")


def close_ranges(df: DataFrame, keys: list[str], start: str, stop: str, margin: int = 2) -> DataFrame:
    """Rows with cluster, first and stop: half-open ranges whose surroundings of ``margin`` meet are one cluster, transitively.

    A sweep over the ranges of a key by their left ends: a range begins a
    cluster where it lies beyond the farthest surroundings so far.  Clusters are
    numbered from the left; ``first`` and ``stop`` are the whole of a cluster.
    """
    low = F.greatest(F.col(start) - margin, F.lit(0))
    w = Window.partitionBy(*keys).orderBy("__low", "__high")
    x = df.withColumns({"__low": low, "__high": F.col(stop) + margin})
    reach = F.max("__high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("__new", F.when(F.col("__low") < reach, 0).otherwise(1))
    x = x.withColumn("cluster", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long"))
    whole = Window.partitionBy(*keys, "cluster")
    x = x.withColumns({"first": F.min(start).over(whole), f"__{stop}": F.max(stop).over(whole)})
    return x.select(*df.columns, "cluster", "first", F.col(f"__{stop}").alias("stop"))
