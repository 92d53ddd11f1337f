"""Ordered-row operators: ranks, phases, runs, running offsets, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def with_phases(df: DataFrame, keys: Sequence[str], order: Sequence, length: str) -> DataFrame:
    """start_phase and end_phase: what is left over of whole codons after each row, and before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    end = (F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 3).cast("long")
    return df.withColumn("end_phase", end).withColumn("start_phase", F.coalesce(F.lag("end_phase").over(w), F.lit(0)).cast("long"))


def check_phases(df: DataFrame, keys: Sequence[str], order: Sequence, start: str, end: str, rank: str) -> DataFrame:
    """Flag rows whose order or declared phases do not follow from the row before; -1 matches all."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, last_rank, is_last = F.lag(end).over(w), F.lag(rank).over(w), F.lead(end).over(w).isNull()
    first = before.isNull()
    bad = (
        (~first & ((before == -1) | ((F.col(start) != before) & (F.col(start) != -1)) | (F.col(start) == -1)))
        | (~first & (F.col(rank) <= last_rank))
        | (~is_last & (F.col(end) == -1))
    )
    return df.withColumn("incomplete", F.coalesce(bad, F.lit(False)))


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({"is_first": F.row_number().over(w) == 1, "is_last": F.lead(F.lit(1)).over(w).isNull()})


def borrow_before(keys: Sequence[str], order: Sequence, seq: str, n: Column, reach: int) -> Column:
    """Last n letters of the sequences before a row; ``reach`` rows back hold n letters at least or all there are."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, -1)
    return F.right(F.array_join(F.collect_list(seq).over(w), ""), n)


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """0-based rank of each row within its group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """As ``ranks``, for groups of any size: 0-based places in a total order, without a group in one task.

    Rows are range-partitioned by keys and order and written with their places
    in the partition; what lies before a partition's rows of a key is summed
    over a row for each partition and key.  Rows that tie in ``order`` get any
    of their places.  Null keys are a group of their own.
    """
    at = F.monotonically_increasing_id()
    by = [*map(F.col, keys), *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.shiftright(at, 33), "__place": at})
    placed = materialize(placed, "numbered")
    parts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return placed.join(parts, same).withColumn(name, F.col("__before") + F.col("__place")).select(*df.columns, name)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a run begins at the first row and where ``breaks`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.row_number().over(w) == 1, 1).when(breaks, 1).otherwise(0))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def contiguous(df: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence) -> DataFrame:
    """Islands of closed intervals that each begin right after the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, F.col(start) != F.lag(end).over(w) + 1)


def equal_runs(df: DataFrame, keys: Sequence[str], order: Sequence, value: str) -> DataFrame:
    """Runs of equal values: island, its first place, value and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = islands(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)))
    return marked.groupBy(*keys, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def running_span(df: DataFrame, keys: Sequence[str], order: Sequence, length: str, start: str = "start", end: str = "end") -> DataFrame:
    """1-based closed places of consecutive segments of given lengths."""
    total = F.sum(length).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({end: total, start: total - F.col(length) + 1})


def connected_pairs(df: DataFrame, keys: Sequence[str], order: Sequence, item: str) -> DataFrame:
    """Distinct pairs of items that follow each other somewhere."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(F.lag(item).over(w).alias("before"), F.col(item).alias("after")).where("before is not null").distinct()
