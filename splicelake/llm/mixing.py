"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize, word_count

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2.0
#: Documents that a stratum of a source holds on average.
ROWS_IN_STRATUM = 2000
SEED = 20


def unit_hash(seed: int, *cols: str) -> Column:
    """60 bits of an md5 over the seed and columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size, rows) by water-filling.

    Sources by code point, null last, get the weights in turn.  A source takes
    min(epochs * size, level * weight).  Sorted by epochs * size / weight, the
    clamped sources are a prefix, and the level is what they leave divided by
    the weight of the rest: the fixed point that reclamping round by round
    reaches.  The table has a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.array(*(F.lit(float(w)) for w in weights))
    s = sources.withColumn("weight", F.element_at(weight, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    filled = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    upto, onward, every = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward))
    feasible = (F.col("cap") <= F.col("level") * F.col("weight")).cast("int")
    s = s.withColumn("clamped", F.min(feasible).over(filled.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    s = s.withColumn("water", F.first(F.when(~F.col("clamped"), F.col("level")), ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "rows", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies for each document.

    A source repeats ``floor(target / size)`` times whole.  The rest of its
    target is taken by whole documents once more: a source is dealt into strata
    by a seeded hash, about ROWS_IN_STRATUM documents each, whatever its size,
    and each stratum takes documents in hash order up to its part of the rest,
    then the one document left that comes nearest to what is missing.

    A null text has size 0, a null source is a source of its own, repeated rows
    are documents of their own, and an empty table gives no rows.  A source of
    size 0 has target 0.  ``key`` adds a column of its own, by which ties go last.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (F.lit(0) if key is None else key).cast("long").alias("key"))
    sized = materialize(sized, "sizes")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, share, epochs)
    aims = aims.select(F.col("source").alias("s_source"), "source_size", "rows", "target", whole.alias("whole")).withColumn(
        "fraction", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(F.lit(0.0))
    )
    x = sized.join(aims, F.col("source").eqNullSafe(F.col("s_source")))
    x = x.withColumn("h", unit_hash(seed, "doc_id")).withColumn("stratum", F.pmod(F.col("h"), F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_IN_STRATUM))))
    part = Window.partitionBy("source", "stratum")
    run = part.orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("upto", F.sum("size").over(run)).withColumn("aim", F.col("fraction") * F.sum("size").over(part))
    x = x.withColumn("first", F.col("upto") <= F.col("aim"))
    x = x.withColumn("gap", F.col("aim") - F.coalesce(F.max(F.when(F.col("first"), F.col("upto"))).over(part), F.lit(0)))
    x = x.withColumn("off", F.when(~F.col("first"), F.abs(F.col("size") - F.col("gap"))))
    near = part.orderBy(F.col("off").asc_nulls_last(), "h", "doc_id", "size", "key")
    extra = F.col("first") | ((F.row_number().over(near) == 1) & (F.col("off") < F.abs(F.col("gap"))))
    x = x.withColumn("copies", F.least(F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long"), F.lit(int(epochs)).cast("long")))
    return x.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *["key"] * (key is not None))


def repeat(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture itself: each row of docs, all columns, as often as the mix takes it.

    Rows are told apart by doc_id and a hash of all columns, so that only rows
    that are equal throughout share a number; reruns agree.
    """
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("__row", F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0) if "__copies" not in df.columns else F.desc("__copies"))))

    times = mix(docs, weights, share, epochs, seed, whole)
    times = numbered(times.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies")))
    times = times.select(F.col("__id").alias("__t_id"), F.col("__key").alias("__t_key"), F.col("__row").alias("__t_row"), "__copies")
    rows = numbered(docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": whole}))
    same = F.col("__id").eqNullSafe(F.col("__t_id")) & (F.col("__key") == F.col("__t_key")) & (F.col("__row") == F.col("__t_row"))
    taken = rows.join(times, same).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
