"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all of Spark runs on it, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, in a fixed number of tasks.

    Groups of few bytes can be much work each, as alignments are: by size alone
    adaptive execution would put them into one task.
    """
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Spark then removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
_SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def few(table: DataFrame, most: int = 1 << 17) -> bool:
    """Whether a written table has so few rows that each task may hold it."""
    return table.count() <= most


def few_bytes(table: DataFrame, column: str, most: int = 1 << 26) -> DataFrame:
    """A written table, for each task to hold whole if it has few rows and the texts of its long column take few bytes."""
    taken = table.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]
    return F.broadcast(table) if taken <= most and few(table) else table


def small(table: DataFrame, most: int = 1 << 17) -> DataFrame:
    """A written table, for each task to hold whole if it has few rows: larger ones then meet it where they lie."""
    return F.broadcast(table) if few(table, most) else table


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet and read it back: later steps neither recompute nor depend on executors' disks.

    The shuffle files of the write go with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHORT_LIVED, None)
    spark.conf.set(_SHORT_LIVED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHORT_LIVED)
        else:
            spark.conf.set(_SHORT_LIVED, before)
    return spark.read.schema(df.schema).parquet(path)
