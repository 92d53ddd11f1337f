"""Edge counts of paths that keep arriving: the graph operators' aggregates on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def path_steps(paths: DataFrame) -> DataFrame:
    """(family, gene, trx, src, dst) of rows (family, gene, trx, path), path nodes joined by '/'."""
    nodes = F.split("path", "/")
    pairs = F.arrays_zip(F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))).alias("src"), F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))).alias("dst"))
    return paths.select("family", "gene", "trx", F.explode(pairs).alias("e")).select("family", "gene", "trx", "e.src", "e.dst")


def edge_counts(paths: DataFrame) -> DataFrame:
    """Transcripts of each edge and gene; state is one row for each of them."""
    return path_steps(paths).groupBy("family", "src", "dst", "gene").agg(F.count(F.lit(1)).alias("n_trx"))


def start(paths: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep edge counts of a streaming table of paths in a memory table."""
    return edge_counts(paths).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
