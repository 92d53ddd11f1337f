"""What the operators of this subpackage share: written tables and small helpers."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_folder

__all__ = ["load", "materialize", "new_path", "open_fs", "pieces_of", "shared_folder", "word_count"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path on it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pieces_of(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20):
    """Cut a record batch into slices of a bounded number of text bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    lengths = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def word_count(col) -> F.Column:
    """Number of runs that hold neither a space nor one of U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
