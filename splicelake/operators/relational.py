"""Filters, joins, keep-first and label operators on rows of transcripts and exons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered


def require(df: DataFrame, *columns: str, hint: str = "") -> DataFrame:
    """The same rows; an error names the columns that are not there."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}. {hint}".strip())
    return df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key: the first in a total order."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__first", row).where("__first = 1").drop("__first")


def support_filter(df: DataFrame, level: str, most: float, remove_missing: bool = False) -> DataFrame:
    """Rows with support level up to ``most`` (1 to 5); those without one unless removed."""
    if most not in (1, 2, 3, 4, 5):
        raise ValueError("the support level must be from 1 to 5")
    ok = F.col(level) <= most
    return df.where(ok if remove_missing else ok | F.col(level).isNull())


def in_list(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows whose value is listed; all if there is no list."""
    return df if values is None else df.where(F.col(column).isin(*values))


def drop_groups(df: DataFrame, keys: Sequence[str], bad: Column) -> DataFrame:
    """Drop all rows of groups that hold a bad row."""
    return df.join(df.where(bad).select(*keys).distinct(), list(keys), "left_anti")


def drop_incomplete(df: DataFrame, trx: str, order: Sequence, protein: str, incomplete: str) -> DataFrame:
    """Drop transcripts with an incomplete exon, or whose joined protein does not end in a stop."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(protein), F.lit("")).alias("__p")))), lambda s: s["__p"]), "")
    bad = df.groupBy(trx).agg(F.bool_or(incomplete).alias("__any"), joined.alias("__all")).where(F.coalesce("__any", F.lit(False)) | ~F.col("__all").endswith("*"))
    return df.join(bad.select(trx), trx, "left_anti")


def drop_bad_quality(df: DataFrame, trx: str, protein: str) -> DataFrame:
    """Drop transcripts with an unknown residue in any exon."""
    return drop_groups(df, [trx], F.col(protein).contains("X"))


def segment_fractions(df: DataFrame, gene: str, trx: str, segment: str) -> DataFrame:
    """The share of a gene's transcripts that have a segment: a row for each gene and segment."""
    counts = df.groupBy(gene, segment).agg(F.count(F.lit(1)).alias("SubexonCount"))
    totals = df.groupBy(gene).agg(F.count_distinct(trx).alias("TranscriptNumber"))
    return counts.join(totals, gene).withColumn("TranscriptFraction", F.col("SubexonCount") / F.col("TranscriptNumber"))


def transcript_fraction(df: DataFrame, gene: str, trx: str, segment: str) -> DataFrame:
    """Rows with the share of a gene's transcripts that have the segment."""
    return df.join(segment_fractions(df, gene, trx, segment), [gene, segment])


def add_user_rows(base: DataFrame, user: DataFrame) -> DataFrame:
    """Rows of users appended with the fixed values that mark them; other columns are null."""
    stamped = user.withColumns({"Source": F.lit("user"), "ExperimentSource": F.lit("user"), "Biotype": F.lit("protein_coding")})
    return base.unionByName(stamped, allowMissingColumns=True)


def user_row_faults(df: DataFrame) -> DataFrame:
    """Rows of user exons that break a rule, with the rules they break."""
    rules = {
        "exon region order": F.col("ExonRegionStart") > F.col("ExonRegionEnd"),
        "coding region order": F.col("GenomicCodingStart") > F.col("GenomicCodingEnd"),
        "sequence length": F.length("NucleotideSequence") != F.col("ExonRegionEnd") - F.col("ExonRegionStart") + 1,
        "species name": ~F.col("Species").rlike("^[a-z]+_[a-z]+$"),
    }
    faults = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return df.withColumn("faults", faults).where(F.size("faults") > 0)


def identical_sequences(df: DataFrame, gene: str, trx: str, seq: str) -> DataFrame:
    """Transcripts of a gene with one sequence: members joined by '/', the least id kept."""
    g = df.groupBy(gene, seq).agg(F.array_sort(F.collect_set(trx)).alias("__m"))
    return g.where(F.size("__m") > 1).select(gene, F.array_join("__m", "/").alias("cluster"), F.col("__m")[0].alias("kept"), F.size("__m").cast("long").alias("n_members"))


def store_cluster(df: DataFrame, labels: DataFrame, key: str, label: str, default: Column) -> DataFrame:
    """Rows with the label of their key, or a default."""
    return df.join(labels, key, "left").withColumn(label, F.coalesce(F.col(label), default))


def store_shared_label(df: DataFrame, members: DataFrame, labels: DataFrame, key: str, group: str, label: str, default: Column) -> DataFrame:
    """Rows with the label of the group of their key, or a default: members hold (key, group), labels (group, label).

    Long labels of large groups are as much as rows times their length.  Rows
    meet a group first, are dealt out by it (large ones over several tasks), and
    take the label last, so that a label is dealt out once for a group, and equal
    ones lie together where they are written.
    """
    found = df.join(members, key, "left").hint("rebalance", group)
    return found.join(labels, group, "left").withColumn(label, F.coalesce(F.col(label), default)).drop(group)


def best_cluster(hits: DataFrame, query: str, cluster: str, coverage: str, identity: str) -> DataFrame:
    """The cluster of each query with most hits, then best coverage, then best identity; ties to the least."""
    g = hits.groupBy(query, cluster).agg(F.count(F.lit(1)).alias("n_hits"), F.max(coverage).alias("best_coverage"), F.max(identity).alias("best_identity"))
    return keep_first(g, [query], [F.desc("n_hits"), F.desc("best_coverage"), F.desc("best_identity"), F.asc(cluster)])


def first_seen_index(df: DataFrame, key: str, order: Sequence) -> DataFrame:
    """A dense 0-based number for each key by first appearance, numbered in parallel."""
    firsts = df.groupBy(key).agg(F.min(F.struct(*order)).alias("__at"))
    return numbered(firsts, [], [F.col("__at"), F.col(key)], "index").select(key, F.col("index").cast("int").alias("index"))


def order_by_list(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows in the order of a list of values; a value that is not listed is an error."""
    place = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    unknown = F.raise_error(F.concat(F.lit("not in the list: "), F.col(column))).cast("bigint")
    return df.orderBy(F.when(place > 0, place).otherwise(unknown))


def orthologs(df: DataFrame, relationships: Sequence[str], forbidden: Sequence[str] = (), species: Sequence[str] | None = None) -> DataFrame:
    """Rows (type, species, ...) of the wanted relationships, without forbidden species, of listed ones."""
    x = df.where(F.col("type").isin(*relationships))
    if forbidden:
        x = x.where(~F.col("species").isin(*forbidden))
    return in_list(x, "species", species)


def label_map(df: DataFrame, key: str, value: str, order: Sequence) -> DataFrame:
    """One value for each key: the last in a total order."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
