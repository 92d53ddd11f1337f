"""Transcripts of users: rules against the tables they join, cDNA places, and the rows they add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import add_user_rows, require, user_row_faults

#: Columns a user's table of exons must have; others are not used.
COLUMNS = ("Species", "GeneID", "TranscriptID", "Strand", "ExonID", "ExonRank", "ExonRegionStart", "ExonRegionEnd", "GenomicCodingStart", "GenomicCodingEnd", "StartPhase", "EndPhase", "NucleotideSequence")
#: What an exon of a known id must agree in.
SAME = ("ExonRegionStart", "ExonRegionEnd", "GenomicCodingStart", "GenomicCodingEnd", "StartPhase", "EndPhase")


def clashes(user: DataFrame, exons: DataFrame) -> DataFrame:
    """(TranscriptID) of users' transcripts that the table of exons has already."""
    return user.select("TranscriptID").distinct().join(exons, "TranscriptID", "left_semi")


def changed_exons(user: DataFrame, exons: DataFrame) -> DataFrame:
    """(ExonID) of users' exons that the table has with another value in a column of SAME; missing values are equal."""
    mine = user.select("ExonID", F.struct(*SAME).alias("__mine")).distinct()
    known = exons.select("ExonID", F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in user.select(*SAME).dtypes)).alias("__known")).distinct()
    return mine.join(known, "ExonID").where(~F.col("__mine").eqNullSafe(F.col("__known"))).select("ExonID").distinct()


def faults(user: DataFrame, exons: DataFrame) -> DataFrame:
    """(TranscriptID, ExonID, fault): every rule that rows of users break, alone or against the table of exons."""
    require(user, *COLUMNS, hint="A table of exons of users needs it.")
    alone = user_row_faults(user).select("TranscriptID", "ExonID", F.explode("faults").alias("fault"))
    known = user.join(clashes(user, exons), "TranscriptID", "left_semi").select("TranscriptID", "ExonID", F.lit("known transcript").alias("fault"))
    other = user.join(changed_exons(user, exons), "ExonID", "left_semi").select("TranscriptID", "ExonID", F.lit("known exon with other values").alias("fault"))
    return alone.unionByName(known).unionByName(other).distinct()


def check(user: DataFrame, exons: DataFrame, shown: int = 10) -> None:
    """An error that names the first faults, if there are any."""
    if found := faults(user, exons).orderBy("TranscriptID", "ExonID", "fault").limit(shown).collect():
        raise ValueError("; ".join(f"{r.TranscriptID} {r.ExonID}: {r.fault}" for r in found))


def cdna_places(user: DataFrame) -> DataFrame:
    """Rows with cDNA_CodingStart and cDNA_CodingEnd: where the coding part lies among the exons of its transcript, null without one.

    From the summed lengths of exons by rank, less what follows the coding part
    in its exon: the region's end less the coding end and, on the reverse
    strand, the region's start less the coding start, as tables that this must
    agree with have it.
    """
    w = Window.partitionBy("TranscriptID").orderBy("ExonRank").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("ExonRegionEnd") - F.col("ExonRegionStart") + 1).over(w)
    after = F.when(F.col("Strand") == -1, F.col("ExonRegionStart") - F.col("GenomicCodingStart")).otherwise(F.col("ExonRegionEnd") - F.col("GenomicCodingEnd"))
    coding = F.col("GenomicCodingEnd") - F.col("GenomicCodingStart") + 1
    return user.withColumns({"cDNA_CodingStart": (upto - coding - after + 1).cast("long"), "cDNA_CodingEnd": F.when(coding.isNotNull(), upto - after).cast("long")})


def exon_rows(user: DataFrame, exons: DataFrame) -> DataFrame:
    """The table of exons with the users' rows: a protein id for each transcript, cDNA places, and null where they say nothing."""
    rows = cdna_places(user).withColumn("ProteinID", F.concat("TranscriptID", F.lit("_PROTEIN")))
    kinds = dict(exons.dtypes)
    return exons.unionByName(rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in rows.columns if c in kinds)), allowMissingColumns=True)


def transcript_rows(user: DataFrame, transcripts: DataFrame, version: str) -> DataFrame:
    """The table of transcripts with one row for each of the users', named by its id."""
    mine = user.select("Species", "TranscriptID").distinct().withColumns({"Name": F.col("TranscriptID"), "Version": F.lit(version)})
    kinds = dict(transcripts.dtypes)
    rows = add_user_rows(mine.limit(0), mine)
    return transcripts.unionByName(rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in rows.columns if c in kinds)), allowMissingColumns=True)


def sequence_rows(user: DataFrame, sequences: DataFrame) -> DataFrame:
    """(header, seq) for FASTA of the users' exons whose id ``sequences`` (ExonID, seq) does not hold: a known exon keeps its sequence."""
    place = F.concat_ws(":", F.lit("na"), F.lit("na"), F.lit("na"), "ExonRegionStart", "ExonRegionEnd", "Strand")
    header = F.concat_ws(" ", F.concat_ws(":", "Species", "GeneID"), "ExonID", place)
    return user.join(sequences, "ExonID", "left_anti").select(header.alias("header"), F.col("NucleotideSequence").alias("seq")).distinct()
