"""Splicing events of gene families from transcript, exon and sequence files.

python -m splicelake TRANSCRIPTS EXONS SEQUENCES OUTPUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import paths
from .plans import families
from .session import ship
from .sources import sinks, tables
from .storage import materialize


ALIGNERS = {"progressive": families.progressive_aligner, "star": families.star_aligner}


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="splicelake", description="Splicing events of gene families.")
    p.add_argument("transcripts", help="transcript table (CSV)")
    p.add_argument("exons", help="exon table (TSV)")
    p.add_argument("sequences", help="exon sequences (FASTA)")
    p.add_argument("output", help="folder of the results")
    p.add_argument("--maxtsl", type=int, default=3, help="largest support level; rows without one stay")
    p.add_argument("--minlen", type=int, default=4, help="least residues of a clustered sub-exon")
    p.add_argument("--mingenes", type=int, default=1, help="least genes of an event")
    p.add_argument("--mintranscripts", type=int, default=2, help="least transcripts of an event")
    p.add_argument("--coverage", type=float, default=80.0, help="least coverage within a cluster")
    p.add_argument("--identity", type=float, default=30.0, help="least identity within a cluster")
    p.add_argument("--gapopen", type=float, default=-10.0)
    p.add_argument("--gapextend", type=float, default=-1.0)
    p.add_argument("--padding", type=int, default=10, help="length of the padding between parts that no transcript joins")
    p.add_argument("--specieslist", default=None, help="species separated by commas")
    p.add_argument("--keepunknown", action="store_true", help="keep transcripts with unknown residues")
    p.add_argument("--codes", action="store_true", help="write one-letter codes of segments, PIR records and coded paths too")
    p.add_argument("--nomerge", action="store_true", help="do not join sub-exons that only appear together")
    p.add_argument("--aligner", choices=sorted(ALIGNERS), default="progressive", help="how the rows of a cluster are aligned")
    p.add_argument("--keepsingle", action="store_true", help="keep sub-exons that only align with gaps")
    p.add_argument("--norescue", action="store_true", help="leave sub-exons that were taken out of a cluster alone")
    p.add_argument("--nomovements", action="store_true", help="do not move loose ends of sub-exons within alignments")
    p.add_argument("--nodisintegration", action="store_true", help="keep segments of one residue")
    p.add_argument("--canonical_criteria", default=",".join(paths.REPORT_CRITERIA), help="columns that rank paths, all descending")
    return p.parse_args()


def main() -> None:
    a = arguments()
    spark = SparkSession.builder.appName("splicelake").getOrCreate()
    ship(spark)
    species = tables.species_list(a.specieslist) if a.specieslist else None
    trx = tables.read_transcripts(spark, a.transcripts, species, a.maxtsl)
    rows = families.transcript_exons(trx.select("TranscriptID"), tables.read_exons(spark, a.exons), tables.read_exon_sequences(spark, a.sequences))
    clean = families.clean_exons(rows.withColumn("family", F.lit("family")), not a.keepunknown)
    sub = materialize(families.sub_exons(clean, merge=not a.nomerge), "sub_exons")
    clustered = materialize(families.cluster(sub, a.coverage, a.identity, a.minlen), "clustered")
    options = {"keep_single": a.keepsingle, "rescue": not a.norescue, "movements": not a.nomovements, "disintegration": not a.nodisintegration}
    found, clustered = families.s_exons(clustered, ALIGNERS[a.aligner](None, a.gapopen, a.gapextend), "X" * a.padding, a.identity, a.minlen, **options)
    found = materialize(families.segment_places(found, clustered), "s_exons")
    segments = materialize(families.segments(clustered, found), "segments")
    levels = trx.groupBy(F.col("TranscriptID").alias("trx")).agg(F.min("TSL").cast("double").alias("tsl"))
    events = families.report(segments, found, levels, a.mingenes, a.mintranscripts, a.canonical_criteria.split(","))
    events = events.select(*(F.array_join(c, "/").alias(c) if kind.startswith("array") else F.col(c) for c, kind in events.dtypes))
    for name, df in (("s_exon_table", found), ("path_table", paths.scores(segments)), ("ases_table", events)):
        sinks.write_csv(df, f"{a.output}/{name}", "overwrite")
    nodes = paths.nodes(segments).select(F.xxhash64("node").alias("id"), F.col("node").alias("label"), "conservation", "transcript_fraction")
    edges = paths.edges(segments).select(F.xxhash64("src").alias("source"), F.xxhash64("dst").alias("target"), "conservation", "transcript_fraction", F.col("weighted_conservation").alias("transcript_weighted_conservation"))
    sinks.write_gml(nodes, edges, f"{a.output}/splice_graph")
    if a.codes:
        sinks.write_coded_paths(segments, families.residues(found), f"{a.output}/codes")


if __name__ == "__main__":
    main()
