"""Adds transcripts of users to the tables of a family.

python -m splicelake.users INPUT TRANSCRIPTS EXONS SEQUENCES OUTPUT
"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import users
from .session import ship
from .sources import sinks, tables


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="splicelake.users", description="Add transcripts of users to the tables of a family.")
    p.add_argument("input", help="exons of the new transcripts (CSV)")
    p.add_argument("transcripts", help="transcript table (CSV)")
    p.add_argument("exons", help="exon table (TSV)")
    p.add_argument("sequences", help="exon sequences (FASTA)")
    p.add_argument("output", help="folder of the new tables")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("splicelake.users").getOrCreate()
    ship(spark)
    user = tables.read_user_exons(spark, a.input)
    exons = spark.read.csv(a.exons, header=True, sep="\t")
    users.check(user, exons)
    now = datetime.datetime.now().isoformat(timespec="hours")
    users.exon_rows(user, exons).orderBy("GeneID", "TranscriptID", F.col("ExonRank").cast("long")).write.mode("overwrite").csv(f"{a.output}/exonstable", header=True, sep="\t")
    sinks.write_csv(users.transcript_rows(user, spark.read.csv(a.transcripts, header=True), now), f"{a.output}/tsl", "overwrite", "")
    known = tables.read_fasta(spark, a.sequences)
    added = users.sequence_rows(user, tables.read_exon_sequences(spark, a.sequences))
    sinks.write_fasta(known.select("header", "seq").union(added), f"{a.output}/sequences", "header", "seq")


if __name__ == "__main__":
    main()
