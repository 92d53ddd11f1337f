"""Delimited tables, species lists, FASTA and Newick readers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import is_species, support_level

TRANSCRIPTS = T.StructType([T.StructField(n, T.StringType()) for n in ("Species", "Name", "TranscriptID", "Source", "ExperimentSource", "Biotype", "Flags", "Version")])
_TEXT = ("GeneID", "TranscriptID", "ProteinID")
_LONG = ("ExonRegionStart", "ExonRegionEnd", "ExonRank", "cDNA_CodingStart", "cDNA_CodingEnd", "GenomicCodingStart", "GenomicCodingEnd", "StartPhase", "EndPhase")
EXONS = T.StructType([*(T.StructField(n, T.StringType()) for n in _TEXT), T.StructField("Strand", T.IntegerType()), T.StructField("ExonID", T.StringType()), *(T.StructField(n, T.LongType()) for n in _LONG)])
USER_EXONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Species", "GeneID", "TranscriptID")]
    + [T.StructField("Strand", T.IntegerType()), T.StructField("ExonID", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("ExonRank", "ExonRegionStart", "ExonRegionEnd", "GenomicCodingStart", "GenomicCodingEnd", "StartPhase", "EndPhase")]
    + [T.StructField("NucleotideSequence", T.StringType())]
)


def read_transcripts(spark: SparkSession, path: str, species: list[str] | None = None, max_level: int | None = 3, remove_missing: bool = False) -> DataFrame:
    """Transcript-support table: protein-coding rows of listed species, with a numeric support level."""
    x = spark.read.csv(path, header=True, schema=TRANSCRIPTS, nullValue="NA")
    x = x.withColumn("TSL", support_level(F.col("Flags"))).where(F.col("Biotype").isin("protein_coding", "Protein coding"))
    if species is not None:
        x = x.where(F.col("Species").isin(*species))
    if max_level is not None:
        ok = F.col("TSL") <= max_level
        x = x.where(ok if remove_missing else ok | F.col("TSL").isNull())
    return x


def read_exons(spark: SparkSession, path: str, drop_incomplete: bool = True) -> DataFrame:
    """Exon table; rows with any missing value go, which removes non-coding exons."""
    x = spark.read.csv(path, header=True, sep="\t", schema=EXONS)
    return x.na.drop("any") if drop_incomplete else x


def read_user_exons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=USER_EXONS)


def read_protein_genes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (ProteinID, GeneID) of an exon table, both present."""
    return read_exons(spark, path, False).select("ProteinID", "GeneID").na.drop("any").distinct()


def species_list(text: str) -> list[str]:
    """Species of a comma-separated list, each with a well-formed name."""
    names = [s.strip() for s in text.split(",") if s.strip()]
    if bad := [s for s in names if not re.fullmatch(r"[a-z]+_[a-z]+(_[0-9a-z]+)?", s)]:
        raise ValueError(f"not species names: {', '.join(bad)}")
    return names


def read_species_list(spark: SparkSession, path: str) -> DataFrame:
    """One species a line, with its place in the list as sort key; a name that is not well-formed is an error."""
    x = spark.read.text(path).select(F.trim("value").alias("species"), F.monotonically_increasing_id().alias("place")).where("species <> ''")
    wrong = F.raise_error(F.concat(F.lit("not a species name: "), F.col("species")))
    return x.withColumn("species", F.when(is_species(F.col("species")), F.col("species")).otherwise(wrong))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records (header, id, seq, file); id is the second word of the header, or the first.

    Records are split by Spark's reader where a line begins with '>' and never
    pass the driver; the sign may stand anywhere else.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"), F.col("_metadata.file_path").alias("file")).where(F.length(F.trim("value")) > 0)
    lines = F.split("value", "\r?\n")
    words = F.split("header", r"\s+")
    x = raw.select(lines[0].alias("header"), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.trim(line)), "").alias("seq"), "file")
    return x.select("header", F.coalesce(F.try_element_at(words, F.lit(2)), words[0]).alias("id"), "seq", "file")


def read_exon_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(ExonID, seq); of records with one id the last in the file stays."""
    x = read_fasta(spark, path).withColumn("__row", F.monotonically_increasing_id())
    return x.groupBy(F.col("id").alias("ExonID")).agg(F.max_by("seq", "__row").alias("seq"))


def read_segment_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster, block, gene, aligned) of files msa_s_exon_<cluster>_<block>.fasta."""
    place = F.regexp_extract("file", r"msa_s_exon_([0-9]+_[0-9]+)\.fasta", 1)
    x = read_fasta(spark, f"{folder.rstrip('/')}/msa_s_exon_*.fasta").withColumn("segment", place).where("segment <> ''")
    return x.select("segment", F.split("segment", "_")[0].cast("int").alias("cluster"), F.split("segment", "_")[1].cast("int").alias("block"), F.split("header", r"\s+")[0].alias("gene"), F.col("seq").alias("aligned"))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, attributes) and edges (source, target, attributes) of a GML file or folder, attributes as a map of strings.

    Spark's reader splits blocks at the line that closes them; attributes stand
    one a line, and strings have no quote within.
    """
    raw = spark.read.option("lineSep", "\n  ]").text(path)
    line = F.lit(r'(?m)^\s*(\w+) "?([^"\n]*)"?\s*$')
    pairs = F.map_from_arrays(F.regexp_extract_all("value", line, F.lit(1)), F.regexp_extract_all("value", line, F.lit(2)))
    blocks = raw.select(F.regexp_extract("value", r"(node|edge) \[", 1).alias("kind"), pairs.alias("m"))
    rest = lambda *names: F.map_filter("m", lambda k, _: ~k.isin(*names)).alias("attributes")
    found = {k: blocks.where(F.col("kind") == k) for k in ("node", "edge")}
    nodes = found["node"].select(F.col("m.id").alias("id"), F.col("m.label").alias("label"), rest("id", "label", "directed"))
    return nodes, found["edge"].select(F.col("m.source").alias("source"), F.col("m.target").alias("target"), rest("source", "target", "directed"))


def parse_newick(text: str) -> list[tuple[int, int | None, str, float | None]]:
    """Nodes (id, parent, name, length) of one tree, the root first."""
    nodes: list[list] = [[0, None, "", None]]
    at, stack = 0, [0]
    for token in re.findall(r"[(),;]|:[^(),;]+|[^(),:;\s]+", text.strip()):
        if token == "(":
            nodes.append([len(nodes), at, "", None])
            stack.append(at)
            at = len(nodes) - 1
        elif token == ",":
            nodes.append([len(nodes), nodes[at][1], "", None])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token.startswith(":"):
            nodes[at][3] = float(token[1:])
        elif token != ";":
            nodes[at][2] = token
    return [tuple(n) for n in nodes]


def prune_newick(text: str, keep: dict[str, str]) -> str:
    """The tree of the leaves in ``keep``, renamed; nodes with one child are contracted, lengths added."""
    nodes = parse_newick(text)
    children: dict = {}
    for i, parent, _, _ in nodes:
        children.setdefault(parent, []).append(i)
    built: dict[int, tuple[str, float | None] | None] = {}
    for i, _, name, length in reversed(nodes):
        kids = [built[k] for k in children.get(i, []) if built[k]]
        if i not in children:
            built[i] = (keep[name], length) if name in keep else None
        elif not kids:
            built[i] = None
        elif len(kids) == 1:
            inner, below = kids[0]
            built[i] = (inner, None if length is None and below is None else (length or 0) + (below or 0))
        else:
            built[i] = ("(" + ",".join(s if d is None else f"{s}:{d:g}" for s, d in kids) + ")", length)
    return (built[0][0] if built.get(0) else "") + ";"
