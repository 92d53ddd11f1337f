"""Sequence, phase and identifier expressions, all built from SQL functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the standard code, codons in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS)}


def support_level(flags: Column) -> Column:
    """First space-separated token as a number; NA, NAN and what is no number become null."""
    token = F.split(F.trim(flags), " ")[0]
    return F.when(~F.upper(token).isin("NA", "NAN"), F.try_to_number(token, F.lit("9999")).cast("double"))


def dna(text: Column) -> Column:
    """A 32-letter DNA word for any text, the same wherever md5 is."""
    return F.translate(F.md5(text), "0123456789abcdef", "ACGTACGTACGTACGT")


def translate_codons(seq: Column) -> Column:
    """Protein of a coding sequence; codons with other letters give X; null unless whole codons."""
    table = F.create_map(*(F.lit(x) for pair in CODONS.items() for x in pair))
    codons = F.regexp_extract_all(F.upper(seq), F.lit("(.{3})"), 1)
    protein = F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(table, c), F.lit("X"))), "")
    return F.when(F.length(seq) % 3 == 0, protein)


def bases_before(phase: Column) -> Column:
    """Bases missing to complete the previous codon: 0, 2, 1 for phases 0, 1, 2."""
    return F.when(phase.isin(0, 1, 2), (3 - phase) % 3)


def bases_after(phase: Column) -> Column:
    """Bases of the next codon that the exon already has."""
    return F.when(phase.isin(0, 1, 2), phase)


def comparable(protein: Column, start_phase: Column, end_phase: Column) -> Column:
    """The residues that do not depend on a neighbouring exon."""
    s = F.when(start_phase.isin(1, 2), F.expr("''").cast("string")).otherwise(F.lit(""))
    head = F.when(start_phase.isin(1, 2), F.substring(protein, 2, 1 << 30)).otherwise(protein)
    return F.concat(s, F.when(end_phase.isin(1, 2), F.left(head, F.greatest(F.length(head) - 1, F.lit(0)))).otherwise(head))


def differ(a: Column, b: Column) -> Column:
    """Phases or coordinates differ; -1 is a wildcard."""
    return (a != b) & (a != -1) & (b != -1)


def trim_end(seq: Column, phase: Column) -> Column:
    """Drop the bases of a codon that the next exon completes."""
    return F.when(phase > 0, F.left(seq, F.greatest(F.length(seq) - phase, F.lit(0)))).otherwise(seq)


def cut_cds(cdna: Column, cds_length: Column, is_first: Column, is_last: Column) -> Column:
    """Coding part of an exon: all, the end of a first exon, the start of a last one, else null."""
    return F.when(F.length(cdna) == cds_length, cdna).when(is_first, F.right(cdna, cds_length)).when(is_last, F.left(cdna, cds_length))


def slice_interval(seq: Column, strand: Column, region_start: Column, region_end: Column, start: Column, end: Column) -> Column:
    """Part of an exon's sequence under a genomic interval, for either strand."""
    first = F.when(strand == 1, start - region_start).otherwise(region_end - end) + 1
    return F.substring(seq, first.cast("int"), (end - start + 1).cast("int"))


def ungapped(seq: Column) -> Column:
    return F.length(F.replace(seq, F.lit("-"), F.lit("")))


def coverage(aligned: Column) -> Column:
    """Percent of an aligned row that is no gap."""
    return F.lit(100.0) * ungapped(aligned) / F.length(aligned)


def coverage_shortest(a: Column, b: Column) -> Column:
    return F.lit(100.0) * F.least(ungapped(a), ungapped(b)) / F.length(a)


def _pairs(a: Column, b: Column, keep) -> tuple[Column, Column]:
    rows = F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: keep(p["x"], p["y"]))
    same = F.size(F.filter(rows, lambda p: p["x"] == p["y"]))
    return same, F.size(rows)


def percent_identity(a: Column, b: Column) -> Column:
    """Percent of columns with equal residues, but for columns of two gaps; null if lengths differ."""
    same, n = _pairs(a, b, lambda x, y: ~((x == "-") & (y == "-")))
    return F.when((F.length(a) == F.length(b)) & (n > 0), F.lit(100.0) * same / n)


def percent_identity_without_gaps(a: Column, b: Column) -> Column:
    """Percent over columns without any gap; null if there is none."""
    same, n = _pairs(a, b, lambda x, y: (x != "-") & (y != "-"))
    return F.when((F.length(a) == F.length(b)) & (n > 0), F.lit(100.0) * same / n)


def max_identity(a: Column, b: Column) -> Column:
    """Upper bound of the identity of two sequences, from their residue counts."""
    letters = F.array_distinct(F.split(a, ""))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.least(count(a, c), count(b, c)))
    return F.lit(100.0) * shared / F.least(F.length(a), F.length(b))


def split_list(text: Column, default: Column) -> Column:
    """Parts of a '/' list, or the default alone if it is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(default)).otherwise(F.split(text, "/"))


def joined_set(col: Column) -> Column:
    """Sorted distinct values of a group joined by '/'."""
    return F.array_join(F.array_sort(F.collect_set(col)), "/")


def constitutive_score(n_transcripts: Column, n_with: Column) -> Column:
    """0.33 for a lone transcript, 1 if in all, 0.66 if in all but one, else 0; null stays."""
    return (
        F.when(n_transcripts.isNull() | n_with.isNull(), F.lit(None).cast("double"))
        .when(n_transcripts == 1, 0.33)
        .when(n_with == n_transcripts, 1.0)
        .when(n_with == n_transcripts - 1, 0.66)
        .otherwise(0.0)
    )


def is_species(name: Column) -> Column:
    return name.rlike(r"^[a-z]+_[a-z]+(_[0-9a-z]+)?$")


def is_stable_gene_id(name: Column) -> Column:
    return name.rlike(r"^ENS.*G[0-9]{11}")


def is_segment_id(name: Column) -> Column:
    return name.rlike(r"^[0-9]+_[0-9]+")


def dataset_name(species: Column) -> Column:
    """First letters of all but the last part of a species name, then that part."""
    parts = F.split(species, "_")
    heads = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.left(p, F.lit(1)))
    return F.concat(F.array_join(heads, ""), F.element_at(parts, -1))


def guard_subpath(sub: Column) -> Column:
    """A sub-path with delimiters, so that ids match whole: not before start, not after stop."""
    return F.concat(F.when(sub.startswith("start"), "").otherwise("/"), sub, F.when(sub.endswith("stop"), "").otherwise("/"))
