"""Whole proteins from exons, equal exons and merged sub-exons."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from splicelake.operators import exons as E
from splicelake.plans import families
from splicelake.sources import tables

COLUMNS = "GeneID string, TranscriptID string, ExonID string, Strand int, ExonRank long, ExonRegionStart long, ExonRegionEnd long, cDNA_CodingStart long, cDNA_CodingEnd long, GenomicCodingStart long, GenomicCodingEnd long, StartPhase long, EndPhase long, seq string"


def transcript(trx, parts, gene="g", utr=("", "")):
    """Exons of a transcript on the + strand from coding parts (exon id, start, dna); untranslated ends around them."""
    rows, at, phase = [], 1, 0
    for i, (exon, start, dna) in enumerate(parts):
        first, last = i == 0, i == len(parts) - 1
        left, right = utr[0] if first else "", utr[1] if last else ""
        end_phase = (phase + len(dna)) % 3
        rows.append((gene, trx, exon, 1, i + 1, start - len(left), start + len(dna) + len(right) - 1, at, at + len(dna) - 1, start, start + len(dna) - 1, -1 if left else phase, -1 if right else end_phase, left + dna + right))
        at, phase = at + len(dna), end_phase
    return rows


def got(spark, rows):
    x = E.proteins(spark.createDataFrame(rows, COLUMNS)).orderBy("TranscriptID", "ExonRank").collect()
    return [(r.TranscriptID, r.protein, r.incomplete) for r in x]


def test_shared_codons_belong_to_the_later_exon(spark):
    rows = transcript("t", [("a", 100, "ATGAAAC"), ("b", 200, "TGG"), ("c", 300, "TG"), ("d", 400, "TAA")])
    assert got(spark, rows) == [("t", "MK", False), ("t", "L", False), ("t", "V", False), ("t", "*", False)]


def test_untranslated_ends(spark):
    assert got(spark, transcript("t", [("a", 100, "ATGTAA")], utr=("CC", "GGG"))) == [("t", "M*", False)]
    two = transcript("t", [("a", 100, "ATGA"), ("b", 200, "AATAA")], utr=("CC", "G"))
    assert got(spark, two)[0] == ("t", "M", False) and got(spark, two)[1] == ("t", "K*", False)


def test_incomplete_exons(spark):
    rows = transcript("t", [("a", 100, "ATGTA")])
    assert got(spark, rows) == [("t", "", True)]
    cut_start = [tuple(1 if n == 11 else v for n, v in enumerate(transcript("t", [("a", 100, "TGTAA")])[0]))]
    assert got(spark, cut_start)[0][2]
    assert got(spark, []) == []


def test_whole_transcripts_stay(spark):
    good = transcript("t1", [("a", 100, "ATGAAA"), ("b", 200, "TAA")])
    same = transcript("t2", [("a", 100, "ATGAAA"), ("c", 200, "TGA")])
    no_stop = transcript("t3", [("a", 100, "ATGAAA"), ("d", 300, "AAA")])
    unknown = transcript("t4", [("a", 100, "ATGANN"), ("b", 200, "TAA")])
    shifted = [tuple(1 if n == 12 and r[2] == "a" else v for n, v in enumerate(r)) for r in transcript("t5", [("a", 100, "ATGAAA"), ("b", 200, "TAA")])]
    x = E.read(spark.createDataFrame(good + same + no_stop + unknown + shifted, COLUMNS)).orderBy("ExonRank").collect()
    assert [(r.TranscriptID, r.TranscriptIDCluster, r.ExonID, r.protein) for r in x] == [("t1", "t1/t2", "a", "MK"), ("t1", "t1/t2", "b", "*")]


def test_equal_exons_share_an_id(spark):
    rows = transcript("t1", [("b", 100, "ATGAAA"), ("x", 200, "TAA")]) + transcript("t2", [("a", 100, "ATGAAA"), ("y", 300, "CCCTAA")]) + transcript("t3", [("c", 101, "ATGAAA"), ("z", 200, "TGA")])
    x = E.merge_identical(E.proteins(spark.createDataFrame(rows, COLUMNS)), "ExonID").collect()
    assert {(r.TranscriptID, r.ExonID, r.ExonIDCluster) for r in x} == {("t1", "a", "a/b"), ("t2", "a", "a/b"), ("t3", "c", "c"), ("t1", "x", "x/z"), ("t3", "x", "x/z"), ("t2", "y", "y")}


@pytest.mark.parametrize("merge", [True, False])
def test_sub_exons_that_only_appear_together_are_one(spark, merge):
    # e2 begins one base later than e1 and reads in another frame, so no sub-exon of one equals one of the other
    rows = transcript("t1", [("e1", 100, "ATGAAATTTTAA")]) + transcript("t2", [("e0", 50, "ATG"), ("e2", 101, "TGAAATTTTAA"[:9])])
    x = families.sub_exons(spark.createDataFrame(rows, COLUMNS).withColumn("family", F.lit("f")), merge=merge).orderBy("TranscriptID", "SubexonRank").collect()
    one = [r for r in x if r.TranscriptID == "t1"]
    if merge:
        assert len(one) == 1 and (one[0].lo, one[0].hi, one[0].protein, one[0].SubexonID) == (100, 111, "MKF*", "e1_SE_1_2_3")
    else:
        assert [(r.lo, r.hi) for r in one] == [(100, 100), (101, 109), (110, 111)] and "".join(r.protein for r in one) == "MKF*"
    assert all(r.TranscriptFraction == 0.5 for r in x)


def test_real_gene(spark):
    root = os.environ.get("GOLDEN_TABLES")
    folder = next((p.parent for p in Path(root).rglob("exonstable.tsv") if "GPRIN1" in str(p)), None) if root else None
    if folder is None:
        pytest.skip("no tables of real genes")
    trx = tables.read_transcripts(spark, str(folder / "tsl.csv"))
    rows = families.transcript_exons(trx.select("TranscriptID"), tables.read_exons(spark, str(folder / "exonstable.tsv")), tables.read_exon_sequences(spark, str(folder / "sequences.fasta")))
    clean = families.clean_exons(rows)
    x = {r.ExonIDCluster: r for r in clean.collect()}
    assert sum(r.Strand == 1 for r in x.values()) == 2 and sum(r.Strand == -1 for r in x.values()) == 7
    human, pig = x["ENSE00001159289"], x["ENSSSCE00000122667"]
    assert human.protein.startswith("MDTAEDPAWLQLLQ") and human.protein.endswith("RPRCCSRAGPTAE*") and len(human.protein) * 3 == 176599834 - 176596808 + 1
    assert (human.StartPhase, human.EndPhase, human.GenomicCodingStart, human.GenomicCodingEnd) == (-1, -1, 176596808, 176599834)
    assert pig.protein.startswith("MKERCPSQQRASPAPSRQ") and pig.protein.endswith("SSRLSSPLPS*") and (pig.GenomicCodingStart, pig.GenomicCodingEnd) == (81315368, 81318382)
    assert "ENSMUST00000099506/ENSMUST00000135343" in {r.TranscriptIDCluster for r in x.values()}
    sub = families.sub_exons(clean.withColumn("family", F.lit("f"))).collect()
    assert len(sub) == 9 and all(r.TranscriptFraction == 1.0 for r in sub)
    names = {r.SubexonID: r for r in sub}
    for exon, whole in (("ENSE00001159289", human), ("ENSSSCE00000122667", pig)):
        r = names[f"{exon}_SE_0"]
        assert (r.protein, r.StartPhase, r.EndPhase, r.lo, r.hi) == (whole.protein, 0, 0, whole.GenomicCodingStart, whole.GenomicCodingEnd)
