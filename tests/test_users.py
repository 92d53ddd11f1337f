"""Transcripts of users against plain readings of the rules."""

import pytest

from splicelake import users as command
from splicelake.operators import users
from splicelake.sources import tables

USER = "Species string, GeneID string, TranscriptID string, Strand int, ExonID string, ExonRank long, ExonRegionStart long, ExonRegionEnd long, GenomicCodingStart long, GenomicCodingEnd long, StartPhase long, EndPhase long, NucleotideSequence string"
EXONS = "GeneID string, TranscriptID string, ProteinID string, Strand string, ExonID string, ExonRegionStart string, ExonRegionEnd string, ExonRank string, cDNA_CodingStart string, cDNA_CodingEnd string, GenomicCodingStart string, GenomicCodingEnd string, StartPhase string, EndPhase string"


def exon(trx="U1", exon="X1", rank=1, start=100, end=109, coding=(103, 109), strand=1, species="homo_sapiens", seq=None):
    return (species, "G1", trx, strand, exon, rank, start, end, *coding, 0, 0, "A" * (end - start + 1) if seq is None else seq)


@pytest.fixture
def base(spark):
    return spark.createDataFrame([("G1", "T1", "P1", "1", "E1", "100", "109", "1", "1", "10", "100", "109", "0", "0"), ("G1", "T1", "P1", "1", "E2", "200", "209", "2", None, None, None, None, None, None)], EXONS)


def test_rules(spark, base):
    rows = [
        exon(),
        exon(exon="E1", rank=2, coding=(100, 109)),  # the same exon
        exon(exon="E2", rank=3, start=200, end=209, coding=(200, 209)),  # coding only here
        exon(trx="T1", exon="X2"),
        exon(exon="X3", start=9, end=5, seq=""),
        exon(exon="X4", coding=(109, 103)),
        exon(exon="X5", seq="A"),
        exon(exon="X6", species="Homo sapiens"),
        exon(exon="X7", species="homo_sapiens_x"),
    ]
    got = {(r.ExonID, r.fault) for r in users.faults(spark.createDataFrame(rows, USER), base).collect()}
    assert got == {("E2", "known exon with other values"), ("X2", "known transcript"), ("X3", "exon region order"), ("X3", "sequence length"), ("X4", "coding region order"), ("X5", "sequence length"), ("X6", "species name"), ("X7", "species name")}
    with pytest.raises(ValueError, match="U1 E2: known exon with other values"):
        users.check(spark.createDataFrame(rows, USER), base)
    users.check(spark.createDataFrame(rows[:2], USER), base)
    with pytest.raises(ValueError, match="StartPhase"):
        users.faults(spark.createDataFrame(rows, USER).drop("StartPhase"), base)


def places_one_by_one(rows):
    out, upto = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[5])):
        upto[r[2]] = upto.get(r[2], 0) + r[7] - r[6] + 1
        if r[8] is None:
            out[r[2], r[4]] = (None, None)
        else:
            after = r[6] - r[8] if r[3] == -1 else r[7] - r[9]
            out[r[2], r[4]] = (upto[r[2]] - (r[9] - r[8] + 1) - after + 1, upto[r[2]] - after)
    return out


def test_cdna_places(spark):
    rows = [exon(exon="X1", coding=(None, None)), exon(exon="X2", rank=2, start=200, end=230, coding=(205, 230)), exon(exon="X3", rank=3, start=300, end=330, coding=(300, 310)), exon(trx="U2", exon="X4", strand=-1, coding=(102, 109)), exon(trx="U2", exon="X5", rank=2, strand=-1, start=50, end=60, coding=(50, 60))]
    got = {(r.TranscriptID, r.ExonID): (r.cDNA_CodingStart, r.cDNA_CodingEnd) for r in users.cdna_places(spark.createDataFrame(rows, USER)).collect()}
    assert got == places_one_by_one(rows) and got["U1", "X2"] == (16, 41) and got["U1", "X3"] == (42, 52)


def test_the_command_adds_to_all_three_tables(spark, base, tmp_path):
    (tmp_path / "user.csv").write_text(USER.replace(" string", "").replace(" long", "").replace(" int", "").replace(", ", ",") + "\n" + ",".join(map(str, exon())) + "\n" + ",".join(map(str, exon(exon="E1", rank=2, coding=(100, 109)))) + "\n")
    (tmp_path / "tsl.csv").write_text("Species,Name,TranscriptID,Source,ExperimentSource,Biotype,Flags,Version\nhomo_sapiens,N,T1,s,e,protein_coding,1,2\n")
    base.toPandas().to_csv(tmp_path / "exons.tsv", sep="\t", index=False)
    (tmp_path / "seq.fasta").write_text(">homo_sapiens:G1 E1 x\nACGT\n")
    command.main([str(tmp_path / n) for n in ("user.csv", "tsl.csv", "exons.tsv", "seq.fasta", "out")])
    new = spark.read.csv(str(tmp_path / "out" / "exonstable"), header=True, sep="\t").where("TranscriptID = 'U1'").orderBy("ExonRank").collect()
    assert [(r.ProteinID, r.ExonID, r.cDNA_CodingStart, r.cDNA_CodingEnd) for r in new] == [("U1_PROTEIN", "X1", "4", "10"), ("U1_PROTEIN", "E1", "11", "20")]
    trx = spark.read.csv(str(tmp_path / "out" / "tsl"), header=True).where("TranscriptID = 'U1'").first()
    assert (trx.Species, trx.Name, trx.Source, trx.ExperimentSource, trx.Biotype, trx.Flags) == ("homo_sapiens", "U1", "user", "user", "protein_coding", None) and trx.Version
    assert {(r.ExonID, r.seq) for r in tables.read_exon_sequences(spark, str(tmp_path / "out" / "sequences")).collect()} == {("E1", "ACGT"), ("X1", "A" * 10)}


def test_signs_within_fasta_records(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">a b>c d\nAC\nGT\n\n>e\n>f g\r\nAA>\r\n")
    got = [(r.header.strip(), r.id, r.seq) for r in tables.read_fasta(spark, str(tmp_path / "x.fasta")).collect()]
    assert got == [("a b>c d", "b>c", "ACGT"), ("e", "e", ""), ("f g", "g", "AA>")]


def test_species_lists(spark, tmp_path):
    (tmp_path / "good").write_text("homo_sapiens\n\nmus_musculus\n")
    assert [r.species for r in tables.read_species_list(spark, str(tmp_path / "good")).orderBy("place").collect()] == ["homo_sapiens", "mus_musculus"]
    (tmp_path / "bad").write_text("Homo sapiens\n")
    with pytest.raises(Exception, match="not a species name"):
        tables.read_species_list(spark, str(tmp_path / "bad")).collect()
