"""The table of events: against a plain reading on random families, and against tables of real families.

GOLDEN_TABLES may name a folder with a folder for each run of a single-machine
tool (path_table.csv, ases_table.csv, msa/msa_s_exon_*.fasta below it); the
last test is skipped without.
"""

import csv
import os
import random
from collections import Counter
from pathlib import Path

import pytest

from splicelake.operators import paths, relational
from splicelake.sources import sinks
from splicelake.storage import materialize

SEGMENTS = "family string, gene string, trx string, node string, rk long"
RESIDUES = "family string, gene string, node string, aligned string"
LETTERS = "ACDE-"


def families(seed, n=3):
    rng, seg, res = random.Random(seed), [], []
    for f in range(n):
        nodes = [f"{i}_0" for i in range(8)]
        width = {v: rng.randint(1, 4) for v in nodes}
        for g in range(4):
            gene = f"f{f}g{g}"
            for v in nodes:
                if rng.random() < 0.9:
                    res.append((f"f{f}", gene, v, "".join(rng.choice(LETTERS) for _ in range(width[v]))))
            for t in range(rng.randint(1, 3)):
                kept = [v for v in nodes if rng.random() < 0.6] or nodes[:1]
                seg += [(f"f{f}", gene, f"{gene}t{t}", v, r) for r, v in enumerate(kept)]
    return seg, res


def column(letters):
    real = Counter(c for c in letters if c != "-")
    if not real:
        return ""
    top = max(real.values())
    best = [c for c in real if real[c] == top]
    sign = best[0] if len(best) == 1 and top >= 0.5 * sum(real.values()) else "X"
    gaps = letters.count("-")
    return sign.lower() if gaps > top and 2 * gaps >= len(letters) else sign


def side(family, sub, walks, residues):
    """Genes, weighted conservation, lengths and consensus of a sub-path, read from its definition."""
    mine = {t: (g, p) for (f, g, t), p in walks.items() if f == family}
    genes = sorted({g for g, _ in mine.values()})
    holds = {t for t, (g, p) in mine.items() if f"/{sub}/" in f"/{p}/"}
    holding = sorted({mine[t][0] for t in holds})
    share = sum(sum(mine[t][0] == g for t in holds) / sum(x == g for x, _ in mine.values()) for g in holding) / len(genes)
    inner = sub.split("/")[1:-1]
    lengths = [sum(len(residues.get((family, g, v), "").replace("-", "")) for v in inner) for g in holding] if inner else [0]
    rows = [[residues[family, g, v] for g in holding if (family, g, v) in residues] for v in inner]
    text = "".join(column("".join(letters)) for block in rows for letters in zip(*block))
    return holding, round(share, 9), (min(lengths), round(sum(lengths) / len(lengths), 9), max(lengths)), text


def of(row, name):
    return row[f"{name}_genes"], round(row[f"{name}_weighted_conservation"], 9), (row[f"{name}_min_length"], round(row[f"{name}_mean_length"], 9), row[f"{name}_max_length"]), row[f"{name}_consensus"]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_a_plain_reading(spark, seed):
    seg, res = families(seed)
    s = materialize(spark.createDataFrame(seg, SEGMENTS), "segments")
    walks = {(r.family, r.gene, r.trx): r.path for r in paths.path_strings(s).collect()}
    found = materialize(paths.supported_events(s), "events")
    got = paths.event_report(found, materialize(paths.path_strings(s), "paths"), spark.createDataFrame(res, RESIDUES)).collect()
    assert len(got) == found.count() > 5
    residues = {(f, g, v): a for f, g, v, a in res}
    for r in got:
        assert of(r, "canonical") == side(r.family, r.canonical_path, walks, residues)
        assert of(r, "alternative") == side(r.family, r.alternative_path, walks, residues)
        assert r.common_genes == sorted(set(r.canonical_genes) & set(r.alternative_genes))
        pairs = []
        if r.ase not in ("insertion", "deletion"):
            for a in r.alternative_path.split("/")[1:-1]:
                for c in r.canonical_path.split("/")[1:-1]:
                    if sum(f == r.family and f"/{a}/" in p and f"/{c}/" in p for (f, _, _), p in walks.items()) < 2:
                        pairs.append((c, a))
        assert (r.exclusive_canonical, r.exclusive_alternative) == ("/".join(c for c, _ in pairs), "/".join(a for _, a in pairs))
    order = [(len(r.common_genes), r.canonical_path, r.alternative_path) for r in got]
    assert order == sorted(order, reverse=True)


def test_report_of_no_events(spark):
    s = materialize(spark.createDataFrame([("f", "g", "t", "1_0", 0)], SEGMENTS), "segments")
    got = paths.event_report(paths.supported_events(s), paths.path_strings(s), spark.createDataFrame([], RESIDUES))
    assert got.count() == 0 and {"canonical_consensus", "exclusive_alternative", "common_genes"} <= set(got.columns)


def test_transcript_lengths(spark):
    s = spark.createDataFrame([("f", "g", "t", "1_0", 0), ("f", "g", "t", "2_0", 1), ("f", "g", "u", "3_0", 0)], SEGMENTS)
    r = spark.createDataFrame([("f", "g", "1_0", "AC-"), ("f", "g", "2_0", "D")], RESIDUES)
    assert {(x.trx, x.trx_length) for x in paths.transcript_lengths(s, r).collect()} == {("t", 3), ("u", 0)}


def test_coded_paths(spark, tmp_path):
    s = spark.createDataFrame([("f", "g", "t", "1_0", 0), ("f", "g", "t", "2_0", 1), ("f", "h", "u", "2_0", 0)], SEGMENTS)
    r = spark.createDataFrame([("f", "g", "1_0", "AC-"), ("f", "g", "2_0", "D*"), ("f", "h", "2_0", "-E")], RESIDUES)
    codes, records, lines = sinks.coded_paths(s, r)
    a, b = sinks.ALPHABET[:2]
    assert {(x.node, x.code) for x in codes.collect()} == {("1_0", a), ("2_0", b)}
    assert {x.value for x in records.collect()} == {f">P1;g t {a}{b}\n{a}{a}{b}\nACD*", f">P1;h u {b}\n{b}\nE*"}
    assert {x.value for x in lines.collect()} == {f"g {a}{b}", f"h {b}"}
    sinks.write_coded_paths(s, r, str(tmp_path / "out"))
    assert {x.value for x in spark.read.text(str(tmp_path / "out" / "s_exons")).collect()} == {f"1_0\t{a}", f"2_0\t{b}"}


def test_required_columns(spark):
    s = spark.createDataFrame([], SEGMENTS)
    assert relational.require(s, "node", "rk") is s
    with pytest.raises(ValueError, match="no column seq. Read it"):
        relational.require(s, "node", "seq", hint="Read it.")


def golden_runs():
    root = os.environ.get("GOLDEN_TABLES")
    return sorted(Path(root).rglob("ases_table.csv")) if root else []


def test_tables_of_real_families(spark):
    if not golden_runs():
        pytest.skip("no tables of real families")
    seg, res, known, want_paths, want_events = [], [], [], {}, {}
    for file in golden_runs():
        family, fams = file.parent.parent.name, file.parent
        for row in csv.DictReader(open(fams / "path_table.csv")):
            trx = row["TranscriptIDCluster"]
            seg += [(family, row["GeneID"], trx, v, i) for i, v in enumerate(row["Path"].split("/")[1:-1])]
            known.append((family, trx, int(row["TranscriptLength"]), float(row["TSL"]) if row["TSL"] else None))
            want_paths[family, trx] = row
        for msa in (fams / "msa").glob("msa_s_exon_*.fasta"):
            for record in msa.read_text().split(">")[1:]:
                gene, _, text = record.partition("\n")
                res.append((family, gene.strip(), msa.stem.removeprefix("msa_s_exon_"), text.replace("\n", "")))
        for row in csv.DictReader(open(file)):
            want_events[family, row["CanonicalPath"], row["AlternativePath"]] = row
    s = materialize(spark.createDataFrame(seg, SEGMENTS), "segments")
    residues = materialize(spark.createDataFrame(res, RESIDUES), "residues")
    near = lambda a, b: abs(float(a) - float(b)) < 1e-9
    table = paths.scores(s).join(paths.transcript_lengths(s, residues), ["family", "trx"]).collect()
    assert len(table) == len(want_paths)
    for r in table:
        w = want_paths[r.family, r.trx]
        assert r.path == w["Path"] and r.path_genes == int(w["PathGeneNumber"])
        assert r.trx_length == int(w["TranscriptLength"]) or "/0_" in r.path  # segments of one sub-exon have no alignment file
        for mine, theirs in (("conservation", "Conservation"), ("transcript_fraction", "TranscriptFraction"), ("weighted_conservation", "TranscriptWeightedConservation")):
            assert near(r[f"min_{mine}"], w[f"Minimum{theirs}"]) and near(r[f"sum_{mine}"], w[f"{theirs}Sum"]) and near(r[f"mean_{mine}"], w[f"Mean{theirs}"])
    for file in golden_runs():
        told = file.parent / "phylosofs"
        mine = s.where(s.family == file.parent.parent.name)
        codes, _, lines = sinks.coded_paths(mine, residues.where(residues.family == file.parent.parent.name))
        assert {f"{x.node}\t{x.code}" for x in codes.collect()} == set((told / "s_exons.tsv").read_text().splitlines())
        sets = lambda text: sorted((v.split(" ")[0], *sorted(v.split(" ")[1:])) for v in text)
        assert sets(x.value for x in lines.collect()) == sets((told / "transcripts.txt").read_text().splitlines())
    levels = spark.createDataFrame(known, "family string, trx string, trx_length long, tsl double")
    found = materialize(paths.supported_events(s, criteria=paths.REPORT_CRITERIA, known=levels), "events")
    got = paths.event_report(found, materialize(paths.path_strings(s), "paths"), residues).collect()
    assert {(r.family, r.canonical_path, r.alternative_path) for r in got} == set(want_events)
    for r in got:
        w = want_events[r.family, r.canonical_path, r.alternative_path]
        assert (r.ase, r.mutual_exclusivity, r.exclusive_canonical, r.exclusive_alternative) == (w["ASE"], w["MutualExclusivity"], w["MutualExclusiveCanonical"], w["MutualExclusiveAlternative"])
        assert "/".join(r.common_genes) == w["CommonGenes"]
        for mine, theirs in (("canonical", "CanonicalPath"), ("alternative", "AlternativePath")):
            assert "/".join(r[f"{mine}_genes"]) == w[f"{theirs}Genes"] and r[f"{mine}_consensus"] == w[f"{theirs}Consensus"]
            assert near(r[f"{mine}_weighted_conservation"], w[f"{theirs}TranscriptWeightedConservation"])
            assert (r[f"{mine}_min_length"], r[f"{mine}_max_length"]) == (int(w[f"{theirs}MinSeqLength"]), int(w[f"{theirs}MaxSeqLength"])) and near(r[f"{mine}_mean_length"], w[f"{theirs}MeanSeqLength"])
