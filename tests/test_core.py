"""Operators of the library on small hand-made tables."""

import numpy as np
from pyspark.sql import functions as F

from splicelake.functions import sequences as S
from splicelake.operators import alignment, components, intervals, ordered, paths, relational, similarity
from splicelake.sources import sinks, tables


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in values.items()))
    return df.select(expr).first()[0]


def test_disjoint_intervals_report_gaps(spark):
    df = spark.createDataFrame([("g", 1, 9), ("g", 10, 30), ("g", 20, 30), ("g", 40, 50)], "k string, s int, e int")
    assert rows(intervals.disjoint(df, ["k"], "s", "e"), "lo", "hi", "n_cover") == [(1, 9, 1), (10, 19, 1), (20, 30, 2), (31, 39, 0), (40, 50, 1)]
    assert rows(intervals.merged(df, ["k"], "s", "e"), "lo", "hi") == [(1, 30), (40, 50)]
    assert rows(intervals.members(df, ["k"], "s", "e", "s", 8).where("lo = 20"), "s") == [(10,), (20,)]


def test_disjoint_intervals_of_nothing(spark):
    assert intervals.disjoint(spark.createDataFrame([], "k string, s int, e int"), ["k"], "s", "e").count() == 0


def test_phases_follow_running_length(spark):
    df = spark.createDataFrame([("t", 0, 6), ("t", 1, 4), ("t", 2, 4)], "t string, r int, n int")
    assert rows(ordered.with_phases(df, ["t"], ["r"], "n"), "r", "start_phase", "end_phase") == [(0, 0, 0), (1, 0, 1), (2, 1, 2)]


def test_phase_check(spark):
    df = spark.createDataFrame([("t", 0, 0, 1, 1), ("t", 1, 1, 0, 2), ("t", 2, 2, 0, 3), ("u", 0, -1, -1, 1)], "t string, r int, s int, e int, k int")
    assert rows(ordered.check_phases(df, ["t"], ["r"], "s", "e", "k"), "t", "r", "incomplete") == [("t", 0, False), ("t", 1, False), ("t", 2, True), ("u", 0, False)]


def test_translation(spark):
    assert one(spark, S.translate_codons(F.col("s")), s="ATGTTTTAANNN") == "MF*X"
    assert one(spark, S.translate_codons(F.col("s")), s="ATGT") is None


def test_identity_and_coverage(spark):
    assert one(spark, S.percent_identity(F.col("a"), F.col("b")), a="AA---", b="AAAA-") == 50.0
    assert one(spark, S.percent_identity_without_gaps(F.col("a"), F.col("b")), a="AA---", b="GAAA-") == 50.0
    assert one(spark, S.percent_identity(F.col("a"), F.col("b")), a="AA", b="A") is None
    assert one(spark, S.coverage(F.col("a")), a="AA--") == 50.0
    assert one(spark, S.max_identity(F.col("a"), F.col("b")), a="AAC", b="ACCC") == 100.0 * 2 / 3


def test_small_scalars(spark):
    assert one(spark, S.support_level(F.col("f")), f="1 (assigned to previous version 7)") == 1.0
    assert one(spark, S.support_level(F.col("f")), f="NA") is None
    assert one(spark, S.comparable(F.col("p"), F.lit(1), F.lit(2)), p="MKLV") == "KL"
    assert one(spark, S.dataset_name(F.col("s")), s="homo_sapiens") == "hsapiens"
    assert one(spark, S.guard_subpath(F.col("s")), s="start/1_0") == "start/1_0/"
    assert one(spark, S.split_list(F.col("s"), F.lit("6")), s="") == ["6"]
    assert one(spark, S.split_list(F.col("s"), F.lit("6")), s="4/2") == ["4", "2"]
    assert one(spark, S.slice_interval(F.col("s"), F.lit(-1), F.lit(10), F.lit(15), F.lit(10), F.lit(12)), s="ABCDEF") == "DEF"
    assert one(spark, S.is_species(F.col("s")), s="mus_musculus") is True


def _segments(spark, spec):
    data = [("f", g, t, n, i) for g, t, p in spec for i, n in enumerate(p.split())]
    return spark.createDataFrame(data, "family string, gene string, trx string, node string, rk int")


SPEC = [("g1", "t1", "a b c d"), ("g1", "t2", "a c d"), ("g2", "t3", "a b c d"), ("g2", "t4", "a x c d"), ("g3", "t5", "a x c d")]


def test_edges_and_weighted_conservation(spark):
    e = {(r.src, r.dst): r for r in paths.edges(_segments(spark, SPEC)).collect()}
    assert e["start", "a"].n_genes == 3 and e["start", "a"].weighted_conservation == 1.0
    assert e["a", "b"].n_trx == 2 and abs(e["a", "b"].weighted_conservation - 1 / 3) < 1e-11
    assert abs(e["a", "x"].conservation - 200 / 3) < 1e-9


def test_events_types_and_support(spark):
    s = _segments(spark, SPEC)
    p = paths.path_strings(s)
    canon = p.where("trx = 't1'").select("family", "path")
    found = paths.events(p, canon)
    assert rows(found, "canonical_path", "alternative_path") == [("a/b/c", "a/c"), ("a/b/c", "a/x/c")]
    held = {r.alternative_path: (r.n_genes, r.n_trx) for r in paths.support(p, found, "alternative_path").collect()}
    assert held == {"a/c": (1, 1), "a/x/c": (2, 2)}
    kinds = {r[0]: r[1] for r in found.select("alternative_path", paths.event_type(F.col("canonical_path"), F.col("alternative_path"))).collect()}
    assert kinds == {"a/c": "deletion", "a/x/c": "alternative"}
    table = found.join(paths.support(p, found, "alternative_path"), ["family", "alternative_path"]).withColumn("ase", paths.event_type(F.col("canonical_path"), F.col("alternative_path")))
    assert rows(paths.mutual_exclusivity(table, p), "alternative_path", "mutual_exclusivity") == [("a/c", ""), ("a/x/c", "mutually_exclusive")]


def test_canonical_takes_the_best_path(spark):
    assert paths.canonical(paths.scores(_segments(spark, SPEC))).count() == 1


def test_runs_and_islands(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("aabba")], "k string, i int, v string")
    assert rows(ordered.equal_runs(df, ["k"], ["i"], "v"), "v", "n") == [("a", 1), ("a", 2), ("b", 2)]
    x = spark.createDataFrame([("k", 1, 3), ("k", 4, 6), ("k", 8, 9)], "k string, s int, e int")
    assert rows(ordered.contiguous(x, ["k"], "s", "e", ["s"]), "s", "island") == [(1, 1), (4, 1), (8, 2)]


def test_components_and_merging(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (40, 40)], "a long, b long")
    found = dict(rows(components.components(e)))
    assert {found[i] for i in range(1, 21)} == {1} and found[31] == 30 and found[40] == 40
    x = spark.createDataFrame([("i", 3), ("i", 5), ("j", 5), ("k", 9), ("l", 0)], "item string, cl long")
    assert rows(components.merge_clusters(x, "item", "cl")) == [("i", 3), ("i", 3), ("j", 3), ("k", 9), ("l", 0)]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("t", 1, "M", False), ("t", 2, "K*", False), ("u", 1, "MX*", False), ("v", 1, None, False)], "trx string, r int, p string, bad boolean")
    assert rows(relational.drop_incomplete(df, "trx", ["r"], "p", "bad"), "trx") == [("t",), ("t",), ("u",)]
    assert rows(relational.drop_bad_quality(df, "trx", "p"), "trx") == [("t",), ("t",), ("v",)]
    x = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, None)], "i int, tsl double")
    assert rows(relational.support_filter(x, "tsl", 3), "i") == [(1,), (3,)]
    assert rows(relational.support_filter(x, "tsl", 3, True), "i") == [(1,)]


def test_alignment_consensus_and_columns(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(("AC-T", "AG-T", "A--C", "T--C"))], "g string, i int, aligned string")
    assert rows(alignment.consensus(df, "g")) == [("g", "AxxX")]
    assert rows(alignment.gap_columns(df, "g"), "column") == [(3,)]
    assert [r[2] for r in rows(alignment.drop_gap_columns(df, "g", "i"))] == ["ACT", "AGT", "A-C", "T-C"]


def test_padding_and_unaligned_regions():
    assert alignment.strip_padding("MHGL--XXXX-XXX--XXXKLMHSXXXXXXX-X-X-X") == "MHGL---------------KLMHS-------------"
    assert alignment.unaligned("------MHKCLVDE------YTEDQGGFRK------", "MLLHYHHHKC-------LMCYTRDLHG---IH-L-K") == ["MLLHYH", "IHLK"]
    assert alignment.unaligned("XXXXXXXXXXMHKCLVDE------YTEDQGGFRK", "----MLLHYHHHKC-----XXLMCYTRDLHG---") == ["MLLHYH", "XXLMC"]


def test_blocks():
    m = alignment.segment_matrix(["AAB-", "AABB", "--BB"], [[2, 4], [2, 4], [0, 2]])
    assert [(a, b) for a, b, _ in alignment.blocks(m)] == [(0, 1), (2, 3)]
    assert alignment.crossings(m) == 0


def test_weak_segments_go_until_nothing_changes():
    rows = ["MKLVWWWW", "MKLVHHHH", "MKLV----"]
    owner = np.array([[0] * 4 + [1] * 4, [2] * 4 + [3] * 4, [4] * 4 + [-1] * 4])
    assert alignment.weak_segments(rows, owner) == {1, 3}
    apart = ["MKLV----", "----MKLV"]
    lone = np.array([[0] * 4 + [-1] * 4, [-1] * 4 + [1] * 4])
    assert alignment.weak_segments(apart, lone) == set()
    assert alignment.weak_segments(["MK-V-R-T", "-A-----K"], np.array([[0] * 8, [1] * 8])) == {0, 1}


def test_chimeric_pads_what_is_not_connected(spark):
    x = spark.createDataFrame([("g", 0, "a", "MK"), ("g", 1, "b", "LV*"), ("g", 2, "c", "AA")], "gene string, i int, item string, seq string")
    links = spark.createDataFrame([("a", "b")], "before string, after string")
    r = alignment.chimeric(x, links, "gene", "i", "item", "seq", "XXX").first()
    assert r.chimeric == "MKLVXXXAA" and r.breaks == [2, 4, 9]


def test_local_alignment():
    table = similarity.scores()
    assert (table == table.T).all() and table[ord("W"), ord("W")] == 15
    assert similarity.align("MKLV", "MKLV", table) == ("MKLV", "MKLV")
    a, b = similarity.align("HEAGAWGHEE", "PAWHEAE", table)
    assert len(a) == len(b) and a.replace("-", "") == "HEAGAWGHEE" and b.replace("-", "") == "PAWHEAE"
    assert similarity.align("W", "A", table) == ("", "")


def test_greedy_clusters(spark):
    df = spark.createDataFrame([("f", 1, "MKLVMKLVMK"), ("f", 2, "MKLVMKLVMK"), ("f", 3, "MKLVMKLV"), ("f", 4, "WWWWWW"), ("f", 5, "MK")], "f string, id long, seq string")
    found = {r.id: r.cluster for r in similarity.cluster_families(df, "f", "id", "seq").collect()}
    assert set(found) == {2, 3, 4, 5} and found[2] == found[3] and found[4] not in (0, found[2]) and found[5] == 0


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s:g E1 x", "A" * 170), ("s:g E2 x", "CC")], "h string, s string")
    sinks.write_fasta(df, str(tmp_path / "f"), "h", "s")
    assert rows(tables.read_fasta(spark, str(tmp_path / "f")), "id", "seq") == [("E1", "A" * 170), ("E2", "CC")]


def test_newick():
    tree = "((a:1,b:2)x:1,(c:1,d:4):3);"
    assert [n[2] for n in tables.parse_newick(tree) if n[2]] == ["x", "a", "b", "c", "d"] or len(tables.parse_newick(tree)) == 7
    assert tables.prune_newick(tree, {"a": "A", "c": "C", "d": "D"}) == "(A:2,(C:1,D:4):3);"


def test_gml_and_pir(spark):
    nodes = spark.createDataFrame([(1, "start", None), (2, "1_0", "MK")], "id int, label string, consensus string")
    edges = spark.createDataFrame([(1, 2, 50.0)], "source int, target int, conservation double")
    text = "\n".join(r.value for r in sinks.gml(nodes, edges).orderBy("place", "value").collect())
    assert text.count("node [") == 2 and 'consensus "MK"' in text and text.endswith("]")
    x = spark.createDataFrame([("g", "t", 1, "a", "MK"), ("g", "t", 2, "b", "L*")], "g string, t string, i int, c string, s string")
    assert sinks.pir(x, "g", "t", "i", "c", "s").first().value == ">P1;g t ab\naab\nMKL*"


def test_coordinates_of_both_strands(spark):
    x = spark.createDataFrame([(1, i, n, st, 100, 135, 1) for st in (1,) for i, n in ((1, 4), (2, 4), (3, 4))] + [(2, i, 4, -1, 100, 135, 0) for i in (1, 2, 3)], "k int, r int, n int, strand int, s int, e int, ph int")
    got = rows(alignment.coordinates(x, ["k"], ["r"], F.col("n"), "strand", "s", "e", "ph"), "k", "r", "segment_start", "segment_end")
    assert got == [(1, 1, 100, 110), (1, 2, 111, 122), (1, 3, 123, 135), (2, 1, 135, 124), (2, 2, 123, 112), (2, 3, 111, 100)]


def test_user_rows(spark):
    x = spark.createDataFrame([("homo_sapiens", 1, 4, 1, 4, "ACGT"), ("Homo", 5, 4, 1, 1, "A")], "Species string, ExonRegionStart long, ExonRegionEnd long, GenomicCodingStart long, GenomicCodingEnd long, NucleotideSequence string")
    assert [r.faults for r in relational.user_row_faults(x).collect()] == [["exon region order", "sequence length", "species name"]]


def test_entry_imports_and_answers(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["disjoint_intervals"](spark, small).count() > 0


def test_alphabet_of_segment_codes():
    from splicelake.sources import sinks

    assert sinks.ALPHABET[:3] == "%()" and list(sinks.ALPHABET) == sorted(set(sinks.ALPHABET))
    assert not set(sinks.ALPHABET) & set(" \\*>\"',-_/;#$.&!@[]") and sinks.ALPHABET[-1] == "\u41c2"


def test_fasta_lines_keep_their_digits(spark, tmp_path):
    from splicelake.sources import tables

    (tmp_path / "x.fasta").write_text(">a 0b1\n0AC0\n1GT1\n")
    assert [tuple(r)[:3] for r in tables.read_fasta(spark, str(tmp_path)).collect()] == [("a 0b1", "0b1", "0AC01GT1")]


def test_holders_of_sub_paths(spark):
    from splicelake.operators import paths

    p = spark.createDataFrame([(1, "g", "t1", "start/a/b/c/stop"), (1, "g", "t2", "start/a/c/stop"), (2, "h", "t3", "start/a/b/c/stop")], "family int, gene string, trx string, path string")
    sub = spark.createDataFrame([(1, "a/b/c"), (1, "start/a"), (1, "b/a"), (1, "c/stop"), (2, "a/c")], "family int, sub string")
    got = {(r.family, r["sub"], r.trx) for r in paths.holders(p, sub, "sub").collect()}
    assert got == {(1, "a/b/c", "t1"), (1, "start/a", "t1"), (1, "start/a", "t2"), (1, "c/stop", "t1"), (1, "c/stop", "t2")}
