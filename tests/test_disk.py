"""What queries leave on disks while they run: shuffle files and rows that are dealt out."""

from pyspark.sql import functions as F

from splicelake.operators import exons, paths, trees
from splicelake.plans import queries
from splicelake.storage import materialize

SEGMENTS = [(f, 10 * f + t % 3, 100 * f + t, n, k) for f in (1, 2) for t in range(12) for k, n in enumerate("abcdefg"[t % 3 : 3 + t % 5])]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (blocks.apply(i).toString() for i in range(blocks.size())) if b.startswith("shuffle_")}


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "family long, gene long, trx long, node string, rk long")


def test_shuffle_files_go_with_the_write(spark):
    before = shuffled(spark)
    materialize(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not shuffled(spark) - before


def test_events_deal_out_paths_not_their_nodes(spark):
    p = materialize(paths.path_strings(segments(spark)), "paths")
    found = paths.events(p, p.where("trx in (103, 203)").select("family", "path"))
    assert "Window" not in plan(found) and found.count()


def test_support_deals_out_whole_sub_paths_only(spark):
    p = materialize(paths.path_strings(segments(spark)), "paths")
    sub = materialize(paths.events(p, p.where("trx in (103, 203)").select("family", "path")), "found")
    found = paths.support(p, sub, "alternative_path")
    assert "BroadcastHashJoin" in plan(found) and "Expand" not in plan(found)
    holds = {}
    for r in p.collect():
        for a in sub.where(F.col("family") == r["family"]).collect():
            if f"/{a['alternative_path']}/" in f"/{r['path']}/":
                holds.setdefault((r["family"], a["alternative_path"]), set()).add((r["gene"], r["trx"]))
    assert {(r[0], r[1]): (r[2], r[3]) for r in found.collect()} == {k: (len({g for g, _ in v}), len(v)) for k, v in holds.items()}


def test_a_transcript_of_two_genes_counts_once(spark):
    p = materialize(paths.path_strings(segments(spark)), "paths")
    twice = materialize(p.union(p.where("trx = 101").withColumn("gene", F.lit(99))), "twice")
    sub = p.where("trx = 101").select("family", F.col("path").alias("sub")).distinct()
    one, two = (paths.support(x, sub, "sub").first() for x in (p, twice))
    assert (two["n_genes"], two["n_trx"]) == (one["n_genes"] + 1, one["n_trx"])


def test_shares_of_sub_paths_join_nothing_again(spark):
    p = materialize(paths.path_strings(segments(spark)), "paths")
    sub = materialize(p.where("trx in (101, 205)").select("family", F.col("path").alias("sub")).distinct(), "sub")
    found = paths.subpath_genes(p, sub, "sub")
    assert plan(found).count("SortMergeJoin [family") <= 2
    for r in found.collect():
        rows = p.where(F.col("family") == r["family"]).collect()
        holds = [x for x in rows if f"/{r['sub']}/" in f"/{x['path']}/"]
        assert r["genes"] == sorted({x["gene"] for x in holds}) and r["n_trx"] == len(holds)
        genes = {x["gene"] for x in rows}
        assert abs(r["weighted_conservation"] - sum(sum(x["gene"] == g for x in holds) / sum(x["gene"] == g for x in rows) for g in genes) / len(genes)) < 1e-9


def test_exons_that_equal_no_other_are_not_dealt_out_with_their_ids(spark, monkeypatch):
    held = {}

    def kept(df, name):
        held[name] = materialize(df, name)
        return held[name]

    monkeypatch.setattr(exons, "materialize", kept)
    rows = [(1, f"e{k:02}", 0, 0, 100 * (k // 2 if k < 4 else k), 100 * k + 9 if k >= 4 else 9, "MKV") for k in range(30)]
    df = spark.createDataFrame(rows, "GeneID long, ExonID string, StartPhase long, EndPhase long, GenomicCodingStart long, GenomicCodingEnd long, protein string")
    found = {(r["ExonID"], r["ExonIDCluster"]): r["n"] for r in exons.merge_identical(df, "ExonID").groupBy("ExonID", "ExonIDCluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert held["identical"].count() == 4
    assert found == {("e00", "e00/e01"): 2, ("e02", "e02/e03"): 2} | {(f"e{k:02}", f"e{k:02}"): 1 for k in range(4, 30)}


def test_labels_of_groups_come_after_rows_are_dealt_out(spark, tmp_path):
    parts = [(k, f"b{k % 3}", f"n{k % 4}" if k < 30 else f"own{k}") for k in range(40)]
    lines = [(o, k, (7 * o + k) % 45) for o in range(50) for k in range(3)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = queries.queries()["store_cluster"](spark, str(tmp_path))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(found) and "BroadcastHashJoin" in plan(found)
    members = {}
    for k, b, n in parts:
        members.setdefault((b, n), []).append(str(k))
    label = {int(k): "/".join(sorted(m)) for m in members.values() if len(m) > 1 for k in m}
    assert sorted(tuple(r) for r in found.collect()) == [(o, k, p, label.get(p, str(p))) for o, k, p in sorted(lines)]


def test_nodes_of_trees_are_dealt_out_once(spark):
    rows = [(t, "((a:1,b:2)x:3,(c:4,d:5)y:6)r;") for t in range(20)]
    nodes = materialize(trees.read_newick(spark.createDataFrame(rows, "t long, newick string"), "t", "newick"), "nodes")
    keep = spark.createDataFrame([(t, n, f"{n}{t}") for t in range(20) for n in "abc"[: t % 4]], "t long, name string, label string")
    found = trees.newick(trees.prune(nodes, "t", keep), "t")
    assert plan(found).count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan(found)
    want = {1: "a{0};", 2: "(a{0}:1,b{0}:2)x;", 3: "((a{0}:1,b{0}:2)x:3,c{0}:10)r;"}
    assert {r["t"]: r["newick"] for r in found.collect()} == {t: want[t % 4].format(t) for t in range(20) if t % 4}


def test_letters_of_sub_paths_are_counted_under_numbers(spark, monkeypatch):
    written = {}

    def kept(df, name):
        written[name] = df.columns
        return materialize(df, name)

    monkeypatch.setattr(paths, "materialize", kept)
    held = materialize(spark.createDataFrame([(1, "start/a/b/stop", [1, 2]), (1, "start/stop", [1])], "family long, sub string, genes array<long>"), "held")
    rows = spark.createDataFrame([(1, 1, "a", "MK-"), (1, 2, "a", "MR-"), (1, 1, "b", "VV")], "family long, gene long, node string, aligned string")
    found = {r["sub"]: tuple(r)[2:] for r in paths.subpath_residues(held, rows).collect()}
    assert "sub" not in written["subpath_rows"]
    assert found == {"start/a/b/stop": (2, 3.0, 4, "MXVV"), "start/stop": (0, 0.0, 0, "")}
