"""Queries over all rows of their tables against brute force."""

import math

import pytest

from splicelake.plans import queries

ORDERS = [
    # custkey, status, price, priority
    (1, "F", 10.5, "1-URGENT"), (1, "O", 20.5, "2-HIGH"), (2, "O", 20.1, "5-LOW"), (2, "P", 30.0, "1-URGENT"), (3, "P", 30.9, "3-MEDIUM"),
    (4, "O", 40.0, "5-LOW"), (5, "F", 40.2, "1-URGENT"), (6, "O", 0.5, "2-HIGH"), (7, "P", 20031.0, "2-HIGH"), (8, None, 50.0, None), (8, "O", 60.0, "1-URGENT"),
]
PARTS = [(1, "x", 4, "t1"), (2, "y", 3, "t2"), (3, "x", 6, "t3"), (4, "z", 1, "t4"), (5, "y", 9, "t5"), (6, "x", None, "t6")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(ORDERS, "o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(PARTS, "p_partkey long, p_brand string, p_size int, p_type string").write.parquet(f"{d}/part.parquet")
    return d


def brute(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def run(spark, folder, name):
    return sorted((tuple(r) for r in queries.queries()[name](spark, folder).collect()), key=str)


def test_components_of_all_orders(spark, folder):
    want = brute([(c, 1000000 + math.floor(p)) for c, _, p, _ in ORDERS])
    assert run(spark, folder, "connected_components") == sorted(want.items(), key=str)


def test_clusters_of_all_orders(spark, folder):
    used = {(c, math.floor(p) % 20011) for c, _, p, _ in ORDERS}
    label = brute([(("i", c), ("c", cl)) for c, cl in used if cl])
    name = {}
    for c, cl in used:
        if cl:
            name[label["c", cl]] = min(cl, name.get(label["c", cl], cl))
    assert run(spark, folder, "merge_clusters") == sorted(((c, name[label["c", cl]] if cl else 0) for c, cl in used), key=str)


def test_every_part_has_an_id(spark, folder):
    assert run(spark, folder, "impute_missing_ids") == [(1, "t1"), (2, "0_1"), (3, "0_2"), (4, "t4"), (5, "0_1"), (6, "t6")]


def test_every_order_is_a_row(spark, folder):
    want = [(c, "protein_coding", "user") if s == "P" else (c, p, None) for c, s, _, p in ORDERS]
    assert run(spark, folder, "union_user_rows") == sorted(want, key=str)
