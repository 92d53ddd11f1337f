"""Trees as tables against recursion over their nodes."""

import random

from splicelake.operators import trees
from splicelake.sources.tables import prune_newick


def random_tree(rng, names, depth=0):
    if depth > 5 or rng.random() < 0.3:
        names.append(f"n{len(names)}")
        return f"{names[-1]}:{rng.randint(1, 9)}" if rng.random() < 0.9 else names[-1]
    inner = ",".join(random_tree(rng, names, depth + 1) for _ in range(rng.randint(1, 3)))
    return f"({inner})" + (f":{rng.randint(1, 9)}" if depth and rng.random() < 0.9 else "")


def test_prune_many_trees(spark):
    rng, rows, keep, want = random.Random(3), [], [], {}
    for t in range(120):
        names = []
        text = random_tree(rng, names) + ";"
        own = {n: f"g{t}{n}" for n in names if rng.random() < 0.5}
        rows.append((t, text))
        keep += [(t, n, g) for n, g in own.items()]
        if own:
            want[t] = prune_newick(text, own)
    rows.append((999, None))
    nodes = trees.read_newick(spark.createDataFrame(rows, "t long, text string"), "t", "text")
    got = trees.newick(trees.prune(nodes, "t", spark.createDataFrame(keep, "t long, name string, label string")), "t")
    assert {r.t: r.newick for r in got.collect()} == want


def test_whole_trees_come_back(spark):
    texts = ["(a:1,(b:2,c:3)in:4.5)root;", "a;", "((a,b),(c,(d,e)));"]
    nodes = trees.read_newick(spark.createDataFrame(list(enumerate(texts)), "t long, text string"), "t", "text")
    assert [r.newick for r in trees.newick(nodes, "t").orderBy("t").collect()] == texts
    kept = trees.prune(nodes, "t", spark.createDataFrame([("b", "B"), ("e", "E")], "name string, label string"))
    assert {r.t: r.newick for r in trees.newick(kept, "t").collect()} == {0: "B;", 2: "(B,E);"}
    assert trees.newick(nodes.limit(0), "t").count() == 0
