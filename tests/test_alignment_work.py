"""Work on alignments: spread over tasks, in bounded memory, in few passes."""

import numpy as np
import pytest

from splicelake.operators import alignment, pairwise, similarity
from splicelake.storage import dealt

TABLE = similarity.scores()
rng = np.random.default_rng(11)


def words(n, longest):
    return ["".join(rng.choice(list("ARNDCQEGHX"), rng.integers(1, longest))).encode() for _ in range(n)]


@pytest.mark.parametrize("gaps", [(-10.0, -1.0), (-2.5, -0.5), (-1.0, -3.0)])
def test_rows_computed_again_give_the_same_ways(gaps):
    one, two = words(40, 60), words(40, 60)
    whole, again = (pairwise.align_batch(one, two, TABLE, *gaps, kept=kept) for kept in (1 << 27, 1 << 15))
    for a, b in zip((*whole[:4], *whole[5:]), (*again[:4], *again[5:])):
        assert a.tolist() == b.tolist()
    walked = lambda steps, k: steps[:, k][steps[:, k] > 0].tolist()
    assert all(walked(whole.steps, k) == walked(again.steps, k) for k in range(40))


def test_long_pairs_share_a_batch():
    lengths = np.full(8, 1500)
    assert len(list(pairwise.batches(lengths, lengths))) == 1


def test_small_groups_keep_many_tasks(spark):
    """Adaptive execution puts so few bytes into one task."""
    df = spark.createDataFrame([(g, r) for g in range(200) for r in range(3)], "g long, r long")
    one = dealt(df, "g").groupBy("g").applyInPandas(lambda pdf: pdf, df.schema)
    assert one.rdd.getNumPartitions() > 4


def test_crossings_count_rows_over_borders():
    for _ in range(50):
        matrix = np.sort(rng.integers(0, 6, (4, 30)), axis=1)
        matrix[rng.random(matrix.shape) < 0.4] = -1
        want = 0
        for _, last, _ in alignment.blocks(matrix)[:-1]:
            for row in matrix:
                a, b = row[: last + 1][row[: last + 1] >= 0], row[last + 1 :][row[last + 1 :] >= 0]
                want += bool(len(a) and len(b) and a[-1] == b[0])
        assert alignment.crossings(matrix) == want
