"""SimHash near-duplicates: fingerprints linked through vantage-point trees.

A tree node holds a vantage fingerprint and a radius: what lies within the
radius goes left, the rest right.  A query of radius r needs the left branch
only if its distance is at most radius + r, and the right one only if it is
over radius - r: the triangle inequality.  The leaves of a tree are the shards.

On 64 bits random fingerprints all lie about 32 bits from any vantage point,
and r = 4 leaves both branches open most of the time.  So the 64 bits are cut
into bands; Hamming distance on a band's bits obeys the triangle inequality as
well, and two fingerprints within r bits are within r // bands bits on one band
at least.  Each band has a tree of its own, searched with that smaller radius,
and shards verify pairs on all 64 bits: no pair within r is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ._runtime import materialize, pieces_of

SHINGLE, SEED, RADIUS = 4, 42, 4
BANDS = 3
#: Fingerprints that a shard aims at; leaves that a tree may have, which bounds its broadcast.
SHARD_ROWS, MOST_LEAVES = 1500, 1 << 15
#: Fingerprints of one shard from which it is compared in pairs of blocks.
CROWDED_SHARD = 20_000
#: Fingerprints that may be joined by broadcast, as they have over 1 / MOST_HOT of the rows each.
MOST_HOT = 2000
#: Fingerprints that vantage points and radii are chosen from.
SAMPLE = 40_000

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the shingles' hashes."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n <= 1:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter([digest(b" ".join(g), SEED) for g in zip(*(words[i:] for i in range(size)))], np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        set_bits += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint of every whole text, its 64 bits as a signed long."""
    columns = [*keep, *(["text"] if "text" not in keep else [])]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces_of(batch, "text"):
                texts = some.column(columns.index("text")).to_pylist()
                fp = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(fp)], names=[*keep, name])

    return docs.select(*columns).mapInArrow(run, schema)


class Tree:
    """A vantage-point tree over one band's bits; node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int = 7):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.radius = np.full((1 << depth) - 1, -1, np.int16)
        rng = np.random.default_rng(seed)
        groups = {0: sample & self.mask}
        for node in range((1 << depth) - 1):
            g = groups.pop(node, sample[:0])
            if len(g) < 2:  # no point to split: everything goes right
                groups[2 * node + 2] = g
                continue
            tries = rng.choice(g, min(8, len(g)), replace=False)
            d = np.bitwise_count(tries[:, None] ^ g[None, :]).astype(np.int16)
            spread = [(abs(int((row <= (m := int(np.median(row)))).sum()) * 2 - len(g)), i, m) for i, row in enumerate(d)]
            spread += [(abs(int((row <= m).sum()) * 2 - len(g)), i, m) for i, row in enumerate(d) if (m := int(np.median(row)) - 1) >= 0]
            _, i, m = min(spread)
            self.vantage[node], self.radius[node] = tries[i], m
            groups[2 * node + 1], groups[2 * node + 2] = g[d[i] <= m], g[d[i] > m]

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The leaf that each fingerprint belongs to."""
        node = np.zeros(len(fps), np.int64)
        x = fps & self.mask
        for _ in range(self.depth):
            near = np.bitwise_count(x ^ self.vantage[node]).astype(np.int16) <= self.radius[node]
            node = 2 * node + np.where(near, 1, 2)
        return node - ((1 << self.depth) - 1)

    def visits(self, fps: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold something within r bits on the band."""
        row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        x = fps & self.mask
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.vantage[node]).astype(np.int16)
            left, right = d <= self.radius[node] + r, d > self.radius[node] - r
            row = np.concatenate((row[left], row[right]))
            node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return row, node - ((1 << self.depth) - 1)


def band_masks(bands: int) -> list[int]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _forest(own: np.ndarray, guests: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that connect what lies within r bits: own with own and with guests.

    Groups of many mutual neighbours give a spanning forest, not all pairs: a
    row's neighbours are hooked to the smallest root among them at once.
    """
    every = np.concatenate((own, guests))
    root = np.arange(len(every))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def find(i: np.ndarray) -> np.ndarray:
        while True:
            up = root[i]
            if (up == i).all():
                return i
            root[i] = root[up]
            i = up

    step = max(1, (1 << 22) // max(1, len(every)))
    for at in range(0, len(own), step):
        close = np.bitwise_count(own[at : at + step, None] ^ every[None, :]) <= r
        counts = close.sum(axis=1)
        for k in np.flatnonzero(counts > 1):
            near = np.flatnonzero(close[k])
            roots = np.unique(find(near))
            if len(roots) > 1:
                root[roots[1:]] = roots[0]
                edges.append((every[np.full(len(roots) - 1, roots[0])], every[roots[1:]]))
    if not edges:
        return own[:0], own[:0]
    return np.concatenate([a for a, _ in edges]), np.concatenate([b for _, b in edges])


def links(fps: DataFrame, r: int = RADIUS, bands: int = BANDS, shard_rows: int = SHARD_ROWS, crowded: int = CROWDED_SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp long, each once).

    They connect exactly those that chains of distances up to r bits connect.
    Fingerprints travel in packed arrays: a row for each (batch, tree, leaf).
    What agrees on all bits of a band cannot be split by that band's tree: a
    shard of over ``crowded`` fingerprints is dealt into blocks, each two of
    which meet in a task of their own, and its guests meet each block.
    """
    spark = fps.sparkSession
    n = fps.count()
    depth = min(MOST_LEAVES.bit_length() - 1, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    share = min(1.0, SAMPLE / max(1, n))
    sample = fps.where(F.shiftrightunsigned(F.xxhash64("fp"), 2) < F.lit(int(share * (1 << 62)))).select("fp").toPandas()
    sample = np.sort(sample["fp"].to_numpy(np.int64)).view(np.uint64)
    trees = [Tree(sample, mask, depth, seed) for seed, mask in enumerate(band_masks(bands))]
    shared = spark.sparkContext.broadcast(trees)  # MOST_LEAVES bounds it
    inner = r // bands

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << depth, np.int64) for _ in shared.value]
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for n, tree in zip(total, shared.value):
                n += np.bincount(tree.home(x), minlength=1 << depth)
        for t, n in enumerate(total):
            yield pa.RecordBatch.from_pydict({"shard": t << 32 | np.flatnonzero(n), "n": n[n > 0]})

    full = fps.select("fp").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > crowded)
    blocks = {r["shard"]: -(-r["n"] // max(1, crowded // 2)) for r in full.collect()}  # leaves of all trees at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch | None:
            x = np.concatenate(held).view(np.uint64)
            rows: list = []
            for t, tree in enumerate(shared.value):
                home = tree.home(x)
                row, leaf = tree.visits(x, inner)
                later = leaf > home[row]  # of two shards that each other's fingerprints visit, the later one compares
                for guest, leaves, values in ((False, home, x), (True, leaf[later], x[row[later]])):
                    order = np.argsort(leaves, kind="stable")
                    some, cuts = np.unique(leaves[order], return_index=True)
                    for k, part in zip(some, np.split(values[order], cuts[1:])):
                        shard = t << 32 | int(k)
                        n = blocks.get(shard, 1)
                        own = (part * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(n)
                        for i in range(n):
                            if guest:
                                rows.append((shard, i * n + i, True, part.tobytes()))
                            elif len(mine := part[own == i]):
                                rows += [(shard, min(i, j) * n + max(i, j), j < i, mine.tobytes()) for j in range(n)]
            shard, block, guest, data = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(block, pa.int64()), pa.array(guest, pa.bool_()), pa.array(data, pa.binary())], names=["shard", "block", "guest", "data"])

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= 1 << 16:
                yield out()
                held = []
        if sum(map(len, held)):
            yield out()

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own, guests = (np.frombuffer(b"".join(pdf.data[pdf.guest == g]), np.uint64) for g in (False, True))
        a, b = _forest(own, guests, r)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "shard long, block long, guest boolean, data binary").groupBy("shard", "block").applyInPandas(compare, "a long, b long")


def classes_of(printed: DataFrame, r: int = RADIUS, bands: int = BANDS) -> DataFrame:
    """fp, least (its smallest doc_id), n (its rows) and component_id of each distinct fp of (doc_id, fp)."""
    classes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = materialize(components(links(classes, r, bands)).withColumnRenamed("component", "root"), "roots")
    named = materialize(roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "components")
    # a component of many fingerprints never meets in one task
    hot = named.where(F.col("members") * MOST_HOT > classes.count()).select("root", "component_id")
    rest = roots.join(F.broadcast(hot), "root", "left_anti").join(named.select("root", "component_id"), "root")
    linked = roots.join(F.broadcast(hot), "root").unionByName(rest).select(F.col("node").alias("fp"), "component_id")
    return classes.join(linked, "fp", "left").select("fp", "least", "n", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicates(docs: DataFrame, r: int = RADIUS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp long, component_id long (smallest doc_id that links reach) of every row.

    Documents with equal fingerprints meet in an aggregate, so that copies cost
    a row each and never a pair.  A null text, or one without a word, has
    fingerprint zero.  A null doc_id never names a component unless its
    component has no other id.  Repeated rows share a component.  An empty
    table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = materialize(fingerprints(plain, size), "fingerprints")
    classes = materialize(classes_of(printed, r, bands), "named")
    # a fingerprint of many rows never meets in one task: at most MOST_HOT have that share of all rows
    hot = classes.where(F.col("n") * MOST_HOT > printed.count())
    rest = printed.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(classes.select("fp", "component_id"), "fp")
    return printed.join(F.broadcast(hot.select("fp", "component_id")), "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, r: int = RADIUS, bands: int = BANDS, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: those of smallest doc_id.

    Of several rows with that doc_id and fingerprint the one with the least text
    stays.  A row without doc_id stays, as nothing can name it.
    """
    printed = materialize(fingerprints(docs, size, tuple(docs.columns), "__fp"), "printed")
    classes = classes_of(printed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__fp").alias("fp")), r, bands)
    chosen = classes.where("least = component_id").select(F.col("least").alias("__id"), F.col("fp").alias("__own"))
    first = chosen.groupBy("__id").agg(F.min("__own").alias("__own"))
    named = printed.where("doc_id is not null").join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__own")), "left_semi")
    order = Window.partitionBy("doc_id", "__fp").orderBy("text")
    once = named.withColumn("__row", F.row_number().over(order)).where("__row = 1").select(*docs.columns)
    return once.unionByName(printed.where("doc_id is null").select(*docs.columns))
