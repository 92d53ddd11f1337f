"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates a unit vector by three rounds of random signs and a fast
Hadamard transform and names the signed axis nearest to it.  Each table
concatenates ``hashes`` of them.  A query probes, in each table, the cells
whose axes lie nearest to it, and every vector in a probed cell is reranked by
its exact inner product.

Vectors are unit length for hashing.  If their lengths differ, candidates are
dealt into bands whose lengths differ by a factor of two at most, and in each
band the largest inner product is made an angle first: candidates get a
coordinate more that fills them up to the band's largest length, queries a
zero.  Queries probe all large bands and are compared with every vector of the
bands of at most one block.  A query for which fewer than k are found although
there are more is compared with every vector.

How many tables, hashes and probes the data need is measured: a bounded number
of pilot queries is compared with every row, and of the settings that would
have found the wanted share of their neighbours the cheapest is used.

Of rows with one and the same vector only the k + 1 smallest ids can be among
anyone's k nearest; the others are left out as candidates before vectors move.
Cells are split into blocks of a bounded number of vectors and of queries, and
each pair of blocks meets in a task of its own; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialize

NEAREST, QUERY_EVERY = 20, 20
#: Queries that settings are chosen by, and the share of neighbours to find.
PILOT, RECALL = 128, 0.95
#: Settings (hashes, tables) that are weighed; each with as few probes as reach RECALL.
SETTINGS = ((1, 8), (1, 16), (1, 32), (2, 16), (2, 32), (2, 64))
#: Vectors of a block, and queries whose lists one task merges at once.
BLOCK_ROWS, MERGE_QUERIES = 4096, 500
SEED = 11


class CrossPolytope:
    def __init__(self, dim: int, tables: int, hashes: int, seed: int = SEED):
        self.dim, self.tables, self.hashes = dim, tables, hashes
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size)).astype(np.float32)

    def _rotate(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        for signs in self.signs[table, k]:
            x = x * signs
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), self.size)
                h *= 2
            x *= np.float32(1 / np.sqrt(self.size))
        return x

    def _padded(self, unit: np.ndarray) -> np.ndarray:
        return np.pad(unit.astype(np.float32), ((0, 0), (0, self.size - unit.shape[1])))

    @property
    def all_cells(self) -> int:
        return (2 * self.size) ** self.hashes

    def ranks(self, queries: np.ndarray, near: np.ndarray, table: int) -> np.ndarray:
        """How many cells each query would probe before the cell of the vector near it."""
        gains, mine = [], np.zeros(len(queries), np.float32)
        q, v = self._padded(queries), self._padded(near)
        for k in range(self.hashes):
            r, s = self._rotate(q, table, k), self._rotate(v, table, k)
            axis = np.abs(s).argmax(axis=1)[:, None]
            mine += (np.take_along_axis(r, axis, 1) * np.where(np.take_along_axis(s, axis, 1) >= 0, 1, -1))[:, 0]
            gains.append(np.concatenate((r, -r), axis=1))
        mine += np.float32(1e-6)
        while len(gains) > 2:
            gains[:2] = [(gains[0][:, :, None] + gains[1][:, None, :]).reshape(len(q), -1)]
        if len(gains) == 1:
            return (gains[0] > mine[:, None]).sum(axis=1)
        ordered = np.sort(gains[1], axis=1)
        return np.array([(len(b) - np.searchsorted(b, m - a, "right")).sum() for a, b, m in zip(gains[0], ordered, mine)])

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The cell of each vector."""
        x, cell = self._padded(unit), np.zeros(len(unit), np.int64)
        for k in range(self.hashes):
            r = self._rotate(x, table, k)
            axis = np.abs(r).argmax(axis=1)
            cell = cell * 2 * self.size + np.where(r[np.arange(len(r)), axis] >= 0, axis, axis + self.size)
        return cell

    def probes(self, unit: np.ndarray, table: int, number: int) -> np.ndarray:
        """The ``number`` cells nearest to each vector (vector, probe), its own first."""
        x, found = self._padded(unit), []
        for k in range(self.hashes):
            r = self._rotate(x, table, k)
            both = np.concatenate((r, -r), axis=1)
            axes = np.argsort(-both, axis=1, kind="stable")[:, :number]
            found.append((axes, np.take_along_axis(both, axes, axis=1)))
        if self.hashes == 1:
            return found[0][0]
        combos = np.array(list(product(range(found[0][0].shape[1]), repeat=self.hashes)))
        gain = sum(found[k][1][:, combos[:, k]] for k in range(self.hashes))
        best = combos[np.argsort(-gain, axis=1, kind="stable")[:, :number]]
        cell = np.zeros(best.shape[:2], np.int64)
        for k in range(self.hashes):
            cell = cell * 2 * self.size + np.take_along_axis(found[k][0], best[:, :, k], axis=1)
        return cell


def _best(queries: np.ndarray, qid: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple]:
    """Of each query, the k best rows but itself: (query, ids, scores), ties to smaller ids."""
    out = []
    rough = queries @ rows.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    last = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] if len(ids) else None
    for i in range(len(qid)):
        near = np.flatnonzero((rough[i] >= last[i] - 1e-9) & (rough[i] > -np.inf)) if len(ids) else []
        if len(near):
            score = (rows[near] * queries[i]).sum(axis=1)  # the same sum for the same vector, wherever it lies
            order = np.lexsort((ids[near], -score))[:k]
            out.append((int(qid[i]), ids[near][order], score[order]))
    return out


def cost(rows: int, queries: int, dim: int, k: int, tables: int, probes: int, cells: int) -> float:
    """Bytes moved, and pairs reranked at about what moving a byte takes."""
    asked = queries * tables * probes
    return 4.0 * dim * (rows * tables + asked) + 16.0 * k * asked + (1 + dim / 100) * asked * rows / cells


def search(vectors: DataFrame, k: int = NEAREST, every: int = QUERY_EVERY, tables: int | None = None, hashes: int | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query.

    Queries are the rows whose vec_id is divisible by ``every``.  A vector that
    is null, zero, holds a null or a non-finite component, has a null vec_id or
    another number of components than most takes no part.  Of rows that repeat a
    vec_id the one with the least vector counts.  Ties go to the smaller vec_id.  An empty table
    gives no rows.  ``tables``, ``hashes`` and ``probes``, if all are given,
    are used in place of those that the pilot queries ask for.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)  # what the table holds: nothing is lost
    stored = "array<float>" if single else "array<double>"
    wanted = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(stored).alias("embedding"))
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    wanted = wanted.where(usable)
    norm2 = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    sizes = wanted.groupBy(F.size(x).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("high")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, longest = sizes["dim"], float(np.sqrt(sizes["high"]))
    wanted = materialize(wanted.where(F.size(x) == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    queries = wanted.where(F.col("vec_id") % every == 0)
    asked = queries.count()
    if not asked:
        return spark.createDataFrame([], schema)
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    wanted = materialize(wanted.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k + 1).drop("__copy"), "candidates")

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)

    def banded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Band, ids, rows and lengths of the rows of a batch, band by band."""
        ids, rows = read(batch)
        length = np.linalg.norm(rows, axis=1)
        band = np.maximum(np.floor(np.log2(longest) - np.log2(length)), 0).astype(np.int64)
        for b in np.unique(band).tolist():
            yield b, ids[band == b], rows[band == b], length[band == b]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids, _, length in banded(batch):
                yield pa.RecordBatch.from_pydict({"band": [b], "n": [len(ids)], "low": [length.min()], "high": [length.max()]})

    # as many bands at most as there are powers of two among doubles
    bands = wanted.mapInArrow(measure, "band long, n long, low double, high double").groupBy("band").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    large = {r["band"]: r["high"] for r in bands if r["n"] > block_rows or len(bands) == 1}
    lift = len(large) > 1 or any(r["high"] > r["low"] * 1.00005 for r in bands if r["band"] in large)
    def unit(rows: np.ndarray, longest: float | None) -> np.ndarray:
        """Rows as hashed: candidates of a band with its largest length, queries with none."""
        rows = rows / (np.abs(rows).max(axis=1, keepdims=True) if longest is None or not lift else longest)
        if longest is None or not lift:
            rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            return np.pad(rows, ((0, 0), (0, int(lift))))
        return np.concatenate((rows, np.sqrt(np.maximum(0, 1 - (rows * rows).sum(axis=1, keepdims=True)))), axis=1)

    total = sum(r["n"] for r in bands)

    def compare(pilot_ids: np.ndarray, pilot: np.ndarray):
        """The k best rows of each pilot query within a partition, with their vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                ids, rows = read(batch)
                for q, near, score in _best(pilot, pilot_ids, rows, ids, k):
                    old = best.get(q, (near[:0], score[:0], rows[:0]))
                    mine = rows[[int(np.flatnonzero(ids == i)[0]) for i in near]]
                    near, score, mine = np.concatenate((old[0], near)), np.concatenate((old[1], score)), np.concatenate((old[2], mine))
                    order = np.lexsort((near, -score))[:k]
                    best[q] = near[order], score[order], mine[order]
            for q, (near, score, mine) in best.items():
                yield pa.RecordBatch.from_pydict({"query_id": np.full(len(near), q), "vec_id": near, "score": score, "embedding": pa.array(list(mine), pa.list_(pa.float64()))})

        return run

    def choose() -> tuple[int, int, int]:
        """Hashes, tables and probes: the cheapest setting that finds enough neighbours of the pilot queries."""
        some = queries.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(PILOT).collect()
        ids, asking = np.array([r[0] for r in some]), np.array([r[1] for r in some], np.float64)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        near = wanted.mapInArrow(compare(ids, asking), "query_id long, vec_id long, score double, embedding array<double>").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = near.select("query_id", "embedding").collect()  # PILOT * k vectors at most
        if not near:
            return (*SETTINGS[0], 1)
        rows = np.array([r[1] for r in near])
        place = {q: i for i, q in enumerate(ids.tolist())}
        who = asking[[place[r[0]] for r in near]]
        band = np.maximum(np.floor(np.log2(longest) - np.log2(np.linalg.norm(rows, axis=1))), 0).astype(np.int64)
        hashed = np.isin(band, list(large))  # the others are compared with all queries
        rows, who, band, missing = rows[hashed], who[hashed], band[hashed], 1 - recall
        if not len(rows):
            return (*SETTINGS[0], 1)
        u = np.concatenate([unit(rows[i : i + 1], large[b]) for i, b in enumerate(band.tolist())])
        v, allowed, best = unit(who, None), int(missing * len(hashed)), (np.inf,)  # allowed: neighbours that may be missed
        for h, t in SETTINGS:
            model = CrossPolytope(dim + lift, t, h, seed)
            if cost(total, asked, dim, k, t, 1, model.all_cells) < best[0]:
                least = np.min([model.ranks(v, u, i) for i in range(t)], axis=0)
                p = int(np.sort(least)[max(0, len(least) - allowed - 1)]) + 1
                best = min(best, (cost(total, asked, dim, k, t, p, model.all_cells), h, t, p))
        return best[1:]

    if tables is None or hashes is None or probes is None:
        hashes, tables, probes = choose()
    model = CrossPolytope(dim + lift, tables, hashes, seed)

    def count(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for batch in batches:
                if query:
                    ids, rows = read(batch)
                    v = unit(rows, None)
                    held += [(b * tables + t, cells) for t in range(tables) for cells in [model.probes(v, t, probes).ravel()] for b in large]
                else:
                    held += [(b * tables + t, model.cells(unit(rows, large[b]), t)) for b, _, rows, _ in banded(batch) if b in large for t in range(tables)]
            for table in sorted({t for t, _ in held}):
                cell, n = np.unique(np.concatenate([c for t, c in held if t == table]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"table": pa.array(np.full(len(cell), table, np.int32)), "cell": pa.array(cell), "n": pa.array(n.astype(np.int64))})

        return run

    def crowded(df: DataFrame, query: bool) -> dict[tuple[int, int], int]:
        """Blocks of the cells that need more than one: tables * cells of a table * bands at most."""
        found = df.mapInArrow(count(query), "table int, cell long, n long").groupBy("table", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > block_rows)
        return {(r["table"], r["cell"]): -(-r["n"] // block_rows) for r in found.collect()}

    split, chunks_of = crowded(wanted, False), crowded(queries, True)

    kinds = {"table": pa.int32(), "cell": pa.int64(), "block": pa.int64(), "query": pa.bool_(), "ids": pa.binary(), "rows": pa.binary()}

    def packed(groups: list[tuple], ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        """One row for each table, cell and block of groups (table, query, row, cell, block)."""
        out: list[tuple] = []
        for t, query, row, c, b in groups:
            order = np.lexsort((b, c))
            row, c, b = row[order], c[order], b[order]
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(b) != 0)) + 1
            for part, at in zip(np.split(row, cuts), [0, *cuts]):
                if len(part):
                    out.append((t, int(c[at]), int(b[at]), query, ids[part].tobytes(), rows[part].astype(kind).tobytes()))
        columns = list(zip(*out)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values())], names=list(kinds))

    def mixed(ids: np.ndarray, number: int) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % number

    def both(where: np.ndarray, table: int, own: np.ndarray, mine: dict, others: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, cells and blocks: each place in its own block meets all blocks of the other side."""
        number = np.array([others.get((table, c), 1) for c in where.tolist()], np.int64)
        at = np.repeat(np.arange(len(where)), number)
        other = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        parts = np.array([mine.get((table, c), 1) for c in where.tolist()], np.int64)
        block = own % parts
        return at, where[at], (block[at], other)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids, rows, _ in banded(batch):
                if b not in large:
                    continue
                u = unit(rows, large[b])
                for t in range(b * tables, (b + 1) * tables):
                    row, cell, (block, chunk) = both(model.cells(u, t % tables), t, mixed(ids, 1 << 24), split, chunks_of)
                    yield packed([(t, False, row, cell, block << 32 | chunk)], ids, rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = read(batch)
            if not len(ids):
                continue
            v = unit(rows, None)
            for t in range(tables):
                probe = model.probes(v, t, probes)
                who, cells = np.repeat(np.arange(len(ids)), probe.shape[1]), probe.ravel()
                for b in large:
                    at, cell, (chunk, block) = both(cells, b * tables + t, mixed(ids, 1 << 24)[who], chunks_of, split)
                    yield packed([(b * tables + t, True, who[at], cell, block << 32 | chunk)], ids, rows)

    def every_pair(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> DataFrame:
        """Queries and rows so dealt that each query meets each row once, in blocks of both."""
        chunks, blocks = max(1, -(-n_queries // block_rows)), max(1, -(-n_rows // block_rows))

        def spread(query: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids, some = read(batch)
                    own = mixed(ids, chunks if query else blocks)
                    for other in range(blocks if query else chunks):
                        that = np.full(len(ids), other)
                        yield packed([(-1, query, np.arange(len(ids)), *((own, that) if query else (that, own)))], ids, some)

            return run

        return queries.mapInArrow(spread(True), dealt).unionByName(rows.mapInArrow(spread(False), dealt))

    def rerank(t: pa.Table) -> pa.Table:
        sides = []
        for query in (True, False):
            some = t.filter(pc.equal(t.column("query"), query))
            ids = np.frombuffer(b"".join(some.column("ids").to_pylist()), np.int64)
            sides.append((ids, np.frombuffer(b"".join(some.column("rows").to_pylist()), kind).astype(np.float64).reshape(-1, dim)))
        (qid, q), (ids, rows) = sides
        out = []
        if len(qid) and len(ids):
            step = max(1, (1 << 22) // len(ids))
            for a in range(0, len(qid), step):
                out += _best(q[a : a + step], qid[a : a + step], rows, ids, k)
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "ids": pa.array([o[1].tobytes() for o in out], pa.binary()), "scores": pa.array([o[2].tobytes() for o in out], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        lengths = [len(b) // 8 for b in t.column("ids").to_pylist()]
        qid = np.repeat(t.column("query_id").to_numpy(), lengths)
        ids, score = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("ids", np.int64), ("scores", np.float64)))
        order = np.lexsort((ids, -score, qid))
        qid, ids, score = qid[order], ids[order], score[order]
        seen = np.lexsort((np.arange(len(ids)), ids, qid))
        new = np.ones(len(ids), bool)
        new[seen[1:]] = (ids[seen[1:]] != ids[seen[:-1]]) | (qid[seen[1:]] != qid[seen[:-1]])
        qid, ids, score = qid[new], ids[new], score[new]
        first = np.searchsorted(qid, qid)
        rank = np.arange(len(qid)) - first + 1
        top = rank <= k
        return pa.table({"query_id": qid[top], "rank": pa.array(rank[top].astype(np.int32)), "vec_id": ids[top], "score": score[top]})

    dealt = "table int, cell long, block long, query boolean, ids binary, rows binary"
    def answered(pairs: DataFrame, number: int) -> DataFrame:
        best = pairs.groupBy("table", "cell", "block").applyInArrow(rerank, "query_id long, ids binary, scores binary")
        parts = max(1, -(-number // MERGE_QUERIES))
        return best.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).applyInArrow(merge, schema)

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of bands that are not hashed."""
        for batch in batches:
            for b, ids, rows, _ in banded(batch):
                if b not in large:
                    yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids), "embedding": pa.array(list(rows.astype(kind)), pa.list_(pa.from_numpy_dtype(kind)))})

    few = sum(r["n"] for r in bands if r["band"] not in large)
    pairs = wanted.mapInArrow(deal, dealt).unionByName(queries.mapInArrow(ask, dealt))
    if few:
        pairs = pairs.unionByName(every_pair(queries, wanted.mapInArrow(outside, f"vec_id long, embedding {stored}"), asked, few))
    found = materialize(answered(pairs, asked), "neighbours")
    # queries that found fewer than there are to find
    there = total - 1 if total > 2 * k else wanted.count() - 1
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, there))
    short = queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select(*wanted.columns)
    lacking = short.count() if there > 0 else 0
    if not lacking:
        return found
    short = materialize(short, "neighbours_short")
    again = answered(every_pair(short, wanted, lacking, total), lacking)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
