"""Exact repeats of a fixed length through suffix sorting of many strings.

``column_wise`` builds the Burrows-Wheeler transform and the common prefixes of
a collection the column-wise way: every round prepends one symbol to every
string, the place of the new suffix follows from the transform so far, and the
transform and the common prefixes are read once and written anew, as sequential
files where a block is large.

``mark`` finds, over a corpus, what lies under a string of ``length`` bytes that
also starts earlier:

1. Every window of ``length`` bytes has an anchor, the k-gram of smallest hash
   in it (the leftmost).  Equal windows have equal anchors at equal offsets, so
   the maximal runs of windows with one anchor, the pieces, meet in one place
   if dealt by the anchor's hash.
2. Anchors that occur once in the corpus are left out: their windows occur once.
3. Pieces of equal bytes are pre-aggregated: the first stays, all windows of
   the others start earlier in the first.
4. The pieces left in a block are sorted column-wise.  Suffixes with common
   prefixes of ``length`` bytes or more are equal windows; all but the first
   of each class are repeats.
5. Anchors of very many pieces would make one block of any size.  Their windows
   are dealt one by one, by a 128-bit digest of their bytes, and only the first
   of each unit, so that a window meets at most as often as there are units;
   equal digests are equal windows.

Units of a bounded number of text bytes carry steps 1 and 3, blocks of a
bounded number of anchors steps 2 and 4; both numbers follow the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import materialize, new_path, open_fs

LENGTH, GRAM = 100, 40
#: Text bytes of a unit and of the text whose anchors make a block.
UNIT_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: Bucket files of the written units; above, a bucket holds several units.
MOST_BUCKETS = 1 << 15
#: Pieces of one anchor from which its windows are dealt one by one.
CROWDED = 8192
#: Bytes that anchors are computed on at once.
SLICE = 1 << 19
#: Bytes of a block's distinct pieces beyond which a round's arrays are files, and entries read at once.
SORT_BYTES, CHUNK = 64 << 20, 1 << 20

_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Columns:
    """Arrays of equal length that a round reads once from front to back and writes anew.

    They are sequential files of the shared file system, one an array and
    round, read and written in stretches of ``CHUNK``.
    """

    def __init__(self, kinds: list[type], folder: str):
        self.kinds, self.round = [np.dtype(k) for k in kinds], 0
        self.fs, self.base = open_fs(folder)
        self.fs.create_dir(self.base, recursive=True)

    def _name(self, turn: int, i: int) -> str:
        return f"{self.base}/{i}-{turn % 2}"

    def write(self, stretches: Iterator[list[np.ndarray]]) -> None:
        out = [self.fs.open_output_stream(self._name(self.round + 1, i)) for i in range(len(self.kinds))]
        for arrays in stretches:
            for f, x in zip(out, arrays):
                f.write(np.ascontiguousarray(x).tobytes())
        for f in out:
            f.close()
        self.round += 1

    def read(self, which: int | None = None) -> Iterator[list[np.ndarray]]:
        """Stretches of the arrays (of the first ``which``)."""
        kinds = self.kinds[:which]
        files = [self.fs.open_input_stream(self._name(self.round, i)) for i in range(len(kinds))]
        while True:
            some = [np.frombuffer(f.read(CHUNK * k.itemsize), k) for f, k in zip(files, kinds)]
            if not len(some[0]):
                break
            yield some
        for f in files:
            f.close()

    def drop(self) -> None:
        self.fs.delete_dir(self.base)


def column_wise(strings: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, suffix length and common prefix with the suffix before, in suffix order.

    Empty suffixes come first, in the order of strings.  Common prefixes of 255
    and more count as 255.  With a ``folder`` the rounds go through sequential
    files there, and only what belongs to the strings' current ends is held.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    return _rounds_in_files(flat, ends, sizes, folder) if folder else _rounds(flat, ends - 1, sizes)


def window_classes(strings: list[bytes], length: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, suffix length and class of all suffixes of ``length`` bytes or more, classes ascending.

    A class has equal first ``length`` bytes.  In memory a symbol is as many
    bytes, four at most, as divide ``length``: a string is then that many strings,
    one from each of its first bytes, and has as many times fewer rounds.  Zeros
    fill their last symbols, which no window of ``length`` bytes holds.
    """
    if folder:
        string, own, lcp = column_wise(strings, folder)
        width = 1
    else:
        width = next(w for w in (4, 2, 1) if length % w == 0)
        sizes = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
        begins = np.cumsum(sizes) - sizes
        # symbols at every byte; a string's last ones end with it
        symbols = np.zeros(len(flat) - width, np.uint32)
        within = np.repeat(begins + sizes, sizes) - np.arange(len(symbols))
        for i in range(width):
            symbols = (symbols << np.uint32(8)) | np.where(within > i, flat[i : len(symbols) + i], 0).astype(np.uint32)
        phase = np.tile(np.arange(width), len(sizes))
        whole = np.repeat(sizes, width)
        count = np.maximum(-(-(whole - phase) // width), 0)
        string, suffix, lcp = _rounds(symbols, np.repeat(begins, width) + phase + (count - 1) * width, count, width)
        own = whole[string] - phase[string] - (count[string] - suffix) * width
        string //= width
    klass = np.cumsum(lcp < length // width)
    long = own >= length
    return string[long], own[long].astype(np.int64), klass[long]


def _rounds(symbols: np.ndarray, last: np.ndarray, sizes: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``column_wise`` in memory, of strings of ``sizes`` symbols (up to 32 bits) that lie ``step`` apart and end at ``last``.

    The transform is held by symbol: ``pairs`` has the symbol before each suffix
    and the suffix's place, sorted.  So the rank of a pair is the place of the
    suffix that begins with its symbol, after the empty ones.  A round gives
    each string's next suffix this place, takes the least common prefix since
    the pair before of the same symbol, which is one less than the new one,
    moves the places in all pairs on and merges the next pairs in.
    """
    m = len(sizes)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    lcp = np.zeros(m, np.uint8)
    pairs, live, to, length = np.zeros(0, np.uint64), np.arange(m), np.arange(m), 0
    while True:
        more = sizes[live] > length
        live = live[more]
        if not len(live):
            break
        fresh = (symbols[last[live] - step * length].astype(np.uint64) << half) | to[more].astype(np.uint64)
        order = np.argsort(fresh)
        fresh, live = fresh[order], live[order]
        rank = np.searchsorted(pairs, fresh) + np.arange(len(fresh))
        old = np.ones(len(pairs) + len(fresh), bool)
        old[rank] = False
        grown = np.empty(len(old), np.uint64)
        grown[old], grown[rank] = pairs, fresh
        pairs = grown
        # new common prefixes: of the fresh and of those right after them, where the pair before has the same symbol
        new = ~old
        new[1:] |= ~old[:-1]
        near = np.flatnonzero(new)
        value = np.zeros(len(near), np.uint8)
        some = np.flatnonzero((near > 0) & (pairs[near] >> half == pairs[near - 1] >> half))
        begin, end = ((pairs[near[some] - i] & low).astype(np.int64) + 1 for i in (1, 0))
        by = np.argsort(begin)
        spans = np.stack((begin[by], end[by]), axis=1).ravel()  # every other one lies between two spans
        value[some[by]] = np.minimum(np.minimum.reduceat(np.append(lcp, np.uint8(0)), spans)[::2], 254) + 1
        grown = np.zeros(m + len(pairs), np.uint8)
        grown[:m] = lcp[:m]
        grown[m:][old] = lcp[m:]
        grown[near + m] = value
        lcp = grown
        # old suffixes move on by the fresh ones before them
        moved = np.concatenate((np.arange(m), np.flatnonzero(old) + m)).astype(np.uint32)
        for a in range(0, len(pairs), CHUNK):
            part = pairs[a : a + CHUNK]
            place = (part & low).astype(np.int64)
            part += moved[place] - place.astype(np.uint64)
        to = rank + m
        length += 1
    # walk the finished transform to name each suffix
    onward = np.empty(len(lcp), np.int64)
    onward[(pairs & low).astype(np.int64)] = np.arange(m, len(lcp))
    string, suffix = np.empty(len(lcp), np.int32), np.zeros(len(lcp), np.int32)
    at = live = np.arange(m)
    string[at] = live
    for length in range(1, int(sizes.max(initial=0)) + 1):
        stay = sizes[live] >= length
        at, live = onward[at[stay]], live[stay]
        string[at], suffix[at] = live, length
    return string, suffix, lcp


def _rounds_in_files(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``column_wise`` through sequential files.

    Round j holds the symbols before all suffixes of length up to j, ``bwt``,
    the common prefixes of neighbours, ``lcp``, and the name of each suffix; 0
    stands before a whole string.  A round reads them once to find the place of
    each string's next suffix, by the number of equal symbols before it, and the
    least common prefix since the last equal symbol, which is one less than the
    new one; it then merges the new entries in and writes all anew.  No more
    than 255 different bytes may occur.
    """
    m = len(sizes)
    present = np.flatnonzero(np.bincount(flat, minlength=256))
    if len(present) > 255:
        raise ValueError("more than 255 different bytes")
    kinds = len(present) + 1
    dense = np.zeros(256, np.uint8)
    dense[present] = np.arange(1, kinds)
    flat = dense[flat]
    at = live = np.flatnonzero(sizes > 0)
    first = np.zeros(m, np.uint8)
    first[live] = flat[ends[live] - 1]
    columns = Columns([np.uint8, np.uint8, np.int64], folder)
    columns.write(iter([[first, np.zeros(m, np.uint8), np.arange(m) << 32]]))
    counts = np.bincount(first, minlength=kinds)
    length = 0
    while len(live):
        length += 1
        starts = np.cumsum(counts) - counts
        to, value_at, values = _places(columns, at, starts, kinds)
        shift = m - int(counts[0])
        before = np.where(length < sizes[live], flat[np.maximum(ends[live] - length - 1, 0)], 0).astype(np.uint8)
        order = np.argsort(to)
        to, live, before = to[order] + shift, live[order], before[order]
        by = np.argsort(value_at)
        columns.write(_merged(columns, to, [before, np.zeros(len(to), np.uint8), (live << 32) + length], value_at[by] + shift, values[by], int(counts.sum())))
        counts += np.bincount(before, minlength=kinds)
        more = before > 0
        live, at = live[more], to[more]
    found = [np.concatenate(x) for x in zip(*columns.read())]
    columns.drop()
    return (found[2] >> 32).astype(np.int32), (found[2] & 0xFFFFFFFF).astype(np.int32), found[1]


def _places(columns: Columns, at: np.ndarray, starts: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One reading of a round: the rank of the symbol at each place of ``at`` (ascending) among all
    symbols by symbol, then place; and new common prefixes, as (rank, value), of those ranks and the next ones.
    """
    seen, base = np.zeros(kinds, np.int64), 0
    running = np.full(kinds, 255, np.uint8)  # least common prefix since the last of a symbol
    pending = np.zeros(kinds, bool)  # whether that last one is of a live string
    ranks, near_ranks, near_values = [], [], []
    for bwt, lcp in columns.read(2):
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        count = np.bincount(bwt, minlength=kinds)
        begin = np.cumsum(count) - count
        back = starts + seen - begin  # from a place in ``order`` to a rank
        mine = at[np.searchsorted(at, base) : np.searchsorted(at, base + n)] - base
        symbol = bwt[mine]
        j = np.empty(len(mine), np.int64)
        by = np.argsort(symbol, kind="stable")
        cuts = np.searchsorted(symbol[by], np.arange(kinds + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            some = by[cuts[c] : cuts[c + 1]]
            j[some] = np.searchsorted(order[begin[c] : begin[c] + count[c]], mine[some]) + begin[c]
        ranks.append(j + back[symbol])
        new = np.zeros(n + 1, bool)
        new[j] = new[j + 1] = True
        new[begin[count > 0]] = False
        new[n] = False
        inner = np.flatnonzero(new)  # not the first of their symbol in this stretch
        low = order[inner - 1] + 1
        spans = order[inner] + 1 - low
        offset = np.cumsum(spans) - spans
        place = np.repeat(low - offset, spans) + np.arange(int(spans.sum()))
        near_ranks.append(inner + back[bwt[order[inner]]])
        near_values.append(np.minimum(np.minimum.reduceat(lcp[place], offset) if len(spans) else np.zeros(0, np.uint8), 254) + 1)
        # the first of each symbol in this stretch looks back over the stretches before
        is_live = np.zeros(n, bool)
        is_live[mine] = True
        upto = np.minimum.accumulate(lcp)
        since = np.minimum.accumulate(lcp[::-1])[::-1]
        here = np.flatnonzero(count)
        head, tail = order[begin[here]], order[begin[here] + count[here] - 1]
        known = seen[here] > 0
        wanted = is_live[head] | (pending[here] & known)
        value = np.where(known, np.minimum(np.minimum(running[here], upto[head]), 254) + 1, 0)
        near_ranks.append((begin + back)[here][wanted])
        near_values.append(value[wanted].astype(np.uint8))
        least = upto[-1] if n else 255
        running = np.minimum(running, least)
        running[here] = np.where(tail + 1 < n, since[np.minimum(tail + 1, n - 1)], 255)
        pending[here] = is_live[tail]
        seen += count
        base += n
    return np.concatenate(ranks), np.concatenate(near_ranks), np.concatenate(near_values)


def _merged(columns: Columns, to: np.ndarray, fresh: list[np.ndarray], value_at: np.ndarray, values: np.ndarray, n: int) -> Iterator[list[np.ndarray]]:
    """The arrays of a round with new entries at the places ``to`` and new common prefixes, stretch by stretch."""
    gap = to - np.arange(len(to))  # old entries before each new one
    base = 0
    for arrays in columns.read():
        size = len(arrays[0])
        a = np.searchsorted(gap, base)
        b = np.searchsorted(gap, base + size) if base + size < n else len(to)
        begin = base + a
        place = to[a:b] - begin
        old = np.ones(size + b - a, bool)
        old[place] = False
        out = []
        for x, y in zip(arrays, fresh):
            z = np.empty(len(old), x.dtype)
            z[old], z[place] = x, y[a:b]
            out.append(z)
        low, high = np.searchsorted(value_at, [begin, begin + len(old)])
        out[1][value_at[low:high] - begin] = values[low:high]
        yield out
        base += size


def gram_hashes(raw: np.ndarray, k: int = GRAM) -> np.ndarray:
    """64-bit hashes of the k-grams that begin at each byte."""

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a[: len(b)] * _ODD
        h += b
        h ^= h >> np.uint64(29)
        return h

    h, n = _TABLE[raw], 1
    parts = []
    rest = k
    while True:
        if rest & n:
            parts.append((n, h))
        rest &= ~n
        if not rest:
            break
        h = joined(h, h[n:])
        n *= 2
    total, done = None, 0
    for n, h in parts:
        total = h if total is None else joined(total, h[done:])
        done += n
    return total * _ODD


def pieces(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, of texts lying in one array: (text, place, windows, anchor hash).

    ``place`` is the first window's place in ``raw``.
    """
    found: list[tuple] = []
    w = length - k + 1
    use = np.flatnonzero(ends - begins >= length)
    at = 0
    while at < len(use):
        # some whole texts, or a stretch of one long text
        stop = at + 1
        while stop < len(use) and ends[use[stop]] - begins[use[at]] <= SLICE and begins[use[stop]] == ends[use[stop - 1]]:
            stop += 1
        low, high = int(begins[use[at]]), int(ends[use[stop - 1]])
        for a in range(low, high - length + 1, SLICE):
            b = min(a + SLICE + length - 1, high)
            h = gram_hashes(raw[a:b], k)
            v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            have = 1
            while have * 2 <= w:
                v = np.minimum(v[:-have], v[have:])
                have *= 2
            if have < w:
                v = np.minimum(v[: len(v) - (w - have)], v[w - have :])
            anchor = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place = np.arange(a, a + len(anchor))
            some = use[at:stop]
            text = np.repeat(some, ends[some] - begins[some])[: len(anchor)] if len(some) > 1 else np.full(len(anchor), use[at])
            good = place + length <= ends[text]
            anchor, place, text = anchor[good], place[good], text[good]
            if not len(place):
                continue
            new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
            found.append((text[new], place[new], np.diff(np.append(new, len(place))), h[anchor[new]]))
        at = stop
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string column in one array, and where each text begins and ends."""
    x = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    _, offsets, data = x.buffers()
    cuts = np.frombuffer(offsets, np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), cuts[:-1], cuts[1:]


def _numbers(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _runs(uid: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (text, first, number) with those that touch made one."""
    order = np.lexsort((start, uid))
    uid, start, stop = uid[order], start[order], start[order] + n[order]
    if not len(uid):
        return uid, start, stop
    group = np.cumsum(np.concatenate(([0], uid[1:] != uid[:-1])))
    base = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + base)
    first = np.flatnonzero(np.concatenate(([True], (start + base)[1:] > reach[:-1])))
    last = np.append(first[1:] - 1, len(uid) - 1)
    return uid[first], start[first], reach[last] - base[last] - start[first]


_PIECES = "unit int, block int, size binary, data binary, hash binary, doc_id binary, uid binary, start binary, n binary"
_ANCHORS = "block int, unit int, hash binary, more binary, number binary"
_WANTED = "unit int, hash binary, crowded binary"
_SPANS = "unit int, uid binary, start binary, n binary"


def _batch(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _by_value(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value, ascending, and where it stands."""
    order = np.argsort(x, kind="stable")
    some, cuts = np.unique(x[order], return_index=True)
    return zip(some.tolist(), np.split(order, cuts[1:]))


def _spans_by_unit(unit: np.ndarray, uid: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
    rows = []
    for u, mine in _by_value(unit):
        rows.append((u, *(x.astype(np.int64).tobytes() for x in _runs(uid[mine], start[mine], n[mine]))))
    return rows


def sort_block(strings: list[bytes], anchor: np.ndarray, doc_id: np.ndarray, uid: np.ndarray, start: np.ndarray, length: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that also start earlier in some other string.

    Strings differ from each other.  One whose anchor no other has holds no
    repeat, as no two of its windows have the anchor at one offset.
    """
    _, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    use = np.flatnonzero(counts[inverse] > 1)
    none = np.zeros(0, np.int64)
    if not len(use):
        return none, none
    string, suffix, klass = window_classes([strings[i] for i in use], length, folder)
    string = use[string]
    offset = np.array([len(s) for s in strings])[string] - suffix
    order = np.lexsort((uid, doc_id))
    rank = np.empty(len(uid), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (doc_id[order][1:] != doc_id[order][:-1]) | (uid[order][1:] != uid[order][:-1]))))
    place = (rank[string] << 40) + start[string] + offset
    first = np.flatnonzero(np.concatenate(([True], klass[1:] != klass[:-1])))
    least = np.minimum.reduceat(place, first)[np.searchsorted(first, np.arange(len(klass)), "right") - 1]
    again = place > least
    return string[again], offset[again]


def again_by_digest(digest: np.ndarray, doc_id: np.ndarray, uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The rows whose digest (row, two halves) some earlier window has too."""
    order = np.lexsort((start, uid, doc_id, digest[:, 1], digest[:, 0]))
    same = (digest[order[1:]] == digest[order[:-1]]).all(axis=1)
    return order[1:][same]


def mark(docs: DataFrame, length: int = LENGTH, k: int = GRAM, keep_text: bool = False, crowded: int = CROWDED, sort_bytes: int = SORT_BYTES) -> DataFrame:
    """docs without ``text`` plus n_bytes, n_removed, n_spans and kept_sha256; with ``keep_text`` also ``text``.

    ``text`` is what stays, decoded, without code points cut in part.  A null
    text has no bytes (and stays null).  "Earlier" goes by doc_id, null before
    all, then by row for repeated doc_ids, then by place.  Texts shorter than
    ``length`` stay whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, blocks = max(1, -(-total // UNIT_BYTES)), max(1, -(-total // BLOCK_BYTES))
    name, scratch = f"suffix_units_{uuid.uuid4().hex}", new_path(spark, "suffix_sort")
    keyed = docs.withColumn("__sa_uid", F.monotonically_increasing_id()).withColumn("__sa_unit", F.pmod(F.xxhash64("__sa_uid"), F.lit(units)).cast("int"))
    buckets = min(units, MOST_BUCKETS)
    folder = new_path(spark, "suffix_units")  # a path of its own: the warehouse may be a folder of the driver's machine
    keyed.repartition(buckets, "__sa_unit").write.bucketBy(buckets, "__sa_unit").format("parquet").option("path", folder).saveAsTable(name)
    table = spark.table(name)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(1).to_numpy()
            for u in np.unique(unit):
                raw, begins, ends = _bytes_of(batch.column(0).filter(pa.array(unit == u)))
                values, counts = np.unique(pieces(raw, begins, ends, length, k)[3], return_counts=True)
                h = np.repeat(values, np.minimum(counts, 2))  # two of a kind say that it repeats
                more = counts > 2  # the others are counted apart
                some_h, some_n = values[more], counts[more] - 2
                block, some_b = (h % np.uint64(blocks)).astype(np.int64), (some_h % np.uint64(blocks)).astype(np.int64)
                more = dict(_by_value(some_b))
                none = np.zeros(0, np.int64)
                rows = [(b, int(u), h[i].tobytes(), some_h[more.get(b, none)].tobytes(), some_n[more.get(b, none)].astype(np.int64).tobytes()) for b, i in _by_value(block)]
                if rows:
                    yield from _batch(_ANCHORS, rows).to_batches()

    def repeated(t: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(x, np.uint64) for x in t.column("hash").to_pylist()]
        h, row = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        np.add.at(counts, np.searchsorted(values, _numbers(t, "more", np.uint64)), _numbers(t, "number", np.int64))
        unit, count = t.column("unit").to_pylist(), counts[inverse]
        twice = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])))  # a row's hashes ascend
        wanted, rows = np.flatnonzero((count > 1) & ~twice), []
        for r, i in _by_value(row[wanted]):
            i = wanted[i]
            rows.append((unit[r], h[i].tobytes(), h[i[count[i] > crowded]].tobytes()))
        return _batch(_WANTED, rows)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.unique(_numbers(right, "hash", np.uint64))
        if not left.num_rows or not len(wanted):
            return _batch(_PIECES, [])
        unit = key[0].as_py()
        ids = pc.fill_null(left.column("doc_id"), np.iinfo(np.int64).min).to_numpy()
        uid = left.column("__sa_uid").to_numpy()
        raw, begins, ends = _bytes_of(left.column("text"))
        text, place, n, h = pieces(raw, begins, ends, length, k)
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        text, place, n, h = (x[wanted[at] == h] for x in (text, place, n, h))
        order = np.lexsort((place, uid[text], ids[text]))
        text, place, n, h = (x[order] for x in (text, place, n, h))
        data, first, again = raw.tobytes(), {}, []
        for i, (p, q) in enumerate(zip(place.tolist(), (place + n + length - 1).tolist())):
            if first.setdefault(data[p:q], i) != i:
                again.append(i)
        start = place - begins[text]
        keep, strings = np.array(list(first.values()), np.int64), list(first)
        rows = []
        # windows of crowded anchors, the first of each in this unit
        hot = np.isin(h[keep], _numbers(right, "crowded", np.uint64))
        crowd = keep[hot]
        piece = np.repeat(crowd, n[crowd])
        step = np.arange(len(piece)) - np.repeat(np.cumsum(n[crowd]) - n[crowd], n[crowd])
        earliest: dict[bytes, int] = {}
        echo = []
        for i, p in enumerate((place[piece] + step).tolist()):
            if earliest.setdefault(hashlib.blake2b(data[p : p + length], digest_size=16).digest(), i) != i:
                echo.append(i)
        mine = np.array(list(earliest.values()), np.int64)
        digest = np.frombuffer(b"".join(earliest), np.uint64).reshape(-1, 2)
        to = (digest[:, 0] % np.uint64(blocks)).astype(np.int64)
        for b, part in _by_value(to):
            i, at = piece[mine[part]], step[mine[part]]
            rows.append((unit, blocks + b, b"", digest[part].tobytes(), b"", ids[text[i]].tobytes(), uid[text[i]].tobytes(), (start[i] + at).tobytes(), b""))
        found_uid, found_start, found_n = uid[text[again]], start[again], n[again]
        if echo:
            i = piece[echo]
            found_uid, found_start, found_n = np.concatenate((found_uid, uid[text[i]])), np.concatenate((found_start, start[i] + step[echo])), np.concatenate((found_n, np.ones(len(echo), np.int64)))
        keep, strings = keep[~hot], [x for x, y in zip(strings, hot.tolist()) if not y]
        block = (h[keep] // np.uint64(blocks) % np.uint64(blocks)).astype(np.int64)
        for b, mine in _by_value(block):
            i = keep[mine]
            some = [strings[x] for x in mine]
            rows.append((unit, b, np.array([len(s) for s in some], np.int32).tobytes(), b"".join(some), h[i].tobytes(), ids[text[i]].tobytes(), uid[text[i]].tobytes(), start[i].tobytes(), n[i].tobytes()))
        for row in _spans_by_unit(np.full(len(found_uid), unit), found_uid, found_start, found_n):
            rows.append((unit, -1 - unit, b"", b"", b"", b"", *row[1:]))
        return _batch(_PIECES, rows)

    def sort(t: pa.Table) -> pa.Table:
        if t.column("block")[0].as_py() < 0:  # repeats that a unit has found by itself
            return t.select(["unit", "uid", "start", "n"])
        size, h, ids, uid, start, n = (_numbers(t, c, kind) for c, kind in (("size", np.int32), ("hash", np.uint64), ("doc_id", np.int64), ("uid", np.int64), ("start", np.int64), ("n", np.int64)))
        unit = np.repeat(t.column("unit").to_numpy(), [len(x) // 8 for x in t.column("uid").to_pylist()])
        if t.column("block")[0].as_py() >= blocks:  # windows of crowded anchors
            which = again_by_digest(_numbers(t, "data", np.uint64).reshape(-1, 2), ids, uid, start)
            return _batch(_SPANS, _spans_by_unit(unit[which], uid[which], start[which], np.ones(len(which), np.int64)))
        data, stops = b"".join(t.column("data").to_pylist()), np.cumsum(size)
        order = np.lexsort((start, uid, ids))
        first, again = {}, []
        for i in order.tolist():
            if first.setdefault(data[stops[i] - size[i] : stops[i]], i) != i:
                again.append(i)
        keep = np.array(list(first.values()), np.int64)
        large = sum(map(len, first)) > sort_bytes
        own = f"{scratch}/{t.column('block')[0].as_py()}-{uuid.uuid4().hex}" if large else None  # another attempt has another
        string, offset = sort_block(list(first), h[keep], ids[keep], uid[keep], start[keep], length, own)
        which = keep[string]
        return _batch(_SPANS, _spans_by_unit(np.concatenate((unit[again], unit[which])), np.concatenate((uid[again], uid[which])), np.concatenate((start[again], start[which] + offset)), np.concatenate((n[again], np.ones(len(which), np.int64)))))

    def digest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        uid, first, n = _runs(*(_numbers(right, c, np.int64) for c in ("uid", "start", "n")))
        uid, first, n = _runs(uid, first, n + length - 1)
        cuts: dict[int, list] = {}
        for u, a, b in zip(uid.tolist(), first.tolist(), (first + n).tolist()):
            cuts.setdefault(u, []).append((a, b))
        out: list[tuple] = []
        for u, text in zip(left.column("__sa_uid").to_pylist(), left.column("text").to_pylist()):
            raw = (text or "").encode()
            spans = cuts.get(u, [])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            row = (len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
            out.append((*row, None if text is None else rest.decode("utf-8", "ignore")) if keep_text else row)
        columns = list(zip(*out)) or [()] * (4 + keep_text)
        kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
        return pa.table([*(left.column(c) for c in others), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*others, *fresh])

    fresh = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * keep_text
    others = [c for c in docs.columns if c != "text"] if keep_text else ["doc_id"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["text string"] * keep_text])

    answers = table.select("text", "__sa_unit").mapInArrow(anchors, _ANCHORS).groupBy("block").applyInArrow(repeated, _WANTED)
    units_of = table.select("text", F.col("doc_id").cast("long").alias("doc_id"), "__sa_uid", "__sa_unit").groupBy("__sa_unit")
    found = units_of.cogroup(answers.groupBy("unit")).applyInArrow(cut, _PIECES)
    try:
        spans = materialize(found.groupBy("block").applyInArrow(sort, _SPANS), "suffix_spans")
        return materialize(table.groupBy("__sa_unit").cogroup(spans.groupBy("unit")).applyInArrow(digest, schema), "suffix_result")
    finally:
        spark.sql(f"DROP TABLE {name}")
        fs, at = open_fs(folder)
        fs.delete_dir(at)
