"""Runs of words: maximal stretches that repeat with a period, by string synchronising sets.

At scale t (2, 4, 8, ...) each place whose window of t words is not highly
periodic gets a hash of that window.  The synchronising set holds the places i
where the least hash of the places i..i+t belongs to i or to i+t: whether a
place is in the set depends on its 2t words alone, and outside highly periodic
regions every t places hold one.  A run of period q from 3t-1 to 6t-2 then
holds two places of the set that are q apart and have equal contexts of 2t
words.  So each two places of the set at such a distance with equal contexts
propose it, and hashes of prefixes extend the proposal to both sides.

Regions of period at most t/3 have no such places.  They are runs of smaller
scales, known before.  A run of period q is missed by the set only if both its
halves lie in such regions, of one root, that touch: the distances at which
their roots fall on each other propose it.  Periods up to four, below the first
scale, come from comparing neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of

#: A run has at least this many words, and at least two periods.
LEAST = 12
#: Periods found by comparing neighbours; the first scale takes over after them.
SMALL, FIRST_SCALE = 4, 2
#: Primes and bases of the two hashes of a stretch.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1664525191)
MOST = np.uint64(2**64 - 1)


class Hashes:
    """Hashes of all stretches of a sequence, by prefix sums modulo two primes."""

    def __init__(self, words: np.ndarray, seed: int = 0):
        self.n = len(words)
        self.sums, self.powers, self.inverse = [], [], []
        mixed = (words.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        for prime, base, shift in zip(PRIMES, BASES, (33, 2)):
            value = ((mixed >> np.uint64(shift)) % np.uint64(prime)).astype(np.int64)
            base = (base + seed) % prime
            power = _powers(base, self.n + 1, prime)
            total = np.zeros(self.n + 1, np.int64)
            np.cumsum(value * power[:-1] % prime, out=total[1:])
            self.sums.append(total % prime)
            self.powers.append(power)
            self.inverse.append(_powers(pow(base, -1, prime), self.n + 1, prime))

    def of(self, at: np.ndarray | slice, length: int, beyond: np.ndarray | slice) -> np.ndarray:
        """Hashes of the stretches of ``length`` words that begin at ``at`` and end before ``beyond``."""
        a, b = ((s[beyond] - s[at]) % p * i[at] % p for s, i, p in zip(self.sums, self.inverse, PRIMES))
        h = (a.astype(np.uint64) << np.uint64(31)) + b.astype(np.uint64)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def windows(self, length: int, upto: int) -> np.ndarray:
        """Hashes of all windows of ``length`` words within the first ``upto``."""
        k = upto - length + 1
        return self.of(slice(0, k), length, slice(length, length + k))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the stretches of ``length`` words at i and at j > i are equal."""
        same = np.ones(len(i), bool)
        for s, w, p in zip(self.sums, self.powers, PRIMES):
            same &= (s[i + length] - s[i]) % p * w[j - i] % p == (s[j + length] - s[j]) % p
        return same

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j > i on."""
        return self._extend(i, j, self.n - j, 0)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and before j > i."""
        return self._extend(i, j, i, 1)

    def _extend(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, back: int) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        step = np.ones(len(i), np.int64)
        growing = np.ones(len(i), bool)
        alive = np.arange(len(i))
        while len(alive):  # steps double while stretches agree, then halve
            g, s = got[alive], step[alive]
            fits = g + s <= room[alive]
            ok = fits.copy()
            a, b = i[alive][fits], j[alive][fits]
            g, length = g[fits], s[fits]
            ok[fits] = self.equal(a - g - length, b - g - length, length) if back else self.equal(a + g, b + g, length)
            got[alive[ok]] += s[ok]
            growing[alive[~ok]] = False
            grows = growing[alive]
            step[alive] = np.where(grows, s * 2, s // 2)
            alive = alive[step[alive] > 0]
        return got


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * (pow(base, have, prime)) % prime
        have += more
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, MOST)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    k = len(values) - width + 1
    return np.minimum(behind[:k], ahead[width - 1 : width - 1 + k])


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each longest stretch of true values, of at least ``least``."""
    edge = np.diff(np.concatenate(([0], equal.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= least
    return begin[long], end[long]


class Found:
    """Runs so far, each once, with its least period."""

    def __init__(self):
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        if not len(start):
            return
        start, end, period = (np.concatenate(x) for x in ((self.start, start), (self.end, end), (self.period, period)))
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
        self.start, self.end, self.period = start[first], end[first], period[first]

    def regions(self, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (self.period <= most) & (self.end - self.start >= least)
        return self.start[ok], self.end[ok], self.period[ok]


def _synchronising(hashes: Hashes, regions: tuple, scale: int, upto: int) -> np.ndarray:
    """The synchronising set of a scale within the first ``upto`` words."""
    value = hashes.windows(scale, upto)
    start, end, _ = regions
    if len(start):
        covered = np.zeros(len(value) + 1, np.int64)
        inside = start <= upto - scale
        np.add.at(covered, start[inside], 1)
        np.add.at(covered, np.minimum(end[inside] - scale + 1, len(value)), -1)
        value[np.cumsum(covered[:-1]) > 0] = MOST
    least = _sliding_least(value, scale + 1)
    k = len(least)
    return np.flatnonzero((least != MOST) & ((least == value[:k]) | (least == value[scale : scale + k])))


def _equal_contexts(hashes: Hashes, places: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with the distance of each other one, from 3 to 6 scales on, that has the same context."""
    context = hashes.of(places, 2 * scale, places + 2 * scale)
    at, distance = [], []
    for k in range(1, len(places)):
        apart = places[k:] - places[:-k]
        near = apart <= 6 * scale - 2
        if not near.any():
            break
        hit = np.flatnonzero(near & (apart >= 3 * scale - 1) & (context[k:] == context[:-k]))
        at.append(places[hit])
        distance.append(apart[hit])
    return (np.concatenate(at), np.concatenate(distance)) if at else (places[:0], places[:0])


def _touching(hashes: Hashes, regions: tuple, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances proposed by two highly periodic regions of one root that touch."""
    start, end, period = regions
    none = np.zeros(0, np.int64)
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    one = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
    if not len(one):
        return none, none
    a1, b1, a2, b2, p = start[one], end[one], start[one + 1], end[one + 1], period[one]
    # the shift that lays the first period of the second region on the first region
    pair = np.repeat(np.arange(len(one)), p)
    shift = np.arange(len(pair)) - np.repeat(np.cumsum(p) - p, p)
    hit = np.flatnonzero(hashes.equal(a1[pair] + shift, a2[pair], p[pair]))
    pair, shift = pair[hit], shift[hit]
    a1, b1, a2, b2, p = a1[pair], b1[pair], a2[pair], b2[pair], p[pair]
    rest = (a2 - a1 - shift) % p
    low = 3 * scale - 1 + (rest - (3 * scale - 1)) % p
    high = np.minimum(6 * scale - 2, np.minimum(b1 - a1, b2 - a2) + p)
    n = np.maximum(0, (high - low) // p + 1)
    k = np.repeat(np.arange(len(p)), n)
    q = low[k] + (np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)) * p[k]
    at = np.maximum(a1[k], a2[k] - q)
    ok = at + q < b2[k]
    return at[ok], q[ok]


def find_runs(words: np.ndarray, lengths: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of at least two periods, by start, then end.

    ``words`` are numbers, equal for equal words.  ``lengths`` may name the
    lengths of texts that lie end to end in it, longest first, each followed
    by a number found nowhere else: no run then crosses from one to the next,
    and a scale looks only at texts long enough for it.
    """
    n = len(words)
    lengths = np.array([n]) if lengths is None else lengths
    ends = np.minimum(np.cumsum(lengths + 1), n)
    found = Found()
    for q in range(1, min(SMALL, n // 2) + 1):
        begin, end = _stretches(words[q:] == words[:-q], q)
        found.add(begin, end + q, np.full(len(begin), q))
    if not n or lengths[0] < 6 * FIRST_SCALE - 2:
        return found.start, found.end, found.period
    hashes, scale = Hashes(words, seed), FIRST_SCALE
    while lengths[0] >= 6 * scale - 2:
        upto = int(ends[np.count_nonzero(lengths >= 6 * scale - 2) - 1])
        sparse = _synchronising(hashes, found.regions(scale // 3, scale), scale, upto)
        at, distance = (np.concatenate(x) for x in zip(_equal_contexts(hashes, sparse, scale), _touching(hashes, found.regions(scale // 3, 3 * scale - 1), scale)))
        start = at - hashes.backward(at, at + distance)
        end = at + distance + hashes.forward(at, at + distance)
        ok = end - start >= 2 * distance
        found.add(start[ok], end[ok], distance[ok])
        scale *= 2
    if not _exact(words, found):  # two different stretches had one hash: hash anew
        return find_runs(words, lengths, seed + 1)
    return found.start, found.end, found.period


def _exact(words: np.ndarray, found: Found, most: int = 1 << 22) -> bool:
    """Whether every run repeats word by word and ends where its period does."""
    start, end, period = found.start, found.end, found.period
    for edge, other in ((start - 1, start - 1 + period), (end - period, end)):
        inside = (edge >= 0) & (other < len(words))
        if (words[edge[inside]] == words[other[inside]]).any():
            return False
    size = end - start - period
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + most)))
        n = size[at:stop]
        place = np.repeat(start[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if (words[place] != words[place + np.repeat(period[at:stop], n)]).any():
            return False
        at = stop
    return True


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the number of words of each; null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
    there = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), np.diff(upto[offsets])


def scan(texts: pa.Array, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Number of words of each text; text, start, length and period of each run, by text, start, period; and the collapsed texts."""
    words, n = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.argsort(-n, kind="stable")
    begins = np.cumsum(n) - n  # of each text in words
    placed = np.cumsum(n[order] + 1) - n[order] - 1  # of each text among the longest first, with a number of its own after each
    flat = np.empty(len(codes) + len(n), np.int64)
    flat[placed + n[order]] = -1 - np.arange(len(n))
    target = np.repeat(placed - begins[order], n[order])
    source = np.repeat(begins[order] - np.cumsum(n[order]) + n[order], n[order]) + np.arange(len(codes))
    flat[source + target] = codes[source]
    start, end, period = find_runs(flat, n[order])
    ok = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[ok], end[ok], period[ok]
    which = np.searchsorted(placed, start, "right") - 1
    text, start, length = order[which], start - placed[which], end - start
    by = np.lexsort((period, start, text))
    text, start, length, period = text[by], start[by], length[by], period[by]
    drop = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drop, begins[text] + start + period, 1)
    np.add.at(drop, begins[text] + start + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    upto = np.concatenate(([0], np.cumsum(keep)))[np.append(begins, len(codes))]
    lists = pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), words.filter(pa.array(keep)))
    return n, [text, start, length, period], pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def detect(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Every run of words of each row of docs (doc_id, text), and the text without repeats.

    Returns doc_id, n_words long, runs array<struct<start,length,period>> (by
    start, then period) and collapsed string: the words that no run holds after
    its first period, joined by single spaces.  A run is a stretch of at least
    ``least`` words and two smallest periods that no neighbour extends.  A null
    text is empty, with no run and the empty string; repeated rows are scanned
    each alone; an empty table gives no rows.  Texts are scanned whole: a task
    needs some 200 bytes for each word of its longest text.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces_of(batch, "text"):
                n, (text, *columns), collapsed = scan(some.column(1), least)
                offsets = np.searchsorted(text, np.arange(len(n) + 1))
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
