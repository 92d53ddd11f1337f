"""Alignment of two tokenizers' ids over the same bytes.

Places where a byte-level tokenizer (A) and a piece model (B) both end a token
cut a text into groups.  A stretch of a text, whatever its ends, gives a
fragment: the tokens up to its first common end (an open prefix), the closed
groups between, and the tokens after its last common end (an open suffix).
Fragments of neighbouring stretches compose: the suffix of the left one and the
prefix of the right one close groups wherever their ends meet.  That is
associative, so a very long text is cut into byte ranges, its fragments are made
in different tasks, and a tree of compositions puts them together; closed
groups leave the tree as soon as they close.

Most of a text needs no tree: where a space follows something that is not white
space, both tokenizers end a token.  Such cells are numbered by Arrow, each
distinct one is aligned once, and numpy puts texts together.

How many documents hold a pair of ids linked comes from the distinct pairs of
each document, packed in a written table; a second pass over that table looks
the counts up, in slices of a bounded number of pairs.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from ._runtime import materialize, pieces_of

#: Bytes of a text from which it is cut into ranges, and of a range.
RANGE = 32 << 10
#: Fragments that one step of the tree composes.
FAN = 16
#: Pairs of ids whose counts are sent to tasks at once, about.
PAIRS = 1 << 20
#: Cells of a generation of a worker's table, which holds two at most; pairs that a task counts before it passes them on.
GENERATION, HELD = 60_000, 1 << 20
#: Bytes of texts, and of packed pairs, that a task works on at once.
TEXT_BYTES, PAIR_BYTES = 1 << 20, 1 << 20
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


class Tokens(NamedTuple):
    """Ids and byte ends of A's and B's tokens in one stretch of a text."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def upto(self, end: int) -> Tokens:
        i, j = np.searchsorted(self.a_ends, end, "right"), np.searchsorted(self.b_ends, end, "right")
        return Tokens(self.a[:i], self.a_ends[:i], self.b[:j], self.b_ends[:j])

    def after(self, end: int) -> Tokens:
        i, j = np.searchsorted(self.a_ends, end, "right"), np.searchsorted(self.b_ends, end, "right")
        return Tokens(self.a[i:], self.a_ends[i:], self.b[j:], self.b_ends[j:])

    def then(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self, other)))

    def shared(self) -> np.ndarray:
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)


NOTHING = Tokens(*(np.zeros(0, np.int64) for _ in range(4)))


class Fragment(NamedTuple):
    """An open prefix, the last common end (-1: none yet, all is prefix) and the open suffix after it."""

    prefix: Tokens = NOTHING
    cut: int = -1
    suffix: Tokens = NOTHING


class Closed(NamedTuple):
    """Tokens of closed groups and the byte at which the first one begins."""

    tokens: Tokens
    start: int


#: The fragment before a text's first byte, where both tokenizers begin.
BEGIN = Fragment(cut=0)


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Closed | None]:
    """The fragment of two neighbouring stretches, and the groups that close where they meet."""
    known = left.cut >= 0
    middle = (left.suffix if known else left.prefix).then(right.prefix)
    ends = middle.shared()
    closed = None
    if len(ends) > (not known):  # without a common end before, the first one ends the prefix
        start = left.cut if known else int(ends[0])
        closed = Closed(middle.upto(ends[-1]).after(start), start)
    prefix = left.prefix if known else middle.upto(ends[0]) if len(ends) else middle
    if right.cut >= 0:
        return Fragment(prefix, right.cut, right.suffix), closed
    if len(ends):
        return Fragment(prefix, int(ends[-1]), middle.after(ends[-1])), closed
    return Fragment(prefix, left.cut, middle if known else NOTHING), closed


def fragment(tokens: Tokens) -> tuple[Fragment, Closed | None]:
    """The fragment of a stretch's tokens."""
    return compose(Fragment(tokens), Fragment())


#: What is known of closed groups: where they begin, numbers of tokens and groups, the groups as text (a ';' before each) and the linked pairs.
class Summary(NamedTuple):
    start: int
    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    pairs: np.ndarray


class Aligner:
    """Both tokenizers, and what they make of cells."""

    def __init__(self, a_path: str, b_path: str, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b, self.generation = Tokenizer.from_file(a_path), pieces.encoder(b_path), generation
        self.a.encode_special_tokens = True
        if self.a.normalizer or not isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel):
            raise ValueError("not a byte-level tokenizer")
        size = self.a.get_vocab_size()
        self.a_width = np.array([len(self.a.id_to_token(i) or "") for i in range(size)], np.int64)
        self.b_width = pc.binary_length(self.b.surface).to_numpy().astype(np.int64)
        self.shift = np.uint64(int(self.b.size).bit_length())
        self.kind = np.dtype("<u4" if int(self.shift) + int(size).bit_length() <= 32 else "<u8")
        self.many = max(size, self.b.size)
        self.spelled = pa.array([f"{mark}{i}".encode() for mark in ";,|" for i in range(self.many)], pa.binary())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def a_ids(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of cells end to end, and the byte at which each token ends."""
        alone = [not c or bool(_space(c)) for c in cells]  # trailing white space would join with the next cell
        parts, run = [], []
        for cell, apart in zip(cells, alone):
            run.append(cell)
            if apart:
                parts.append(run)
                run = []
        texts = [b"".join(r).decode() for r in [*parts, run]]
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False))])
        return ids, np.cumsum(self.a_width[ids])

    def tokens(self, cells: list[bytes]) -> Tokens:
        a, a_ends = self.a_ids(cells)
        b = np.frombuffer(b"".join(self.b.learn(cells)), "<i4").astype(np.int64)
        return Tokens(a, a_ends, b, np.cumsum(self.b_width[b]))

    def stretch(self, data: bytes, a: tuple[int, int], b: tuple[int, int], at: int) -> Tokens:
        """Tokens of A in bytes a and of B in bytes b of ``data``, whose first byte is byte ``at`` of the text."""
        ids, ends = self.a_ids([data[slice(*a)]])
        b_ids = np.frombuffer(self.b.learn([data[slice(*b)]])[0], "<i4").astype(np.int64)
        return Tokens(ids, ends + at + a[0], b_ids, np.cumsum(self.b_width[b_ids]) + at + b[0])

    def links(self, t: Tokens, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of overlapping tokens, packed, and the number of pairs of each token of A; the stretch begins at ``start`` for both."""
        a_starts, b_starts = np.concatenate(([start], t.a_ends[:-1])), np.concatenate(([start], t.b_ends[:-1]))
        low = np.searchsorted(t.b_ends, a_starts[: len(t.a)], "right")
        n = np.searchsorted(b_starts[: len(t.b)], t.a_ends, "left") - low
        b = t.b[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return ((np.repeat(t.a, n).astype(np.uint64) << self.shift) | b.astype(np.uint64)).astype(self.kind), n

    def written(self, t: Tokens, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The tokens as text, group by group, each with the mark before it; and the group of each."""
        a_group, b_group = np.searchsorted(ends, t.a_ends), np.searchsorted(ends, t.b_ends)
        index, group = np.empty(len(t.a) + len(t.b), np.int64), np.empty(len(t.a) + len(t.b), np.int64)
        a_at = np.arange(len(t.a)) + np.searchsorted(b_group, a_group, "left")
        b_at = np.arange(len(t.b)) + np.searchsorted(a_group, b_group, "right")
        index[a_at] = t.a + self.many * (np.diff(a_group, prepend=-1) == 0)
        index[b_at] = t.b + self.many * np.where(np.diff(b_group, prepend=-1) == 0, 1, 2)
        group[a_at], group[b_at] = a_group, b_group
        return pc.take(self.spelled, pa.array(index)), group

    def summary(self, closed: Closed) -> Summary:
        t = closed.tokens
        ends = t.shared()
        text, _ = self.written(t, ends)
        return Summary(closed.start, len(t.a), len(t.b), len(ends), b"".join(text.to_pylist()), self.links(t, closed.start)[0])

    def learn(self, cells: list[bytes]) -> list[bytes]:
        """What is known of each cell, packed: numbers of A's and B's tokens, of groups and of bytes of their text, the text, the pairs."""
        if not cells:
            return []
        t = self.tokens(cells)
        bounds = np.cumsum([0, *map(len, cells)])
        ends = t.shared()
        if not np.isin(bounds[1:], ends).all():
            raise AssertionError("a token crosses the end of a cell")
        text, group = self.written(t, ends)
        pairs, n = self.links(t, 0)
        groups = np.searchsorted(ends, bounds, "right")
        a_at, b_at = np.searchsorted(t.a_ends, bounds, "right"), np.searchsorted(t.b_ends, bounds, "right")
        place = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1][np.searchsorted(group, groups)]
        link = np.concatenate(([0], np.cumsum(n)))[a_at] * self.kind.itemsize
        heads = np.stack([np.diff(x) for x in (a_at, b_at, groups, place)], axis=1).astype("<u4").tobytes()
        data, packed = bytes(text.buffers()[2]), pairs.tobytes()
        place, link = place.tolist(), link.tolist()
        return [heads[16 * k : 16 * k + 16] + data[place[k] : place[k + 1]] + packed[link[k] : link[k + 1]] for k in range(len(cells))]

    def known(self, cells: list[bytes]) -> list[bytes]:
        """As ``learn`` for distinct cells, through the two generations of the table."""
        young, old = self.young, self.old
        found = list(map(young.get, cells))
        new = []
        for i, x in enumerate(found):
            if x is None:
                if (x := old.get(cells[i])) is None:
                    new.append(i)
                else:
                    found[i] = young[cells[i]] = x
        for i, x in zip(new, self.learn([cells[i] for i in new])):
            found[i] = young[cells[i]] = x
        if len(young) > self.generation:
            self.young, self.old = {}, young
        return found

    def align(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[memoryview], np.ndarray, np.ndarray]:
        """Of texts end to end, each begun by a space: numbers of A's and B's tokens and of groups, the groups as text, and all pairs with the text of each."""
        begin = cell_heads(flat)
        begin[ends[ends < len(flat)]] = True
        if len(begin):
            begin[0] = True
        offsets = np.append(np.flatnonzero(begin), len(flat)).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        found = self.known(cells.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found))
        at, blob = np.cumsum(size) - size, np.frombuffer(b"".join(found), np.uint8)
        head = blob[(at[:, None] + np.arange(16)).ravel()].view("<u4").reshape(-1, 4).astype(np.int64)
        number = cells.indices.to_numpy()
        bounds = np.concatenate(([0], np.searchsorted(offsets, ends)))
        sums = [np.diff(np.concatenate(([0], np.cumsum(head[number, k])))[bounds]) for k in range(3)]
        data, place = _gathered(blob, at + 16, head[:, 3])
        texts = pc.take(pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data)]), cells.indices)
        data, place = memoryview(texts.buffers()[2] or b""), np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1][bounds].tolist() if len(texts) else [0] * len(bounds)
        groups = [data[a:b] for a, b in zip(place, place[1:])]
        width = self.kind.itemsize
        pairs, _ = _gathered(blob, at + 16 + head[:, 3], size - 16 - head[:, 3])
        n = (size - 16 - head[:, 3]) // width
        every, upto = _gathered(pairs.view(self.kind), (np.cumsum(n) - n)[number], n[number])
        return *sums, groups, every, np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(upto[bounds]))

    def counted(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(pairs, return_counts=True)


#: Kinds of bytes: white space, ASCII letters, digits, other ASCII, apostrophe, beyond ASCII.
_KIND = np.array([0 if b in b"\t\n\v\f\r \x1c\x1d\x1e\x1f" else 1 if chr(b).isalpha() and b < 128 else 2 if 48 <= b < 58 else 4 if b == 39 else 3 if b < 128 else 5 for b in range(256)])
#: Whether A surely ends a token between two kinds: letters, digits and others part, and white space begins anew.
_PART = np.zeros((6, 6), bool)
_PART[1:5, 0] = True
for _left, _rights in {1: (2, 3, 4), 2: (1, 3, 4), 3: (1, 2)}.items():
    _PART[_left, list(_rights)] = True


def _space(cell: bytes) -> bool:
    """Whether a stretch may end in white space of any script."""
    last = cell[-3:]
    return _KIND[last[-1]] == 0 or (last[-1] >= 128 and last.decode("utf-8", "replace")[-1].isspace())


def _gathered(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n values from each place on, end to end, and where each begins (and the end)."""
    upto = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(upto[-1], dtype=np.int64)
    place += np.repeat(at - upto[:-1], n)
    return values[place], upto


def cell_heads(flat: np.ndarray) -> np.ndarray:
    """Whether each byte is a space after what is surely not white space."""
    head = flat == 32
    before = np.roll(flat, 1)
    kind = _KIND[before]
    odd = np.flatnonzero(head & (kind == 5))
    head &= kind > 0
    if len(odd):  # white space beyond ASCII, by its last two bytes: U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
        last, two = flat[odd - 1], flat[odd - 2]
        wide = ((two == 0xC2) & ((last == 0x85) | (last == 0xA0))) | ((two == 0x9A) & (last == 0x80)) | ((two == 0x81) & (last == 0x9F))
        wide |= (two == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
        head[odd[wide]] = False
    if len(head):
        head[0] = False
    return head


def a_cut(flat: np.ndarray, at: int, window: int = 4096) -> int:
    """The first byte from ``at`` on before which A surely ends a token."""
    while 0 < at < len(flat):
        stop = min(len(flat), at + window)
        ok = _PART[_KIND[flat[at - 1 : stop - 1]], _KIND[flat[at:stop]]] | cell_heads(flat[at - 1 if at < 2 else at - 2 : stop])[1 if at < 2 else 2 :]
        if ok.any():
            return at + int(np.argmax(ok))
        at = stop
    return at


def b_cut(own: pieces.PieceEncoder, flat: np.ndarray, at: int, window: int = 4096) -> int:
    """The first byte from ``at`` on that no piece of B can cross into."""
    while 0 < at < len(flat):
        begin = at - 1
        while begin > 0 and flat[begin] & 0xC0 == 0x80:
            begin -= 1
        stop = min(len(flat), at + window)
        while stop < len(flat) and flat[stop] & 0xC0 == 0x80:
            stop += 1
        some = flat[begin:stop]
        cut = own.stretches(np.frombuffer(some.tobytes().decode().encode("utf-32-le"), "<u4"))
        cut[0] = False
        if cut.any():
            return begin + int(np.flatnonzero((some & 0xC0) != 0x80)[np.argmax(cut)])
        at = stop
    return at


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner of two tokenizer files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def range_fragment(own: Aligner, data: bytes, at: int, a: tuple[int, int], b: tuple[int, int]) -> tuple[Fragment, list[Summary]]:
    """The fragment of a byte range and its closed groups: A's tokens in bytes a, B's in bytes b of the text; ``data`` begins at byte ``at``."""
    flat, low, high = np.frombuffer(data, np.uint8), max(a[0], b[0]) - at, min(a[1], b[1]) - at
    heads = np.flatnonzero(cell_heads(flat))
    heads = heads[(heads >= low) & (heads <= high)]
    if high == len(flat) and a[1] == b[1]:
        heads = np.append(heads, high)
    (a0, a1), (b0, b1) = ((x[0] - at, x[1] - at) for x in (a, b))
    begin = BEGIN if at == 0 and a0 == 0 and b0 == 0 and len(flat) else Fragment()
    if len(heads) < 2:
        got, closed = compose(begin, Fragment(own.stretch(data, (a0, a1), (b0, b1), at)))
        return got, [own.summary(c) for c in [closed] if c]
    first, last = int(heads[0]), int(heads[-1])
    out, closed = compose(begin, Fragment(own.stretch(data, (a0, first), (b0, first), at)))
    parts = [closed]
    n_a, n_b, n_groups, groups, pairs, _ = own.align(flat[first:last], np.array([last - first]))
    cells = Summary(at + first, int(n_a[0]), int(n_b[0]), int(n_groups[0]), bytes(groups[0]), pairs)
    out, closed = compose(out, Fragment(cut=at + last))
    parts.append(closed)
    out, closed = compose(out, Fragment(own.stretch(data, (last, a1), (last, b1), at)))
    parts.append(closed)
    return out, [cells, *(own.summary(c) for c in parts if c)]


_TOKENS = [f"{side}_{name}" for side in ("prefix", "suffix") for name in ("a", "a_ends", "b", "b_ends")]
_OPEN = "row string, doc_id long, node long, cut long, " + ", ".join(f"{c} binary" for c in _TOKENS)
_PART_COLUMNS = "start long, n_a long, n_b long, n_groups long, groups binary, pairs binary"
_NODE = f"{_OPEN}, {_PART_COLUMNS}"
_TEXT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_READ = f"{_TEXT}, row string, n_ranges long, node long, at long, a_from long, a_to long, b_from long, b_to long, data binary"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _open_row(row: str, doc_id: int | None, node: int, f: Fragment) -> dict:
    return {"row": row, "doc_id": doc_id, "node": node, "cut": f.cut, **{c: x.astype("<i8").tobytes() for c, x in zip(_TOKENS, [*f.prefix, *f.suffix])}}


def _opened(r: dict) -> Fragment:
    parts = [np.frombuffer(r[c], "<i8") for c in _TOKENS]
    return Fragment(Tokens(*parts[:4]), r["cut"], Tokens(*parts[4:]))


def _closed_row(row: str, doc_id: int | None, s: Summary) -> dict:
    return {"row": row, "doc_id": doc_id, **s._asdict(), "pairs": s.pairs.tobytes()}


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest takes; their number tells how many."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _text_row(doc_id: int | None, n_a: int, n_b: int, n_groups: int, digest: str, pairs: np.ndarray, times: np.ndarray) -> dict:
    return {"doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": int(times.sum()), "groups_sha256": digest, "pairs": pairs.tobytes(), "times": _packed(times)}


def _read(docs: DataFrame, a_path: str, b_path: str, range_bytes: int) -> DataFrame:
    """Aligned rows of texts of one range, and the ranges of longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for some in pieces_of(batch, "text", TEXT_BYTES):
                texts = some.column(1)
                # a text with U+2581 comes back from B with a space in its place: it has no tokens
                texts = pc.if_else(pc.fill_null(pc.match_substring(texts, pieces.SPACE), True), "", texts)
                long = pc.greater(pc.binary_length(texts), range_bytes)
                doc_ids = some.column(0).to_pylist()
                flat, ends = pieces.spaced(pc.if_else(long, "", texts))
                n_a, n_b, n_groups, groups, pairs, which = own.align(flat, ends)
                key, times = np.unique((which.astype(np.uint64) << np.uint64(32)) | pairs if own.kind.itemsize == 4 else np.rec.fromarrays([which, pairs]), return_counts=True)
                text_of, pairs = ((key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)) if own.kind.itemsize == 4 else (key["f0"], key["f1"])
                bounds = np.searchsorted(text_of, np.arange(len(ends) + 1))
                rows = []
                for i, is_long in enumerate(long.to_pylist()):
                    if is_long:
                        rows += _ranges(own, doc_ids[i], texts[i].as_py().encode(), range_bytes)
                    else:
                        digest = hashlib.sha256(groups[i][1:]).hexdigest() if n_a[i] else ""
                        at = slice(bounds[i], bounds[i + 1])
                        rows.append(_text_row(doc_ids[i], int(n_a[i]), int(n_b[i]), int(n_groups[i]), digest, pairs[at], times[at]))
                yield _batch(rows, _READ)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _READ)


def _ranges(own: Aligner, doc_id: int | None, text: bytes, range_bytes: int) -> Iterator[dict]:
    """Byte ranges of a long text with the places where A and B part their tokens next."""
    flat = np.frombuffer(b" " + text, np.uint8)
    row, n = uuid.uuid4().hex, -(-len(flat) // range_bytes)
    marks = [min(k * range_bytes, len(flat)) for k in range(n + 1)]
    a, b = [a_cut(flat, m) for m in marks], [b_cut(own.b, flat, m) for m in marks]
    for k in range(n):
        at, stop = min(a[k], b[k]), max(a[k + 1], b[k + 1])
        yield {"doc_id": doc_id, "row": row, "n_ranges": n, "node": k, "at": at, "a_from": a[k], "a_to": a[k + 1], "b_from": b[k], "b_to": b[k + 1], "data": flat[at:stop].tobytes()}


def _leaves(ranges: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for r in _rows(batch):
                f, closed = range_fragment(own, r["data"], r["at"], (r["a_from"], r["a_to"]), (r["b_from"], r["b_to"]))
                yield _batch([_open_row(r["row"], r["doc_id"], r["node"], f), *(_closed_row(r["row"], r["doc_id"], s) for s in closed)], _NODE)

    kept = ranges.select("row", "doc_id", "node", "at", "a_from", "a_to", "b_from", "b_to", "data")
    return kept.repartition("row", "node").mapInArrow(run, _NODE)


def _step(nodes: DataFrame, a_path: str, b_path: str, fan: int) -> DataFrame:
    """Each ``fan`` neighbouring fragments composed to one, and the groups that close by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        key, f, rows = None, Fragment(), []
        for batch in batches:
            for r in _rows(batch):
                if key != (r["row"], r["parent"]):
                    if key:
                        rows.append(_open_row(key[0], doc_id, key[1], f))
                    key, doc_id, f = (r["row"], r["parent"]), r["doc_id"], Fragment()
                    if len(rows) >= 64:
                        yield _batch(rows, _NODE)
                        rows = []
                f, closed = compose(f, _opened(r))
                if closed:
                    rows.append(_closed_row(r["row"], doc_id, own.summary(closed)))
        if key:
            rows.append(_open_row(key[0], doc_id, key[1], f))
        yield _batch(rows, _NODE)

    nodes = nodes.withColumn("parent", F.expr(f"node div {fan}"))
    return nodes.repartition("row", "parent").sortWithinPartitions("row", "parent", "node").mapInArrow(run, _NODE)


def _joined(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Aligned rows of long texts from their closed groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        row, sums, held = None, [0, 0, 0], []
        for batch in batches:
            for r in _rows(batch):
                if r["row"] != row:
                    if row:
                        yield _batch([_text_row(doc_id, *sums, digest.hexdigest(), *own.counted(np.concatenate(held)))], _TEXT)
                    row, doc_id, sums, held, digest = r["row"], r["doc_id"], [0, 0, 0], [], hashlib.sha256()
                digest.update(r["groups"] if sums[0] else r["groups"][1:])
                sums = [s + r[c] for s, c in zip(sums, ("n_a", "n_b", "n_groups"))]
                held.append(np.frombuffer(r["pairs"], own.kind))
        if row:
            yield _batch([_text_row(doc_id, *sums, digest.hexdigest(), *own.counted(np.concatenate(held)))], _TEXT)

    return parts.repartition("row").sortWithinPartitions("row", "start").mapInArrow(run, _TEXT)


def align_texts(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their times, packed, of each row of docs; a written table."""
    read = materialize(_read(docs, a_path, b_path, range_bytes), "aligned")
    whole = read.where(F.col("row").isNull()).select(*_columns(_TEXT))
    ranges = read.where(F.col("row").isNotNull())
    most = ranges.agg(F.max("n_ranges")).first()[0]
    if most is None:
        return whole
    nodes = materialize(_leaves(ranges, a_path, b_path), "fragments")
    parts = nodes
    while most > 1:
        nodes = materialize(_step(nodes.where(F.col("cut").isNotNull()), a_path, b_path, fan), "fragments")
        parts = parts.union(nodes)
        most = -(-most // fan)
    closed = parts.where(F.col("start").isNotNull()).select("row", "doc_id", *_columns(_PART_COLUMNS))
    return whole.union(materialize(_joined(closed, a_path, b_path), "aligned"))


def pair_counts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n, best): in how many rows of ``align_texts`` a packed pair is linked, and whether that is the most of its A id."""
    own = aligner(a_path, b_path)
    kind, shift = own.kind, int(own.shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = np.zeros(0, kind), np.zeros(0, np.int64), []
        for some in (s for batch in batches for s in pieces_of(batch, "pairs", PAIR_BYTES)):
            held.append(np.frombuffer(b"".join(some.column(0).to_pylist()), kind))
            if sum(map(len, held)) >= HELD:
                keys, counts = _added(keys, counts, held)
                held = []
                if len(keys) >= HELD:
                    yield pa.RecordBatch.from_pydict({"pair": keys.astype(np.int64), "n": counts})
                    keys, counts = np.zeros(0, kind), np.zeros(0, np.int64)
        keys, counts = _added(keys, counts, held)
        yield pa.RecordBatch.from_pydict({"pair": keys.astype(np.int64), "n": counts})

    counts = texts.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftrightunsigned("pair", shift))
    counts = materialize(counts, "pair_counts")
    # a row for each id of A: no more than its vocabulary
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _added(keys: np.ndarray, counts: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    more, n = np.unique(np.concatenate([keys[:0], *held]), return_counts=True)
    every = np.concatenate((keys, more))
    keys, where = np.unique(every, return_inverse=True)
    return keys, np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, range_bytes: int = RANGE, fan: int = FAN, slice_pairs: int = PAIRS) -> DataFrame:
    """Aligns the ids of two tokenizers over each row of docs (doc_id, text).

    A encodes a space and the text, B the text.  Returns doc_id, n_a, n_b,
    n_groups, n_links long, groups_sha256 string, n_best and count_sum long:
    links whose pair is in as many documents as any pair of its A id, and the
    sum over links of the documents that hold the pair.  ``align_texts`` keeps
    the pairs themselves, ``pair_counts`` the table of pairs.

    A null or empty text, or one with U+2581 (which B reads as a space), has no
    tokens: zeros and an empty digest.  Each row counts as a document, also if
    another has its doc_id or text.  Texts above ``range_bytes`` are aligned in
    ranges, in tasks of their own; all that one task holds whole is the
    distinct pairs of one text.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = align_texts(docs, a_path, b_path, range_bytes, fan)
    counts = materialize(pair_counts(texts, a_path, b_path), "pair_counts")
    slices = max(1, -(-counts.count() // slice_pairs))
    kind = aligner(a_path, b_path).kind
    texts = texts.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for k in range(slices):
        some = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toArrow()
        pair = some["pair"].to_numpy()
        order = np.argsort(pair)
        table = spark.sparkContext.broadcast((pair[order].astype(kind), some["n"].to_numpy()[order], some["best"].to_numpy(zero_copy_only=False)[order]))
        texts = _looked_up(texts, table, kind)
        if k + 1 < slices:
            texts = materialize(texts, "aligned")
    return texts.drop("pairs", "times")


def _looked_up(texts: DataFrame, table, kind: np.dtype) -> DataFrame:
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = table.value
        for some in (s for batch in batches for s in pieces_of(batch, "pairs", PAIR_BYTES)):
            columns = [some.column(some.schema.get_field_index(n)) for n in names]
            packed, times = columns[6].to_pylist(), columns[7].to_pylist()
            size = np.array([len(p) // kind.itemsize for p in packed], np.int64)
            pairs = np.frombuffer(b"".join(packed), kind)
            n = np.concatenate([np.zeros(0, np.int64), *(_unpacked(t, s) for t, s in zip(times, size.tolist()))])
            at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
            ok = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            which = np.repeat(np.arange(len(size)), size)[ok]
            for c, worth in ((8, best[at[ok]].astype(np.int64)), (9, counts[at[ok]])):
                more = np.zeros(len(size), np.int64)
                np.add.at(more, which, worth * n[ok])
                columns[c] = pa.array(columns[c].to_numpy() + more)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.select(*names).mapInArrow(run, f"{_TEXT}, n_best long, count_sum long")
