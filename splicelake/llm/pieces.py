"""Encoding and decoding by a byte-pair SentencePiece model, in vectorised merge rounds.

The symbols of many words lie in one flat numpy array.  A round looks up the
rank of every adjacent pair, takes the least rank of each word (a segmented
minimum), merges all its places at once, leftmost first where places overlap,
and closes the gaps; words that no pair can merge leave the array.  Rounds end
when none is left.

Two things make that exact and short.  A word here is a stretch of a text that
no merge can cross: a text is cut wherever two neighbouring characters stand
side by side in no piece of the vocabulary, so also before each run of spaces.
And merging all places of a rank at once equals merging them one by one as
long as a fresh piece never takes part in a merge of the same or a better rank.
Whether a piece may is found when the model is loaded, by merging every piece
of the vocabulary alone; words that meet such a piece (runs of spaces, whose
scores are all equal) merge one place a round, and long ones go through an
agenda of pairs.

Spaces and U+2581 are the same symbol; inside this module both are a space.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Words of a generation of a worker's table; it holds two generations at most.
GENERATION = 150_000
#: Bytes of a text from which it is encoded in slices.
SLICE = 8 << 20
#: Symbols from which a word with ties of rank goes through the agenda.
TIES = 256
NONE = np.int32(2**31 - 1)
_ENCODERS: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Ids of texts and texts of ids; exactly those of the library without sampling."""

    def __init__(self, path: str, generation: int = GENERATION):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("not a byte-pair model with byte fallback")
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces or not rule.add_dummy_prefix:
            raise ValueError("the model normalizes its text")
        piece = type(model.pieces[0] if model.pieces else None)
        if any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
            raise ValueError("the model has user-defined or unused pieces")
        self.size, self.generation = len(model.pieces), generation
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == trained.eos_piece)
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == piece.NORMAL}
        self._tables(normal)
        self.byte_id = np.zeros(256, np.int32)
        surface: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == piece.BYTE:
                surface.append(bytes([int(p.piece[3:5], 16)]))
                self.byte_id[surface[-1][0]] = i
            else:
                surface.append({piece.NORMAL: p.piece.replace(SPACE, " "), piece.UNKNOWN: UNKNOWN_TEXT}.get(p.type, "").encode())
        self.surface = pa.array(surface, pa.binary())
        self.is_byte = np.array([p.type == piece.BYTE for p in model.pieces])
        self.is_normal = np.array([p.type == piece.NORMAL for p in model.pieces])
        self.is_silent = np.array([not s for s in surface])
        self.spaced = np.array([t and s.startswith(b" ") for s, t in zip(surface, self.is_normal)])
        self._find_ties(list(normal))

    def _tables(self, normal: dict[str, tuple[int, float]]) -> None:
        """Symbols of characters, pairs with their ranks and results, and pairs of characters that stand in some piece."""
        letters = sorted({c for s in normal for c in s})
        number = {s: i for s, (i, _) in normal.items()}
        for c in letters:  # a character that only stands in longer pieces is a symbol as well
            number.setdefault(c, self.size + len(number))
        self.width = max(number.values(), default=0) + 1
        self.symbol = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.symbol[ord(c)] = number[c]
        self.symbol[32] = self.symbol[ord(SPACE)]
        rank = {s: r for r, s in enumerate(sorted({-score for _, score in normal.values()}))}
        rows = [(number[s[:k]] * self.width + number[s[k:]], rank[-score], i) for s, (i, score) in normal.items() for k in range(1, len(s)) if s[:k] in number and s[k:] in number]
        rows.sort()
        pair, self.rank, self.merged = (np.array([r[j] for r in [*rows, (-1, NONE, -1)]], d) for j, d in ((0, np.int64), (1, np.int32), (2, np.int32)))
        # pairs by hash, each at the first free slot from its own on
        self.bits = max(4, int(8 * len(rows)).bit_length())
        self.pair = np.full((1 << self.bits) + len(rows) + 1, -1, np.int64)
        self.at = np.full(len(self.pair), len(rows), np.int32)
        left = np.arange(len(rows))
        slot = self._slot(pair[:-1])
        while len(left):
            slot += self.pair[slot] >= 0
            free = left[self.pair[slot] < 0]
            where, which = np.unique(slot[self.pair[slot] < 0], return_index=True)
            self.pair[where], self.at[where] = pair[free[which]], free[which]
            placed = self.at[slot] == left
            left, slot = left[~placed], slot[~placed]
        self.inside = np.array(sorted({(ord(s[k]) << 21) + ord(s[k + 1]) for s in normal for k in range(len(s) - 1)} or {-1}), np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; NONE where it does not merge."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -1
        slot = self._slot(key)
        found = self.pair[slot]
        again = np.flatnonzero((found != key) & (found >= 0))
        while len(again):
            slot[again] += 1
            found = self.pair[slot[again]]
            again = again[(found != key[again]) & (found >= 0)]
        at = np.where(self.pair[slot] == key, self.at[slot], -1)
        return self.rank[at], self.merged[at]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find_ties(self, pieces: list[str]) -> None:
        """Pieces of which a fresh occurrence may merge on at the same or a better rank.

        Until two symbols merge, nothing around them matters to how they came
        about: each piece, merged alone, one place a round, shows whether its
        last merge ranks no worse than the one before.
        """
        self.tied = np.zeros(self.width, bool)
        words = [p for p in pieces if len(p) > 2]
        size = np.array([len(p) for p in words], np.int64)
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")] if words else np.zeros(0, np.int32)
        word = np.repeat(np.arange(len(words)), size)
        last = np.full(len(words), -1, np.int64)  # result of the merge before, and its rank
        before = np.full(len(words), -1, np.int64)
        while len(sym):
            rank, result = self._ranks(sym, word)
            least, size = _least(rank, word)
            alive = np.repeat(least < NONE, size)
            sym, word, rank, result = sym[alive], word[alive], rank[alive], result[alive]
            if not len(sym):
                break
            places = np.flatnonzero(rank == np.repeat(least[least < NONE], size[least < NONE]))
            first = places[np.diff(word[places], prepend=-1) > 0]
            again = (last[word[first]] >= rank[first]) & (before[word[first]] >= 0)
            fresh = before[word[first]]
            took_part = again & ((sym[first] == fresh) | (sym[first + 1] == fresh))
            self.tied[fresh[took_part]] = True
            last[word[first]], before[word[first]] = rank[first], result[first]
            sym, word = self._merge(first, result, sym, word)

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that begins at each symbol."""
        rank, result = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], result[inner] = self._look_up(sym[inner], sym[inner + 1])
        return rank, result

    @staticmethod
    def _merge(places: np.ndarray, result: np.ndarray, sym: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
        keep = np.ones(len(sym), bool)
        keep[places + 1] = False
        sym[places] = result[places]
        return [x[keep] for x in (sym, *others)]

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, in order, and the character at which each begins."""
        start = np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, result = self._ranks(sym, word)
        while len(sym):
            least, size = _least(rank, word)
            over = np.repeat(least == NONE, size)
            if over.any():
                done.append((start[over], sym[over]))
                going = ~over
                sym, word, start, rank, result = sym[going], word[going], start[going], rank[going], result[going]
                size, least = size[least < NONE], least[least < NONE]
                if not len(sym):
                    break
            flagged = np.flatnonzero(rank == np.repeat(least, size))
            run = np.flatnonzero(np.diff(flagged, prepend=-2) > 1)  # places side by side: every second one
            offset = np.arange(len(flagged)) - np.repeat(run, np.diff(np.append(run, len(flagged))))
            places = flagged[offset % 2 == 0]
            tie = self.tied[result[places]]
            if tie.any():
                words = np.unique(word[places[tie]])
                in_tie = np.isin(word[places], words)
                first = np.diff(word[places], prepend=-1) > 0
                long = words[np.searchsorted(word, words, "right") - np.searchsorted(word, words) >= TIES]
                places = places[(~in_tie | first) & ~np.isin(word[places], long)]
                if len(long):
                    apart = np.isin(word, long)
                    for w in long.tolist():
                        a, b = np.searchsorted(word, (w, w + 1))
                        done.append(self._agenda(sym[a:b], start[a:b]))
                    stays, places = ~apart, places - np.searchsorted(np.flatnonzero(apart), places)
                    sym, word, start, rank, result = sym[stays], word[stays], start[stays], rank[stays], result[stays]
            sym, word, start, rank, result = self._merge(places, result, sym, word, start, rank, result)
            fresh = places - np.arange(len(places))
            near = np.concatenate((fresh, fresh[1:][fresh[1:] - 1 > fresh[:-1]] - 1, fresh[:1][fresh[:1] > 0] - 1))
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near], result[near] = self._look_up(sym[near], sym[near + 1])
        if not done:
            return sym, start
        begins, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(begins, kind="stable")
        return symbols[order], begins[order]

    def _agenda(self, sym: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word with ties, pair by pair: best rank first, then leftmost."""
        n = len(sym)
        ranks, results = (x.tolist() for x in self._look_up(sym[:-1], sym[1:]))
        symbols, nxt, prev = sym.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        found: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks, results)) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j], nxt[i] = m, -2, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            nxt[j] = -1
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0:
                    pair = symbols[left], symbols[right]
                    if pair not in found:
                        r, m = self._look_up(np.array(pair[:1]), np.array(pair[1:]))
                        found[pair] = int(r[0]), int(m[0])
                    if found[pair][0] < NONE:
                        heapq.heappush(heap, (found[pair][0], left, *pair, found[pair][1]))
        out = np.array(symbols, np.int32)
        return start[out != -2], out[out != -2]

    def stretches(self, codes: np.ndarray) -> np.ndarray:
        """Whether no merge can cross from each character's predecessor to it; codes are code points."""
        codes = np.where(codes == 32, ord(SPACE), codes).astype(np.int64)
        key = (codes[:-1] << 21) + codes[1:]
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return np.concatenate(([True], self.inside[at] != key))[: len(codes)]

    def learn(self, cells: list[bytes]) -> list[bytes]:
        """Ids of each cell, a stretch of UTF-8 that begins and ends where no merge crosses, as packed ``<i4``."""
        blob = b"".join(cells)
        raw = np.frombuffer(blob, np.uint8)
        codes = np.frombuffer(blob.decode().encode("utf-32-le"), "<u4")
        if not len(codes):
            return [b""] * len(cells)
        leads = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each character begins
        bounds = np.cumsum([0, *map(len, cells)])
        first = np.searchsorted(leads, bounds)
        cut = self.stretches(codes)
        cut[first[first < len(codes)]] = True
        symbols, begins = self._rounds(self.symbol[codes], np.cumsum(cut))
        width = np.diff(np.append(leads, len(raw)))[begins]
        whole = (symbols >= 0) & (symbols < self.size)
        n = np.where(whole, 1, width)
        stops = np.concatenate(([0], np.cumsum(n)))
        ids = np.repeat(symbols, n)
        spelled = np.repeat(~whole, n)
        if spelled.any():
            byte = np.repeat(leads[begins] - stops[:-1], n) + np.arange(stops[-1])
            ids[spelled] = self.byte_id[raw[byte[spelled]]]
        place = stops[np.searchsorted(begins, first)] * 4
        packed = ids.astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip(place.tolist(), place[1:].tolist())]

    def known(self, cells: list[bytes]) -> list[bytes]:
        """As ``learn`` for distinct cells, through the two generations of the table."""
        young, old = self.young, self.old
        found = list(map(young.get, cells))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                if (ids := old.get(cells[i])) is None:
                    new.append(i)
                else:
                    found[i] = young[cells[i]] = ids
        for i, ids in zip(new, self.learn([cells[i] for i in new])):
            found[i] = young[cells[i]] = ids
        if len(young) > self.generation:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array (int32), and where each text begins in it (and the end); null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        flat, ends = spaced(texts)
        ids, stops = [], [np.zeros(1, np.int64)]
        for a, b in slices(flat, ends):
            cells = cells_of(flat[a:b], np.unique(ends[(ends > a) & (ends < b)] - a))
            coded = cells.dictionary_encode()
            found = self.known(coded.dictionary.to_pylist())
            some = np.frombuffer(b"".join(found), "<i4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at, number = np.cumsum(size) - size, coded.indices.to_numpy()
            n = size[number]
            ids.append(some[np.repeat(at[number] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            begins = np.frombuffer(cells.buffers()[1], np.int32)[: len(cells) + 1] + a
            inside = ends[(ends > a) & (ends <= b)]
            upto = np.concatenate(([0], np.cumsum(n)))
            stops.append(upto[np.searchsorted(begins, inside)] + sum(map(len, ids[:-1])))
        empty = np.zeros(int((ends == 0).sum()), np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate((stops[0], empty, *stops[1:]))

    def with_end(self, ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.insert(ids, stops[1:], self.end_id), stops + np.arange(len(stops))

    def decode(self, ids: np.ndarray, stops: np.ndarray) -> pa.Array:
        """Texts of runs of ids; bytes that spell no character become U+FFFD, control ids nothing."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        loud = ~self.is_silent[ids]
        first = np.concatenate(([0], np.cumsum(loud)))[stops]
        ids, place = ids[loud], np.flatnonzero(loud)
        gap = (np.diff(place, prepend=-1) > 1) & self.is_byte[ids]  # bytes with a control id before them
        raw = pc.take(self.surface, pa.array(ids))
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[: len(ids) + 1]
        data = raw.buffers()[2] or pa.py_buffer(b"")
        begin, end = offsets[first[:-1]].astype(np.int64), offsets[first[1:]].astype(np.int64)
        if len(ids):
            begin += self.spaced[ids[np.minimum(first[:-1], len(ids) - 1)]] & (first[:-1] < first[1:])
        out = pa.array([], pa.string())
        whole = memoryview(data)
        if not gap.any():
            try:
                str(whole, "utf-8")
                trimmed = [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())]
                return pa.array([bytes(t) for t in trimmed], pa.binary()).cast(pa.string())
            except (UnicodeDecodeError, pa.ArrowInvalid):
                pass
        out = []
        for a, b, lead in zip(first.tolist(), first[1:].tolist(), (begin - offsets[first[:-1]]).tolist()):
            out.append(_spell(ids[a:b], gap[a:b], raw[a:b].to_pylist(), self.is_byte)[lead:])
        return pa.array(out, pa.string())


def _least(rank: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least rank and the number of symbols of each word."""
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    return np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(rank)))


def _spell(ids: np.ndarray, gap: np.ndarray, parts: list[bytes], is_byte: np.ndarray) -> str:
    """A text with runs of bytes that may spell no character."""
    out, run = [], b""
    for i, part, broken in zip(ids.tolist(), parts, gap.tolist()):
        if run and (broken or not is_byte[i]):
            out.append(_characters(run))
            run = b""
        if is_byte[i]:
            run += part
        else:
            out.append(part.decode())
    return "".join([*out, _characters(run)])


def _characters(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        size = 1 if run[at] < 0xC0 else 2 if run[at] < 0xE0 else 3 if run[at] < 0xF0 else 4
        try:
            out.append(run[at : at + size].decode())
            at += size
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, with a space before each that is not empty, U+2581 as a space; and where each ends."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
    prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string())
    texts = pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]] if len(texts) else flat[:0], (offsets[1:] - offsets[0]) if len(texts) else np.zeros(0, np.int64)


def heads(flat: np.ndarray) -> np.ndarray:
    """Whether a run of spaces begins at each byte."""
    space = flat == 32
    space[1:] &= ~(flat[:-1] == 32)
    return space


def slices(flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE bytes that end where a text or a cell does."""
    at = 0
    while at < len(flat):
        stop = min(len(flat), at + SLICE)
        while stop < len(flat):
            found = np.flatnonzero(heads(flat[stop - 1 : stop + SLICE])[1:])
            later = ends[np.searchsorted(ends, stop)]
            nearest = stop + int(found[0]) if len(found) else len(flat)
            if min(later, nearest) <= stop + SLICE:
                stop = min(int(later), nearest)
                break
            stop += SLICE
        stop = min(stop, len(flat))
        yield at, stop
        at = stop


def cells_of(flat: np.ndarray, breaks: np.ndarray) -> pa.Array:
    """The stretches from each run of spaces to the next; ``breaks`` begin one as well."""
    begin = heads(flat)
    begin[breaks] = True
    if len(begin):
        begin[0] = True
    offsets = np.concatenate((np.flatnonzero(begin), [len(flat)])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def encoder(path: str) -> PieceEncoder:
    """This process's encoder of a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of each row of docs (doc_id, text); with ``decoded`` also the text that the ids give.

    A null text is empty: no ids but the end id.  Rows that share a doc_id or a
    text are encoded each alone, and an empty table gives no rows.  Texts are
    encoded whole, in slices of SLICE bytes where they are longer.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for some in pieces_of(batch, "text"):
                ids, stops = own.encode(some.column(1))
                if end:
                    ids, stops = own.with_end(ids, stops)
                columns = [some.column(0), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, own.decode(ids, stops)] if decoded else columns, names=names)

    names = ["doc_id", "ids", "text"] if decoded else ["doc_id", "ids"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of rows (doc_id, ids); null ids give a null text, ids beyond the vocabulary are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            lists = batch.column(1)
            ids = pc.drop_null(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int32)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = own.decode(ids, np.concatenate(([0], np.cumsum(n, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pc.is_valid(lists), texts, None)], names=["doc_id", "text"])

    ids = F.filter(F.col("ids").cast("array<int>"), lambda i: i.isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, text string")
