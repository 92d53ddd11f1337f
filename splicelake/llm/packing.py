"""Best-fit packing by bin completion.

Packing needs only how many pieces there are of each length: at most
``capacity`` numbers, whatever the size of the corpus.  Spark counts lengths,
``plan_bins`` solves that histogram, and Spark deals every piece its place by
its rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from ._runtime import materialize, pieces_of

CAPACITY = 4096
#: Fillings that a node of the search tries, nodes that the search opens,
#: and cuts that its first packing is sought by: more of them may save bins, no
#: piece depends on them.
FILLINGS, NODES, CUTS = 24, 4_000, 16
#: Rows that a window over pieces of one length may hold on average.
ROWS_IN_WINDOW = 10_000

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over a histogram; bins that look alike are kept as one with a count."""
    open_bins: dict[int, list] = {}  # room left -> [[items, bins]]
    rooms: list[int] = []
    done: Plan = []

    def put(room: int, items: tuple, bins: int) -> None:
        if not room:
            done.append((items, bins))
        elif bins:
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append([items, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                items, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, items, bins = capacity, (), -(-left // (capacity // length))
            each = room // length
            full = min(bins, left // each)
            left -= full * each
            put(room - each * length, (*items, (length, each)), full)
            bins -= full
            if left and bins:  # fewer than a bin takes
                put(room - left * length, (*items, (length, left)), 1)
                left, bins = 0, bins - 1
            if bins and items:
                put(room, items, bins)
    return done + [(items, bins) for some in open_bins.values() for items, bins in some]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can do without: the larger of the volume bound and of the
    bound that counts lengths over capacity - k alone, for every k up to half."""
    total = sum(k * v for k, v in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    number = np.cumsum([0, *(counts[k] for k in lengths)])
    volume = np.cumsum([0, *(k * counts[k] for k in lengths)])
    half = bisect_right(lengths, capacity // 2)
    for i, k in enumerate([0, *lengths[:half]]):
        big = bisect_right(lengths, capacity - k)
        alone = number[-1] - number[big]
        middle = number[big] - number[half] if big > half else 0
        low = bisect_left(lengths, k)
        space = middle * capacity - (volume[big] - volume[half] if big > half else 0)
        rest = volume[half] - volume[low] - space
        best = max(best, int(alone + middle + max(0, -(-rest // capacity))))
    return best


def fullest(counts: dict[int, int], lengths: list[int], room: int, firsts: int = 8) -> tuple:
    """The filling of at most two pieces, or of one of some pieces and two, that wastes least: ((length, times), ...)."""
    best, chosen = room, ()
    every = np.array(lengths[: bisect_right(lengths, room)])
    for k in range(firsts + 1):  # without a first piece, then with one of each part of the lengths
        first = lengths[(len(every) - 1) * k // firsts] if k and len(every) else 0
        if first and not counts[first]:
            continue
        left = room - first
        some = every[: bisect_right(lengths, left, 0, len(every))]
        second = np.searchsorted(some, np.minimum(left - some, some), "right") - 1
        total = some + np.where(second >= 0, some[second], 0)
        for i in np.argsort(-total, kind="stable")[:4].tolist():
            items: dict[int, int] = {}
            for x in (first, int(some[i]), int(some[second[i]]) if second[i] >= 0 else 0):
                if x:
                    items[x] = items.get(x, 0) + 1
            waste = left - int(total[i])
            if waste < best and all(counts[x] >= n for x, n in items.items()):
                best, chosen = waste, tuple(items.items())
                break
        if not best:
            break
    return chosen


def fillings(counts: dict[int, int], lengths: list[int], room: int, waste: int, most: int) -> list[tuple[int, tuple]]:
    """Undominated ways to fill ``room``: (waste, ((length, times), ...)), least waste first.

    One piece of exactly the room dominates all else.  A filling that leaves
    space for an unused piece, or where an unused longer piece could take the
    place of a shorter one, is dominated and left out.  ``lengths`` ascends.
    """
    if counts.get(room):
        return [(0, ((room, 1),))]
    found: list[tuple[int, tuple]] = []
    steps = 0

    def dominated(chosen: dict[int, int], left: int) -> bool:
        if not left:
            return False
        for at in chosen:
            for x in range(at + 1, at + left + 1):
                if counts.get(x, 0) > chosen.get(x, 0):
                    return True
        return False

    stack = [(room, bisect_right(lengths, room), ())]
    while stack and steps < 60 * most and len(found) < 4 * most:
        left, below, chosen = stack.pop()
        steps += 1
        have = dict(chosen)
        at = bisect_right(lengths, left, 0, below) - 1
        while at >= 0 and counts[lengths[at]] <= have.get(lengths[at], 0):
            at -= 1
        if at < 0:  # nothing more fits below the last piece; it must not fit above either
            if left <= waste and not dominated(have, left):
                found.append((left, chosen))
                if not left:
                    break
            continue
        options = []
        exact = left if counts.get(left, 0) > have.get(left, 0) and left <= lengths[at] else 0
        while at >= 0 and len(options) < 3:
            x = lengths[at]
            if counts[x] > have.get(x, 0):
                options.append((x, at))
            at -= 1
        for x, i in reversed([(exact, bisect_left(lengths, exact))] if exact else options):
            stack.append((left - x, i + 1, tuple(sorted({**have, x: have.get(x, 0) + 1}.items(), reverse=True))))
    found.sort(key=lambda f: (f[0], [-x for x, _ in f[1]]))
    return list({f[1]: f for f in found}.values())[:most] or [(room, ())]


def completed(counts: dict[int, int], capacity: int) -> Plan:
    """Bin completion without a way back: the longest piece left with the filling that wastes least."""
    left, lengths, plan = dict(counts), sorted(counts), []
    while lengths:
        longest = lengths[-1]
        left[longest] -= 1
        items = fullest(left, lengths, capacity - longest)
        left[longest] += 1
        whole = dict(items)
        whole[longest] = whole.get(longest, 0) + 1
        bins = min(left[x] // n for x, n in whole.items())
        for x, n in whole.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x], lengths[bisect_left(lengths, x)]
        plan.append((tuple(whole.items()), bins))
    return plan


def incumbent(counts: dict[int, int], capacity: int, least: int, cuts: int = CUTS) -> Plan:
    """The best packing to begin with: best-fit decreasing over all pieces, or, where that is
    over the lower bound, over those longer than a cut with the shorter ones completed bin by bin.

    Where few pieces fit a bin, best fit alone spends the middling ones in
    bins that have room for one more; the cuts keep them for fuller bins.
    """
    best = best_fit(counts, capacity)
    used, lengths = sum(n for _, n in best), sorted(counts)
    number = np.cumsum([counts[x] for x in lengths])
    for k in range(cuts):
        if used <= least:
            break
        at = int(np.searchsorted(number, number[-1] * (1 - k / (1.5 * cuts)))) + 1
        plan = best_fit({x: counts[x] for x in lengths[at:]}, capacity) + completed({x: counts[x] for x in lengths[:at]}, capacity)
        if (n := sum(n for _, n in plan)) < used:
            best, used = plan, n
    return best


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, most: int = FILLINGS) -> Plan:
    """Pack a histogram of lengths into few bins: [(((length, times), ...), bins)].

    Depth-first bin completion.  A node takes the longest piece left, tries the
    undominated fillings of the room beside it from least waste on, and uses
    the chosen bin as often as the counts allow.  A branch ends when its waste
    leaves no bin to save against the best packing known, which ``incumbent``
    gives first.  The search stops at the lower bound, or after ``nodes`` nodes,
    with the best packing found so far.
    """
    counts = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    least = lower_bound(counts, capacity)
    best = incumbent(counts, capacity, least)
    used = sum(n for _, n in best)
    total = sum(k * v for k, v in counts.items())
    left = dict(counts)
    lengths = sorted(left)
    path: Plan = []
    waste, opened = 0, 0

    def take(items: tuple, bins: int) -> None:
        for x, times in items:
            left[x] -= times * bins
            if not left[x]:
                del left[x], lengths[bisect_left(lengths, x)]

    def give(items: tuple, bins: int) -> None:
        for x, times in items:
            if x not in left:
                left[x] = 0
                lengths.insert(bisect_left(lengths, x), x)
            left[x] += times * bins

    def options() -> Iterator:
        longest = lengths[-1]
        left[longest] -= 1
        spare = (used - 1) * capacity - total - waste
        some = fillings(left, lengths, capacity - longest, max(spare, 0), most)
        left[longest] += 1
        for lost, items in some:
            whole: dict[int, int] = dict(items)
            whole[longest] = whole.get(longest, 0) + 1
            yield lost, tuple(whole.items())

    if used > least:
        stack = [options()]
        while stack and opened < nodes and used > least:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if path:
                    items, bins = path.pop()
                    give(items, bins)
                    waste -= bins * (capacity - sum(x * t for x, t in items))
                continue
            lost, items = step
            bins = min(left[x] // t for x, t in items)
            if waste + lost * bins > (used - 1) * capacity - total:
                bins = 1
            if waste + lost * bins > (used - 1) * capacity - total:
                continue
            opened += 1
            take(items, bins)
            path.append((items, bins))
            waste += lost * bins
            if left:
                stack.append(options())
            else:
                best, used = list(path), sum(n for _, n in path)
                give(*path.pop())
                waste -= lost * bins
    return best


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """Encode whole texts, append the end id and cut what is longer than ``capacity``.

    doc_id long, piece int, start long, length long, ids_crc32 long, and with
    ``with_ids`` the ids.  A null text is an empty one: a piece of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            for some in pieces_of(batch, "text"):
                ids, stops = tokens.with_end(*encode(some.column(1)), end_id)
                number = -(-np.diff(stops) // capacity)  # pieces of each document
                doc = np.repeat(np.arange(len(number)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                begin = stops[doc] + start
                length = np.minimum(stops[doc + 1] - begin, capacity)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
                arrays = [some.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, stops[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def deal(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, piece, length, ...).

    The histogram has at most ``capacity`` rows, and so has any plan a bounded
    number of entries.  Ranks among pieces of one length come from windows
    over (length, salt): the number of salts follows the input, so that a
    length that a third of all pieces share is counted by many tasks.
    Repeated rows are pieces of their own.  An empty table gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = plan_bins(histogram, capacity, nodes)
    sequence, slots = 0, {}
    for items, bins in plan:
        offset = 0
        for length, times in items:
            slots.setdefault(length, []).append((bins * times, times, sequence, offset))
            offset += length * times
        sequence += bins
    flat, first, rank = [], {}, 0
    for length in sorted(slots):
        first[length] = rank
        for number, times, base, offset in slots[length]:
            flat.append((rank, times, base, offset, length))
            rank += number
    table = np.array(flat, np.int64).reshape(-1, 5)
    begins = np.zeros(capacity + 1, np.int64)
    for length, at in first.items():
        begins[length] = at

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__rank")
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            number = batch.column(at).to_numpy() + begins[length]
            row = table[np.searchsorted(table[:, 0], number, "right") - 1]
            q = number - row[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(batch.columns) if i != at), pa.array(row[:, 2] + q // row[:, 1]), pa.array(row[:, 3] + q % row[:, 1] * length)],
                names=[*(n for n in batch.schema.names if n != "__rank"), "sequence_id", "offset"],
            )

    salts = F.array(*(F.lit(max(1, -(-histogram.get(x, 0) // ROWS_IN_WINDOW))) for x in range(capacity + 1)))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    within = Window.partitionBy("length", "__salt")
    before = salted.groupBy("length", "__salt").count().select("length", "__salt", (F.sum("count").over(Window.partitionBy("length").orderBy("__salt")) - F.col("count")).alias("__before"))
    ranked = salted.withColumn("__row", F.row_number().over(within.orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "__salt"]).select(*pieces.columns, (F.col("__row") - 1 + F.col("__before")).alias("__rank"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """Pack the ids of whole documents into sequences of at most ``capacity`` ids."""
    return deal(materialize(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
