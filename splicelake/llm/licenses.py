"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of
from .license_rules import SIGNATURES, VERSIONED

#: Phrases that count as base detections, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: What a detection of a priority is worth.
CONFIDENCE = {9: 1.0, 8: 0.98, 7: 0.9, 6: 0.9, 5: 0.9, 4: 0.8, 3: 0.6, 2: 0.4, 1: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int

    @property
    def confidence(self) -> float:
        return CONFIDENCE[self.priority]


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, by descending priority and then as they are written."""
    found: list[Rule] = []

    def add(priority: int, label: str, keywords: str, pattern: str) -> None:
        # the space before is part of a match, the one after is not: neighbours may share it
        found.append(Rule(label, re.compile(f" (?:{pattern})(?= )".encode()), tuple(keywords.split()), priority))

    for line in SIGNATURES.strip().splitlines():
        priority, *rest = line.split(" | ", 3)
        add(int(priority), *rest)
    for line in VERSIONED.strip().splitlines():
        label, versions, keywords, names = line.split(" | ", 3)
        for version in versions.split():
            words = version.replace(".", " ")
            number = rf"(?:licen[sc]e )?(?:version |v )?(?:v?{words}|v?{words.removesuffix(' 0')})(?: or (?:any )?later(?: version)?| only)?"
            add(9, f"{label}-{version}", "spdx", rf"spdx licen[sc]e identifier {label.replace('-', ' ')} {words}(?: only| or later)?")
            add(5, f"{label}-{version}", keywords, rf"(?:{names}) {number}")
    return tuple(sorted(found, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    """Finds keywords and first words of base phrases; each names the rules it lets through."""
    by: dict[str, list[int]] = {p.split()[0]: [] for p, _ in BASE}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            by.setdefault(word, []).append(i)
    a = ahocorasick.Automaton()
    for word, some in sorted(by.items()):
        a.add_word(f" {word} ", (word, tuple(some)))
    a.make_automaton()
    return a


#: Lower-cases A-Z and turns every byte that belongs to no word into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of detections (begin, end, rule number) those that stay, by place.

    By priority, then length, then rule, then place: a detection goes if it
    holds, or lies in, one that stays.  Those that stay never hold each other,
    so that they have one order by begin and end, and two look-ups tell.
    """
    priority = [r.priority for r in rules()]
    kept: list[tuple[int, int, int]] = []
    for begin, end, rule in sorted(found, key=lambda f: (-priority[f[2]], f[0] - f[1], f[2], f[0])):
        after = bisect_right(kept, (begin, float("inf"), 0))
        holds_it = after and kept[after - 1][1] >= end
        within = bisect_left(kept, (begin, 0, 0))
        if not holds_it and not (within < len(kept) and kept[within][1] <= end):
            insort(kept, (begin, end, rule))
    return kept


def detect(text: bytes, numbers: set[int]) -> list[tuple[int, int, int]]:
    """Kept detections (begin, end, rule number) in a text of single-spaced words with a space at both ends."""
    every = rules()
    return suppress([(m.start() + 1, m.end(), i) for i in sorted(numbers) for m in every[i].pattern.finditer(text)])


def scan_text(raw: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, spans of one text."""
    spaced = b" " + raw.translate(_TABLE) + b" "
    letter = np.frombuffer(spaced, np.uint8) != 32
    n_words = int(np.count_nonzero(letter[1:] & ~letter[:-1]))
    let_through = {found for _, found in _prefilter().iter(spaced.decode("latin-1"))} if n_words else set()
    if not let_through:
        return n_words, 0, None, None, "", "", 0.0, []
    text = b" " + b" ".join(spaced.split()) + b" "
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)  # word i begins after gap i
    starts, base = [], set()
    for phrase, label in BASE:
        token, at = f" {phrase} ".encode(), -1
        while (at := text.find(token, at + 1)) >= 0:
            starts.append(at)
            base.add(label)
    kept = detect(text, {i for _, some in let_through for i in some})
    every = rules()
    labels = base | {every[i].label for _, _, i in kept}
    score = max([0.75 * bool(base), *(every[i].confidence for _, _, i in kept)])
    first = np.searchsorted(gaps, [b - 1 for b, _, _ in kept]).tolist()
    stop = np.searchsorted(gaps, [e for _, e, _ in kept]).tolist()
    spans = [{"label": every[i].label, "first_word": a, "n_words": z - a} for (_, _, i), a, z in zip(kept, first, stop)]
    places = [int(np.searchsorted(gaps, at)) for at in (min(starts), max(starts))] if starts else [None, None]
    return n_words, len(starts), *places, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,n_words:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """Scan every whole text, a row for each row of docs.

    A null text is empty: no words and no labels.  ``spans`` are the rules'
    detections that no other suppressed; ties go by length, rule and place.
    Time grows with the length of a text and the number of its detections, not
    with their pairs.  Repeated rows are scanned each alone; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces_of(batch, "text"):
                rows = [scan_text((t or "").encode("utf-8", "surrogatepass")) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, t) for v, t in zip(zip(*rows), types))], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {FIELDS}")
