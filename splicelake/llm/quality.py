"""Quality rules: word statistics, and compression bands on whole texts and chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of

#: From this many bytes on, the least and largest ratio of
#: compressed to raw bytes (zstandard level 3) that prose of that length has.
#: Short texts pay for the frame and find little to repeat, so the band falls
#: and narrows with length; texts under the first length have no band.
BANDS = (
    (64, 0.45, 1.30),
    (128, 0.42, 1.05),
    (256, 0.40, 0.90),
    (512, 0.36, 0.80),
    (1024, 0.33, 0.72),
    (2048, 0.31, 0.66),
    (4096, 0.29, 0.63),
    (8192, 0.28, 0.61),
    (16384, 0.26, 0.60),
    (65536, 0.24, 0.60),
)
LEVEL = 3
#: Bytes of a chunk, and the share of chunks out of band that rejects a text.
CHUNK, CHUNK_SHARE = 2048, 0.4
#: The base rule: least words, and most percent of words in repeated windows.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = " \t\n\x0b\x0c\r"


def band(n_bytes: int, bands: tuple = BANDS) -> tuple[float, float]:
    """The least and largest ratio allowed at a length."""
    low, high = 0.0, float("inf")
    for least, lo, hi in bands:
        if n_bytes < least:
            break
        low, high = lo, hi
    return low, high


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in some window which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == n:
        return 0
    seen = Counter(grams)
    total, covered = 0, 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            total += i + window - max(i, covered)
            covered = i + window
    return total


class Compression:
    """Ratios of one text against the bands."""

    def __init__(self, bands: tuple = BANDS, level: int = LEVEL, chunk: int = CHUNK, share: float = CHUNK_SHARE):
        self.bands, self.chunk, self.share = bands, chunk, share
        self.compress = zstandard.ZstdCompressor(level=level).compress

    def out_of_band(self, raw: bytes) -> tuple[float, int]:
        """The ratio, and -1 for too repetitive, 1 for incompressible, 0 for neither."""
        if not raw:
            return 0.0, 0
        ratio = len(self.compress(raw)) / len(raw)
        low, high = band(len(raw), self.bands)
        return ratio, (ratio > high) - (ratio < low)

    def verdict(self, raw: bytes) -> tuple[float, int, int, str]:
        """Ratio of the whole, chunks, chunks out of band and the reason (or '')."""
        ratio, side = self.out_of_band(raw)
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)] if len(raw) > self.chunk else []
        sides = [self.out_of_band(c)[1] for c in chunks]
        bad = sum(map(bool, sides))
        reason = {-1: "repetitive", 1: "incompressible", 0: ""}[side]
        if not reason and chunks and bad > self.share * len(chunks):
            reason = "repetitive chunks" if 2 * sides.count(-1) >= bad else "incompressible chunks"
        return ratio, len(chunks), bad, reason


def fit_bands(docs: DataFrame, lengths: tuple = tuple(b[0] for b in BANDS), tail: float = 0.001, margin: float = 0.1, level: int = LEVEL, chunk: int = CHUNK) -> tuple:
    """Bands from clean docs (text): by length, the ratios that all but a ``tail`` of whole texts and chunks have at either end, widened by ``margin``.

    Every text of docs counts, its chunks too where it has some.  A length that
    no text reaches takes the band below it, widened alike; empty and null texts
    say nothing.  Only two quantiles a length reach the driver.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            for some in pieces_of(batch, "text"):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in some.column(0).to_pylist()]
                parts = [p for r in raws for p in (r, *(r[i : i + chunk] for i in range(0, len(r), chunk) if len(r) > chunk)) if p]
                yield pa.RecordBatch.from_pydict({"n": pa.array([bisect_right(lengths, len(p)) for p in parts], pa.int64()), "ratio": pa.array([len(compress(p)) / len(p) for p in parts], pa.float64())})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(read, "n long, ratio double").where("n > 0")
    ends = rows.groupBy("n").agg(F.percentile_approx("ratio", [tail, 1 - tail], 100_000).alias("q")).collect()
    found, bands = {r.n: r.q for r in ends}, []
    for i, least in enumerate(lengths, 1):
        low, high = found.get(i, (bands[-1][1] / (1 - margin), bands[-1][2] / (1 + margin)) if bands else (0.0, float("inf")))
        bands.append((least, low * (1 - margin), high * (1 + margin)))
    return tuple(bands)


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"


def score(docs: DataFrame, bands: tuple = BANDS, level: int = LEVEL, chunk: int = CHUNK, share: float = CHUNK_SHARE) -> DataFrame:
    """Statistics and verdict of every whole text, a row for each row of docs.

    A null text has no words, and so fails the base rule; repeated rows are
    judged each alone; an empty table gives no rows.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compression = Compression(bands, level, chunk, share)
        for batch in batches:
            for some in pieces_of(batch, "text"):
                rows = []
                for text in some.column(1).to_pylist():
                    text = text or ""
                    raw = text.encode("utf-8", "surrogatepass")
                    words = _WORDS.findall(text)
                    n = len(words)
                    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
                    repeats = repeat_words(words)
                    failed = n < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * n
                    ratio, chunks, bad, reason = compression.verdict(raw)
                    rows.append((n, sum(map(len, words)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, not failed and not reason, ratio, chunks, bad, reason))
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([some.column(0), *arrays], names=names)

    names = ["doc_id", *(x.split()[0] for x in FIELDS.split(", "))]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in FIELDS.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, f"doc_id long, {FIELDS}")
