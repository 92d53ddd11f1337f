"""Compression bands: the verdict of every document by a plain reading, and bands fitted on clean ones."""

import re

import pytest
import zstandard
from pyspark.sql import functions as F

from splicelake.llm import quality


def plain_verdict(text, bands):
    """kept, word by word and chunk by chunk."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    repeated = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words):
        return False

    def inside(raw):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
        own = [b for b in bands if len(raw) >= b[0]]
        return not own or own[-1][1] <= ratio <= own[-1][2]

    raw = text.encode()
    chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048)] if len(raw) > 2048 else []
    return inside(raw) and sum(not inside(c) for c in chunks) <= 0.4 * len(chunks)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_kept_by_a_plain_reading(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    odd = ((64, 0.5, 0.8), (1024, 0.3, 0.45))  # bands that turn many away
    for bands in (quality.BANDS, odd):
        got = {r.doc_id: r.kept for r in quality.score(docs, bands).collect()}
        assert got == {i: plain_verdict(t, bands) for i, t in texts.items()}
        assert len(set(got.values())) == 2


def test_bands_fitted_on_clean_documents(spark, docs, small):
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    clean = docs.join(good, "doc_id").where(F.col("text").isNotNull())
    bands = quality.fit_bands(clean)
    assert [b[0] for b in bands] == [b[0] for b in quality.BANDS] and all(low < high for _, low, high in bands)
    texts = [r.text for r in clean.collect()]
    for t in texts:  # all it was fitted on is inside
        assert quality.Compression(bands).out_of_band(t.encode())[1] == 0
    junk = "".join(chr(33 + (i * i * 7919 + i // 3) % 90) for i in range(6000)), "the same words again and again " * 300
    assert [quality.Compression(bands).out_of_band(t.encode())[1] for t in junk][1] == -1
    # the constants are at least as wide as what clean prose shows
    fitted = quality.fit_bands(clean, margin=0.0)
    seen = {max(b[0] for b in quality.BANDS if b[0] <= len(t.encode())) for t in texts if len(t.encode()) >= 64}
    assert all(low <= f[1] and f[2] <= high for (n, low, high), f in zip(quality.BANDS, fitted) if n in seen)
    assert quality.fit_bands(docs.limit(0))[0] == (64, 0.0, float("inf"))
