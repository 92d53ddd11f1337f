"""Runs of words against the definition, tried on every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from splicelake.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, `odd name` int"


def by_definition(words):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def sequences(rng, k):
    """Random, repeated, Fibonacci, Thue-Morse and nested periodic sequences of few letters."""
    n, kind = rng.randint(0, 160), k % 8
    few = lambda m, letters: [rng.randrange(letters) for _ in range(m)]
    if kind < 2:
        return few(n, 2 + kind)
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 3:  # squares whose halves are highly periodic
        half = (few(rng.randint(1, 4), 2) * 40)[: rng.randint(1, 60)]
        return [9] * rng.randint(0, 2) + half + half + [8] + half[: rng.randint(1, 60)]
    if kind == 4:
        return few(rng.randint(0, 40), 4) + (few(rng.randint(1, 60), 4) * 9)[: rng.randint(1, 300)] + few(rng.randint(0, 20), 4)
    if kind == 5:
        return ([0] * rng.randint(1, 30) + [1]) * rng.randint(1, 5) + [0] * rng.randint(0, 30)
    if kind == 6:
        w = [0]
        while len(w) < n:
            w += [1 - x for x in w]
        return w
    root = few(rng.randint(1, 3), 2)
    return [x for _ in range(rng.randint(1, 6)) for x in (root * 30)[rng.randint(0, 2) :][: rng.randint(1, 50)]]


def test_runs_of_random_sequences():
    rng = random.Random(5)
    for k in range(1200):
        words = sequences(rng, k)
        got = periodic.find_runs(np.array(words, np.int64))
        assert sorted(zip(*(x.tolist() for x in got))) == by_definition(words)


def test_every_short_sequence():
    for n in range(1, 13):
        for bits in range(0, 1 << n, 3):
            words = [bits >> i & 1 for i in range(n)]
            assert sorted(zip(*(x.tolist() for x in periodic.find_runs(np.array(words))))) == by_definition(words)


def test_equal_hashes_of_different_stretches_are_noticed(monkeypatch):
    once, calls = periodic._exact, []
    monkeypatch.setattr(periodic, "_exact", lambda *a: bool(calls.append(1)) or (len(calls) > 1 and once(*a)))
    words = [0, 1, 2, 3, 4, 5] * 4
    assert list(zip(*(x.tolist() for x in periodic.find_runs(np.array(words))))) == [(0, 24, 6)] and len(calls) == 2


def expected(text, least=12):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = sorted((s, e - s, q) for s, e, q in by_definition(words) if e - s >= max(least, 2 * q))
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_detect(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a\x1cb c " * 6, "x y " * 50 + "z", " ".join(map(str, list(range(3000)) * 2)), "é ü " * 9]
    texts += [" ".join(map(str, sequences(rng, k))) for k in range(60)] + [texts[7]]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.detect(docs).collect()}
    assert got == {None if i == 3 else i: expected(t) for i, t in enumerate(texts)}
    assert periodic.detect(docs.limit(0)).count() == 0


def planted(doc_id, text):
    words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
    if h % 10 or not words or doc_id is None:
        return text or ""
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def test_query(spark, small):
    texts = {r.doc_id: planted(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_synchronising_runs(spark, small).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for r in got:
        if len(texts[r.doc_id]) > 12_000:  # the definition takes too long
            continue
        _, runs, collapsed = expected(texts[r.doc_id])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        milli = best[1] * 1000 // best[2] if runs else None
        assert tuple(r)[1:] == (len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed))
        seen += bool(runs)
    assert seen > 10


def test_planting_bears_odd_rows(spark):
    rows = [(i, t) for i in (None, 0, 7, 40, 10**12) for t in (None, "", " \n", "a", "a b  c\td e f g h i j k l")]
    rows += [(i, " ".join(map(str, range(i % 50)))) for i in range(300)]
    got = queries.plant_periods(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, planted(i, t))) for i, t in rows)
    assert any(t != planted(i, t) for i, t in rows)


@pytest.mark.parametrize("n", [1, 5, 4096])
def test_long_periods(n):
    rng = np.random.default_rng(n)
    words = np.concatenate((rng.integers(0, 10**9, 50), np.tile(rng.integers(0, 10**9, n), 4), rng.integers(0, 10**9, 50)))
    assert (50, 50 + 4 * n, n) in set(zip(*(x.tolist() for x in periodic.find_runs(words))))
