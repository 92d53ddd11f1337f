"""Operators on documents against brute force, with the odd rows every operator must bear."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from splicelake.llm import html_text, language, licenses, mixing, packing, quality, queries, records, simhash, suffixes, tokens
from splicelake.llm._runtime import new_path
from splicelake.operators.components import components

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, sequence_id string, `odd name` int"
LONG = "Word" * 10 + " it's " + "abc def, ghi. " * 4000


def make(spark, texts, schema=SCHEMA):
    data = [(i, t, ("en", "fr", None)[i % 3] if i is not None else None, ("a", "b", None)[i % 3] if i is not None else None, len(t or ""), "x", "y", "z", 1) for i, t in texts]
    return spark.createDataFrame(data, schema)


ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "One two three."), (3, "One two three."), (4, "one TWO three."), (5, LONG), (6, "Ünïcode ŁÓDŹ 中文 ’s <|endoftext|>"), (7, "a\x1cb c d"), (8, "x" * 300)]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


# tokens, packing, records


def check_packing(rows, texts, ids):
    want = collections.Counter()
    for i, t in texts:
        e = ids(t)
        for k, at in enumerate(range(0, len(e), 4096)):
            want[i, k, at, len(e[at : at + 4096]), zlib.crc32(e[at : at + 4096].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_packing(docs, texts, ids):
    rows = packing.pack(docs, PATH).collect()
    assert check_packing(rows, texts, ids) == -(-sum(r.length for r in rows) // 4096)


def test_packing_odd_rows(odd, empty, ids):
    check_packing(packing.pack(odd, PATH).collect(), ODD, ids)
    assert packing.pack(empty, PATH).count() == 0


def test_packed_ids_are_the_pieces(odd, ids):
    for r in packing.pack(odd, PATH, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([10, 50, 100]))
    hist = collections.Counter(rng.integers(1, cap + 1, int(rng.integers(1, 14))).tolist())
    plan = packing.plan_bins(dict(hist), cap)
    used = collections.Counter()
    for items, n in plan:
        assert sum(a * b for a, b in items) <= cap
        for a, b in items:
            used[a] += b * n
    assert used == hist

    def optimal(items, bins):
        if not items:
            return len(bins)
        best = 99
        for i in range(len(bins)):
            if bins[i] >= items[0]:
                best = min(best, optimal(items[1:], bins[:i] + [bins[i] - items[0]] + bins[i + 1 :]))
        return min(best, optimal(items[1:], [*bins, cap - items[0]])) if len(bins) < 6 else best

    if sum(hist.values()) <= 7:
        assert sum(n for _, n in plan) == optimal(sorted(hist.elements(), reverse=True), [])


def test_plan_of_large_counts():
    plan = packing.plan_bins({3000: 10**9, 1000: 10**9, 96: 10**9, 4096: 5}, 4096)
    assert sum(n for _, n in plan) == 10**9 + 5


def test_plan_beats_best_fit_where_few_pieces_fit_a_bin():
    counts = collections.Counter(np.random.default_rng(0).integers(900, 2100, 5000).tolist())
    plan = packing.plan_bins(counts, 4096)
    packed = collections.Counter()
    for items, bins in plan:
        assert sum(x * n for x, n in items) <= 4096
        for x, n in items:
            packed[x] += n * bins
    assert packed == counts
    assert sum(n for _, n in plan) < 0.97 * sum(n for _, n in packing.best_fit(counts, 4096))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_records(which, request, texts, ids):
    df, want = request.getfixturevalue(which), ODD if which == "odd" else texts
    rows = sorted(records.encode_and_read_back(df, PATH).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(rows, sorted(want, key=lambda x: x[0]), strict=True):
        e = ids(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(e), zlib.crc32(e.tobytes()))
        at += len(e)


def test_records_index_and_damage(spark, odd, empty, ids):
    folder = new_path(spark, "rec")
    records.write_records(odd, folder, PATH, shard_bytes=20_000)
    index = records.read_index(spark, folder).collect()
    back = {(r.shard, r.frame_offset): r for r in records.read_records(spark, folder).collect()}
    assert len(index) == len(ODD) == len(back)
    import pyarrow.fs as pafs

    fs, base = records.open_fs(folder)
    for r in index:
        data = fs.open_input_file(f"{base}/part-{r.shard:06d}.rec").read()
        i, got, after = records.unframe(memoryview(data), r.frame_offset)
        assert (i, len(got), after - r.frame_offset) == (r.doc_id, r.n_tokens, r.frame_bytes)
        assert got.tolist() == back[r.shard, r.frame_offset].ids
    broken = bytearray(data)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(memoryview(bytes(broken)), 0)
    assert isinstance(fs, pafs.FileSystem)
    assert records.encode_and_read_back(empty, PATH).count() == 0
    assert records.unframe(memoryview(records.frame(None, np.array([70000, 1], "<u4"))), 0)[:2][0] is None


def test_shuffled_reads_go_through_the_index(spark, odd, ids):
    folder = new_path(spark, "rec")
    records.write_records(odd, folder, PATH, shard_bytes=20_000)
    runs = [[(r.part, r.place, r.doc_id, r.ids) for r in records.read_shuffled(spark, folder, seed, 3).collect()] for seed in (1, 1, 2)]
    assert sorted(runs[0], key=repr) == sorted(runs[1], key=repr)
    want = sorted(((i, ids(t).tolist()) for i, t in ODD), key=repr)
    for run in runs:
        assert sorted(((i, x) for _, _, i, x in run), key=repr) == want
    assert [x[2] for x in sorted(runs[0])] != [x[2] for x in sorted(runs[2])]


def same_ids(encoder, texts, library):
    ids, stops = encoder.encode(texts)
    for i, t in enumerate(texts):
        assert ids[stops[i] : stops[i + 1]].tolist() == library(t)[:-1].tolist(), repr(t)


def test_word_encoder_equals_the_library(ids):
    some = ["it's we'll ab'cd 12a3", "é́ x", "ΣΑΣ ΑΣ İ ẞ", "don't!! foo.,bar", "a b  c", "<|ENDOFTEXT|> <|endoftext|>a", "中文字 ガ", None, "a_b 1st x2y", "", "İ[ İ'll İ? क़, H̱ ̸≠"]
    same_ids(tokens.WordEncoder(PATH, generation=10), some, ids)
    for t in some:
        same_ids(tokens.WordEncoder(PATH), [t], ids)


def test_word_encoder_on_random_texts(ids):
    """100,000 short texts over Latin, Greek, Cyrillic, marks, controls, white space and special tokens."""
    rng = np.random.default_rng(17)
    kinds = [range(0x20, 0x7F), range(0x61, 0x7B), range(0xA0, 0x250), range(0x250, 0x3A0), range(0x3A0, 0x530), range(0x300, 0x370), range(0x00, 0x21), range(0x900, 0x980), range(0x1E00, 0x2070), range(0xFB00, 0xFB50), range(0x1F600, 0x1F640)]
    symbols = [[chr(c) for c in k] for k in kinds] + [["<|endoftext|>", "<|startoftext|>", "<|", "|>", "'ll", "'s", " ", ".", ",", "İ", "ſ"]]
    encoder = tokens.WordEncoder(PATH, generation=2000)
    for _ in range(100):
        batch = []
        for _ in range(1000):
            kind = rng.integers(0, len(symbols), rng.integers(1, 4))
            batch.append("".join(str(rng.choice(symbols[k])) for k in rng.choice(kind, rng.integers(1, 9))))
        library = encoder.tokenizer.encode_batch(batch, add_special_tokens=False)
        found, stops = encoder.encode(batch)
        for i, (t, e) in enumerate(zip(batch, library)):
            assert found[stops[i] : stops[i + 1]].tolist() == e.ids, repr(t)


def test_very_long_texts_are_encoded_in_slices(ids, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE", 400)
    texts = ["word, é ß " * 300, None, "x" * 1000 + " y", "short", "中 " * 500]
    same_ids(tokens.WordEncoder(PATH), texts, ids)


# mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = share * sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(out.values())) / max(1e-300, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if level * w[s] >= epochs * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = epochs * sizes[s]
            free.discard(s)


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    sizes, got, target, where = collections.Counter(), collections.Counter(), {}, {r.doc_id: r for r in docs.collect()}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", where[r.doc_id].text)) and r.taken <= 2 * r.size
        s = where[r.doc_id].source
        sizes[s] += r.size
        got[s] += r.taken
        target[s] = r.target
    want = brute_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) for s in want)
    most = {s: max(r.size for r in rows if where[r.doc_id].source == s) for s in want}
    assert all(abs(got[s] - want[s]) <= most[s] / 2 + 1 for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(empty).count() == 0
    repeated = mixing.repeat(odd)
    assert repeated.columns == odd.columns
    assert repeated.count() == sum(r.copies for r in rows)


# quality, licenses


def test_quality(docs, texts, odd, empty):
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(windows)
        covered = {k + j for k, g in enumerate(windows) if n[g] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    rows = quality.score(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 10)
    assert quality.score(empty).count() == 0


def test_compression_bands():
    judge = quality.Compression()
    rng = np.random.default_rng(0)
    noise = bytes(rng.integers(33, 127, 8000, dtype=np.uint8))
    words = [bytes(rng.integers(97, 110, int(k), dtype=np.uint8)) for k in rng.integers(2, 9, 900)]
    prose = b" ".join(words[k] for k in rng.integers(0, 900, 2500))
    assert judge.verdict(noise)[3] == "incompressible"
    assert judge.verdict(b"all the same again " * 300)[3] == "repetitive"
    assert judge.verdict(prose)[3] == "" and judge.verdict(b"")[3] == "" and judge.verdict(b"short")[3] == ""
    assert judge.verdict(prose[:6000] + b"the very same line " * 300)[3] != ""


def test_licenses(docs, texts, odd, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        at = [(k, label) for phrase, label in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


LICENSE_CASES = {
    "Licensed under the GNU General Public License, version 2 or later.": "gpl,gpl-2.0",
    "the GNU Lesser General Public License v2.1": "lgpl-2.1",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
    "SPDX-License-Identifier: LicenseRef-Foo": "unknown",
    "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
    "see https://www.apache.org/licenses/LICENSE-2.0.html": "apache-2.0",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "This is not licensed under the GPL. It is not licensed under the MIT License": "gpl,mit,not-gpl",
    "All rights reserved.": "all-rights-reserved",
    "do as you like: the beerware license": "beerware",
    "plain prose about permits": "",
    "": "",
}


def test_license_rules():
    every = licenses.rules()
    assert len(every) > 300 and [r.priority for r in every] == sorted((r.priority for r in every), reverse=True)
    for text, labels in LICENSE_CASES.items():
        found = set(filter(None, licenses.scan_text(text.encode())[5].split(",")))
        assert set(filter(None, labels.split(","))) - {"gpl", "mit"} <= found and (labels or not found), (text, found)
    assert licenses.scan_text(b"SPDX-License-Identifier: BSD-3-Clause")[5] == "bsd-3-clause"


def test_a_rule_never_matches_without_its_keywords():
    for text in LICENSE_CASES:
        spaced = b" " + b" ".join(text.lower().encode().translate(licenses._TABLE).split()) + b" "
        words = set(spaced.decode().split())
        for rule in licenses.rules():
            assert not rule.pattern.search(spaced) or words & set(rule.keywords), (text, rule.label)


@pytest.mark.parametrize("seed", range(20))
def test_suppression_equals_pairwise_tests(seed):
    rng = np.random.default_rng(seed)
    every = licenses.rules()
    begin = rng.integers(0, 60, 80)
    found = [(int(b), int(b + n), int(r)) for b, n, r in zip(begin, rng.integers(1, 20, 80), rng.integers(0, len(every), 80))]
    kept = []
    for d in sorted(found, key=lambda f: (-every[f[2]].priority, f[0] - f[1], f[2], f[0])):
        if not any((b <= d[0] and d[1] <= e) or (d[0] <= b and e <= d[1]) for b, e, _ in kept):
            kept.append(d)
    assert licenses.suppress(found) == sorted(kept)


def test_licenses_of_a_long_text():
    n = 200_000
    words, places, first, last, base, labels, score, spans = licenses.scan_text(b"mit license foo " * n)
    assert (words, places, first, last, base, len(spans)) == (3 * n, n, 0, 3 * n - 3, "mit", n)
    assert spans[-1] == {"label": "mit", "first_word": 3 * n - 3, "n_words": 2}


# language


def test_language(docs, odd, empty, spark):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    far = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in far]) > 0.95
    assert language.identify(empty).count() == 0
    got = language.identify(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()


def plain_mixture(text, table):
    """Expectation maximisation and the choice of a set, word by word in plain Python."""
    raw = language.normal([text])[0]
    hashes = language.grams(raw)
    words, at = [], 0
    while at < len(raw):
        if raw[at] == 32:
            at += 1
            continue
        stop = at
        while stop < len(raw) and raw[stop] != 32:
            stop += 1
        words.append([sum(float(table[o][h[i]][k]) for o, h in enumerate(hashes) for i in range(at, stop)) for k in range(table.shape[2])])
        at = stop
    p = [[np.exp(x - max(w)) for x in w] for w in words]

    def expect(allowed, rounds):
        w = [a / sum(allowed) for a in allowed]
        for _ in range(rounds):
            share = [0.0] * len(w)
            for row in p:
                mass = [a * b for a, b in zip(w, row)]
                share = [s + m / sum(mass) for s, m in zip(share, mass)]
            w = [s / sum(share) for s in share]
        return w

    k = table.shape[2]
    rank = sorted(range(k), key=lambda i, w=expect([1] * k, language.ROUNDS): (-w[i], i))
    best, chosen = -np.inf, None
    rising = True
    for size in range(1, k + 1):
        if size > language.MOST_LANGUAGES and not rising:
            break
        w = expect([1.0 if i in rank[:size] else 0.0 for i in range(k)], language.SET_ROUNDS if size > 1 else 1)
        fit = sum(np.log(sum(a * b for a, b in zip(w, row))) for row in p) - size * np.log(len(p) + 1)
        rising = fit > best + 1e-9
        if rising:
            best, chosen = fit, w
    return chosen


def test_mixture_equals_plain_python(docs, texts, monkeypatch):
    names, table = language.train(docs)
    some = [t for _, t in texts if t and language.has_letter(t)]
    some = [t[:1500] for t in some[:25]] + [some[3][:300] + " " + some[40][:400] + " " + some[41][:300]]
    every = language.infer(some, table)[2]
    for t, row in zip(some, every):
        assert np.allclose(row, plain_mixture(t, table), atol=2e-3), t[:60]
    monkeypatch.setattr(language, "SLICE", 64)
    assert np.allclose(language.infer(some, table)[2], every, atol=1e-5)


def test_mixture_finds_both_languages(spark, docs):
    parts = {r.lang: r.text for r in docs.where("length(text) > 3000").collect() if "###" not in r.text}
    both = spark.createDataFrame([(10**6 + 6, parts["en"][:2000] + " " + parts["de"][:2000], "en")], "doc_id long, text string, lang string")
    row = language.identify(docs.select("doc_id", "text", "lang").unionByName(both)).where("doc_id > 1000000").first()
    assert row.proportions.get("en", 0) > 0.2 and row.proportions.get("de", 0) > 0.2


# simhash


def invented(rng, letters, words):
    return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(words))


def test_small_languages_are_learned(spark):
    """A hot language takes no training rows from a small one, and the sample stays bounded."""
    rng = np.random.default_rng(3)
    rows = [(i, invented(rng, "abcde", 30), "hot") for i in range(2000)] + [(5000 + i, invented(rng, "vwxyz", 30), "small") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    languages, table = language.train(df, 40)
    assert languages == ["hot", "small"] and (table.max(axis=1) > table.min(axis=1)).all()
    got = collections.Counter(r.lang_pred for r in language.identify(df, 40).where("doc_id >= 5000").collect())
    assert got == {"small": 12}
    assert language.fair_share([2, 100, 100], 12) == 5 and language.fair_share([3, 4], 7) == float("inf")
    alien = spark.createDataFrame([(9999, invented(rng, "mnopq", 30), "hot")], df.schema)
    kept = {r.doc_id for r in language.keep_identified(df.unionByName(alien.withColumn("lang", F.lit(None).cast("string"))), train_docs=40).where("doc_id < 10 or doc_id >= 5000").collect()}
    assert {i for i, _, _ in rows if i < 10 or i >= 5000} == kept


def test_more_than_three_languages_in_one_text(spark):
    rng = np.random.default_rng(6)
    letters = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    rows = [(10 * i + j, invented(rng, a, 60), a) for j, a in enumerate(letters) for i in range(40)]
    _, table = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    _, share, every = language.infer([" ".join(invented(rng, a, 40) for a in letters)], table)
    assert (every[0] > 0.1).sum() == 5 and share[0] < 0.3


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, names):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)), key=lambda k: names[k])
                root[b] = a
    return [min(names[j] for j in range(len(fps)) if find(j) == find(i)) for i in range(len(fps))]


def test_simhash(docs, texts):
    fps = [brute_fingerprint(t) for _, t in texts]
    want = dict(zip([i for i, _ in texts], zip(fps, brute_components(fps, [i for i, _ in texts]))))
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == want and len(got) == len(texts)


def test_simhash_odd_rows(odd, empty):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[0].fp == got[1].fp == got[2].fp == 0 and got[1].component_id == got[2].component_id == 0
    assert got[4].component_id == 3
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 4 not in ids and ids.count(0) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("crowded", [simhash.CROWDED_SHARD, 20])
def test_trees_lose_no_pair(spark, crowded):
    """Also where shards are so crowded that they are compared in pairs of blocks."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 5)), replace=False)) for b in base[:400]]
    fps = list(dict.fromkeys([*map(int, base), *near]))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_rows=60, crowded=crowded)
    found = {r.node: r.component for r in components(edges).collect()}
    root = dict(zip(signed, brute_components(fps, signed)))
    groups = collections.defaultdict(set)
    for x in signed:
        groups[root[x]].add(x)
    for g in groups.values():
        assert len({found.get(x, x) for x in g}) == 1
    assert len({found.get(x, x) for x in signed}) == len(groups)


# suffixes


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, m in zip(raw, cover) if not m)
        runs = sum(1 for i, m in enumerate(cover) if m and not (i and cover[i - 1]))
        out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_repeats(docs, texts):
    want = dict(zip([i for i, _ in texts], brute_repeats([t for _, t in texts], 100)))
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.mark(docs.select("doc_id", "text")).collect()} == want


def test_suffix_repeats_odd_rows(spark, empty):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(c) for c in rng.choice([97, 98, 233, 0x4E2D], n))
    shared = noise(260)
    texts = [None, "", shared, "x" * 700, noise(50) + shared[20:200] + noise(90), shared, "ab" * 400, noise(130) + shared[:110] + shared[90:] + noise(10), "x" * 100, "y" * 99]
    df = make(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.mark(df, keep_text=True).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 100)))
    out = suffixes.mark(df, keep_text=True).where("doc_id = 0").first()
    assert out.text is None and out.fp == "x"
    assert suffixes.mark(empty).count() == 0
    same = make(spark, [(1, shared), (1, shared), (None, shared)])
    assert sorted(r.n_removed for r in suffixes.mark(same).collect()) == [0, len(shared.encode()), len(shared.encode())]


def test_suffix_repeats_crowded_anchors(spark, docs, texts):
    """Pieces of one anchor that differ all: windows dealt by digest give the same repeats."""
    rng = np.random.default_rng(8)
    noise = lambda n: "".join(chr(c) for c in rng.choice(np.arange(97, 123), n))
    shared = noise(330)
    some = [noise(150) + shared + noise(150) for _ in range(60)] + [noise(120) + shared[:140] + noise(99), shared[30:] * 2, "x" * 400, None]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.mark(make(spark, list(enumerate(some))).select("doc_id", "text"), crowded=20).collect()}
    assert got == dict(enumerate(brute_repeats(some, 100)))
    want = dict(zip([i for i, _ in texts], brute_repeats([t for _, t in texts], 100)))
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.mark(docs.select("doc_id", "text"), crowded=1).collect()} == want


@pytest.mark.parametrize("stretch", [None, 1, 3, 50])
def test_column_wise_order(tmp_path, monkeypatch, stretch):
    """In memory, and in sequential files read in stretches of a few entries."""
    if stretch:
        monkeypatch.setattr(suffixes, "CHUNK", stretch)
    rng = np.random.default_rng(1)
    for turn in range(30 if not stretch else 12):
        strings = [bytes(rng.choice([0, 97, 98], int(n)).astype(np.uint8)) for n in rng.integers(0, 12, int(rng.integers(1, 9)))]
        strings += strings[:2]  # equal strings
        string, suffix, lcp = suffixes.column_wise(strings, f"{tmp_path}/{turn}" if stretch else None)
        got = [strings[i][len(strings[i]) - k :] for i, k in zip(string, suffix)]
        assert got == sorted(got) and len(set(zip(string.tolist(), suffix.tolist()))) == sum(len(s) + 1 for s in strings)
        for a, b, n in zip(got, got[1:], lcp[1:]):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    assert not list(tmp_path.iterdir())


def test_files_and_arrays_agree_on_long_strings(tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    base = bytes(rng.integers(97, 101, 400).astype(np.uint8))
    strings = [base[i : i + 300] for i in range(0, 100, 9)] + [bytes(rng.integers(0, 250, int(n)).astype(np.uint8)) for n in rng.integers(1, 300, 40)]
    want = suffixes.column_wise(strings)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    for x, y in zip(want, suffixes.column_wise(strings, f"{tmp_path}/files")):
        assert (x == y).all()


def test_window_classes_in_few_rounds(tmp_path, monkeypatch):
    """Equal windows make a class, at every width of symbol and with zeros in texts; pieces of 160 bytes take 40 rounds."""
    rounds, plain = [], suffixes._rounds

    def counted(symbols, last, sizes, step=1):
        rounds.append(int(sizes.max()))
        return plain(symbols, last, sizes, step)

    monkeypatch.setattr(suffixes, "_rounds", counted)
    rng = np.random.default_rng(14)
    for turn in range(60):
        length = turn % 12 + 1
        strings = [bytes(rng.choice([0, 97, 98], int(n), p=[0.2, 0.7, 0.1]).astype(np.uint8)) for n in rng.integers(1, 40, int(rng.integers(2, 9)))]
        want = collections.defaultdict(set)
        for i, s in enumerate(strings):
            for k in range(length, len(s) + 1):
                want[s[len(s) - k :][:length]].add((i, k))
        for folder in (None, f"{tmp_path}/{turn}") if turn % 6 == 0 else (None,):
            got = collections.defaultdict(set)
            for i, k, c in zip(*(x.tolist() for x in suffixes.window_classes(strings, length, folder))):
                got[c].add((i, k))
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    suffixes.window_classes([b"ab" * 80, b"ba" * 79], 100)
    assert rounds[-1] == 40


def test_suffix_repeats_with_files(spark, texts):
    some = [t for _, t in texts[:60]]
    df = make(spark, list(enumerate(some)))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.mark(df.select("doc_id", "text"), sort_bytes=1000).collect()}
    assert got == dict(enumerate(brute_repeats(some, 100)))


# pages


def test_html_layout(spark):
    page = """<title>A &amp; b</title><style>p{}</style><h1>Big  head</h1><p>One <b>two</b>
    three<p>Four<br>five &lt;x&gt;<span style="display: none">no</span><i hidden>no</i>
    <ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>after<table><tr><th>Name<th>N<tr><td>apple pie<td>1</table><pre>  keep
    this</pre><script>var t = "</p>";</script></div>end"""
    title, text = html_text.extract(page)
    assert title == "A & b"
    assert text == "Big head\n\nOne two three\n\nFour\nfive <x>\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nafter\n\nName       N\napple pie  1\n\n  keep\n    this\n\nend"
    for bad in (None, "", "<", "<p", "</", "a<b", "<table><td>x", "</p></ul></table>x", "<!--", "<li>x</li></ul>", "<td>x</td><tr>", "<div>" * 5000 + "z"):
        html_text.extract(bad)
    df = spark.createDataFrame([(1, None, "u"), (2, page, "u"), (2, page, "u")], "page_id long, html string, title string")
    rows = html_text.render(df).orderBy("page_id").collect()
    assert [r.n_chars for r in rows] == [0, len(text), len(text)] and rows[0].text == ""
    assert html_text.render(df.limit(0)).count() == 0


HTML_CASES = [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td>a<td rowspan=0>B<tr><td>c<tr><td>d<td>e</table>", "a  B\nc\nd     e"),
    ("<table><tr><td colspan=1000>wide<td>z<tr><td>q</table>", "wide  z\nq"),
    ("<table><tr><td colspan=2>long title<tr><td>a<td>b</table>", "long title\na  b"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
    ("<style>/* .y{} */ .x, h5{display:none} p.q{display:none}</style><p class='a x'>no<p class=q>q<h5>no</h5>", "q"),
    ("<noscript>plain</noscript><math><mi>x</mi></math><object>text</object><svg><desc>no</desc><text>t</text></svg>", "plainxtextt"),
    ("<p>a<div>b</p>c", "a\n\nb\n\nc"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("a<br><br>b<hr>c", "a\n\nb\n---\nc"),
    ("<ol><li value=7>a<li>b</ol>", "7. a\n8. b"),
]


@pytest.mark.parametrize("page, text", HTML_CASES)
def test_html_cases(page, text):
    assert html_text.extract(page)[1] == text


@pytest.mark.parametrize("seed", range(30))
def test_table_places_equal_an_occupancy_grid(seed):
    rng = np.random.default_rng(seed)
    table = html_text.Table()
    table.rows = [[(f"{y}-{i}", int(rng.integers(1, 4)), int(rng.integers(1, 4))) for i in range(rng.integers(0, 5))] for y in range(6)]
    taken, place = set(), {}
    for y, row in enumerate(table.rows):
        x = 0
        for text, columns, down in row:
            while (x, y) in taken:
                x += 1
            place[text] = (x, x + columns)
            taken |= {(a, b) for a in range(x, x + columns) for b in range(y, y + down)}
            x += columns
    first = sorted({a for a, _ in place.values()})
    for cells in table._grid():
        for a, b, (text,) in cells:
            x, after = place[text]
            assert first[a] == x and b == max(a + 1, sum(f < after for f in first))


def test_html_of_a_long_deep_page():
    page = "<ul>" + "<li>item <b>bold</b> &amp; more</li>" * 100_000 + "</ul>" + "<p><table><tr><td>" + "<div>" * 20_000 + "x"
    text = html_text.extract(page)[1]
    assert text.count("- item bold & more") == 100_000 and text.endswith("\n\nx")


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
