"""Alignment of two tokenizers against brute force over token offsets, and the monoid's laws."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from splicelake.llm import fragments, queries
from splicelake.llm.fragments import BEGIN, Fragment, Tokens, compose

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, n_a string, pairs int"
ODD = [None, "", " ", "   ", "a", "x▁y", "don't  stop\n\n  it's", "naïve café　ab cd  e", "中文，字。" * 20, "<|endoftext|> </s> <0x41>", "a\tb\r\n c", "😀 x😀é", "12ab34,'s'", "\x00 \x1c b", " \x85 c", "two", "two"]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    """The character that stands for each byte in a byte-level vocabulary, backwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def spans(text, tokenizers):
    """(id, begin, end) of both sides' tokens; none where the bytes differ from the text's."""
    a, b = tokenizers
    whole = (" " + (text or "")).encode()
    sides = [[(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]] if text else [[]]
    sides.append([(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]])
    if not text or any(b"".join(x for _, x in s) != whole for s in sides):
        return [], []
    out = []
    for s in sides:
        at, got = 0, []
        for i, x in s:
            got.append((i, at, at := at + len(x)))
        out.append(got)
    return out


def brute(texts, tokenizers):
    """Rows of the contract, by comparing every token with every other."""
    both = [spans(t, tokenizers) for t in texts]
    links = [[(i, j) for i, s, e in a for j, u, v in b if s < v and u < e] for a, b in both]
    held = collections.Counter(p for some in links for p in set(some))
    best = collections.defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    rows = []
    for (a, b), some in zip(both, links):
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        ids = lambda side, lo, hi: ",".join(str(i) for i, s, e in side if lo < e <= hi)
        groups = ";".join(f"{ids(a, lo, hi)}|{ids(b, lo, hi)}" for lo, hi in zip([0, *ends], ends))
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(ends), len(some), sha, sum(held[p] == best[p[0]] for p in some), sum(held[p] for p in some)))
    return rows


def random_tokens(rng, n):
    ends = [sorted({*rng.sample(range(1, n), rng.randint(0, min(n - 1, k))), n}) for k in (n, n // 2)]
    return Tokens(*(np.array(x, np.int64) for side in ends for x in ([rng.randrange(50) for _ in side], side)))


def cut_up(rng, tokens, n):
    """Neighbouring stretches of tokens: A and B need not be cut at the same byte."""
    marks = sorted(rng.randrange(n + 1) for _ in range(rng.randint(0, 6)))
    at = (0, 0)
    for m in [*marks, n]:
        nxt = [int(np.searchsorted(e, m + rng.randint(0, 3), "right")) if m < n else len(e) for e in (tokens.a_ends, tokens.b_ends)]
        nxt = [max(x, y) for x, y in zip(nxt, at)]
        yield Tokens(tokens.a[at[0] : nxt[0]], tokens.a_ends[at[0] : nxt[0]], tokens.b[at[1] : nxt[1]], tokens.b_ends[at[1] : nxt[1]])
        at = tuple(nxt)


def fold(rng, parts, closed):
    """Compose neighbours in any order."""
    parts = list(parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        got, c = compose(parts[i], parts[i + 1])
        closed += [c] if c else []
        parts[i : i + 2] = [got]
    return parts[0]


def test_fragments_compose_in_any_order():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(2, 40)
        tokens = random_tokens(rng, n)
        want = compose(BEGIN, Fragment(tokens))
        assert want[0].cut == n
        ends = tokens.shared().tolist()
        pieces, closed = list(cut_up(rng, tokens, n)), []
        leaves = []
        for p in pieces:
            f, c = fragments.fragment(p)
            closed += [c] if c else []
            leaves.append(f)
        got = fold(rng, [BEGIN, *leaves], closed)
        assert got.cut == n and not len(got.suffix.a) and not len(got.suffix.b) and not len(got.prefix.a)
        closed.sort(key=lambda c: c.start)
        assert [c.start for c in closed] == [0, *(int(c.tokens.a_ends[-1]) for c in closed[:-1])]
        for c in closed:
            assert c.tokens.a_ends[-1] == c.tokens.b_ends[-1] in ends
        for k, column in enumerate(tokens):
            assert np.concatenate([c.tokens[k] for c in closed]).tolist() == column.tolist()


def texts_of(rng):
    alphabets = ["abc def, ", "the rain in Spain's plain ", "中文，。字 ", "éüß ñ", "012 ab34.", "{}();=\n\t  x", "a   b", "  x"]
    return ["".join(rng.choice(rng.choice(alphabets) if rng.random() < 0.2 else alphabets[k % 8]) for _ in range(rng.randint(0, 150))) for k in range(60)]


def test_rows_against_brute_force(spark, tokenizers):
    texts = ODD + texts_of(random.Random(6))
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    want = sorted(map(repr, zip((None if i == 4 else i // 2 for i in range(len(texts))), brute(texts, tokenizers))))
    for settings in ({}, {"range_bytes": 16, "fan": 2}, {"range_bytes": 7, "fan": 3, "slice_pairs": 100}):
        got = fragments.align(docs, A, B, **settings).collect()
        assert sorted(repr((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum))) for r in got) == want
    assert fragments.align(docs.limit(0), A, B).count() == 0


def test_one_very_long_text(spark, tokenizers):
    rng = random.Random(8)
    text = "".join(t for _ in range(12) for t in texts_of(rng)) + "x" * 5000 + "文" * 3000
    docs = spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")
    got = {r.doc_id: r for r in fragments.align(docs, A, B, range_bytes=999, fan=4).collect()}
    whole = {r.doc_id: r for r in fragments.align(docs, A, B, range_bytes=1 << 30).collect()}
    assert got == whole
    a, b = spans(text, tokenizers)
    assert (got[1].n_a, got[1].n_b, got[1].n_groups) == (len(a), len(b), len({e for *_, e in a} & {e for *_, e in b}))


def test_query(spark, small, tokenizers):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_fragment_alignment(spark, small).collect()}
    assert len(got) == len(rows)
    held, links, best = collections.Counter(), {}, collections.defaultdict(int)
    for r in rows:
        a, b = spans(r.text, tokenizers)
        some, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                some.append((i, b[k][0]))
                k += 1
        links[r.doc_id] = some
        held.update(set(some))
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for d, some in links.items():
        assert (got[d].n_links, got[d].n_best, got[d].count_sum) == (len(some), sum(held[p] == best[p[0]] for p in some), sum(held[p] for p in some))
