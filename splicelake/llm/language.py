"""Language identification by multilingual mixture inference.

Each word is drawn from one of the document's languages.  A word's likelihood
under a language comes from the language's byte n-grams; expectation
maximisation estimates the proportions of languages in the document; and the
set of languages is the one of highest likelihood less a penalty for each
language in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import pieces_of

UNDETERMINED = "und"
#: Documents that the model is fitted on, about: a bounded, seeded sample.
TRAIN_DOCS = 20_000
#: Labels that a model may have: the most frequent ones.
MOST_LABELS = 1000
#: Bytes whose n-grams are looked up at once.
SLICE = 1 << 20
#: Bits of an n-gram's hash, and the lengths of n-grams in bytes.
BITS, ORDERS = 16, (2, 3, 4)
SMOOTHING = 0.1
#: Rounds over all languages and over each candidate set; sizes of sets tried
#: for every text (larger ones as long as the fit rises).
ROUNDS, SET_ROUNDS, MOST_LANGUAGES = 8, 5, 3
#: Overlapping n-grams repeat evidence: their log-likelihoods are divided by this.
TEMPER = 3.0

_LETTER = re.compile(r"[^\W\d_]")
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(raw: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that begin at each byte, for each order."""
    wide = raw.astype(np.uint32)
    found = []
    for n in ORDERS:
        h = np.full(len(wide), n, np.uint32)
        for k in range(n):
            m = max(0, len(wide) - k)
            h[:m] = h[:m] * np.uint32(0x01000193) ^ wide[len(wide) - m :]
        h *= np.uint32(0x9E3779B1)
        found.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return found


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as lower-case letter bytes with single bytes between; where each begins."""
    parts = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    stops = np.cumsum([0, *map(len, parts)])
    return _BYTES[np.frombuffer(b"".join(parts), np.uint8)], stops[:-1]


def fair_share(counts: list[int], total: int) -> float:
    """The largest q for which the sum of min(count, q) is at most total; inf if all counts fit."""
    left = float(total)
    for i, n in enumerate(sorted(counts)):
        q = left / (len(counts) - i)
        if n > q:
            return q
        left -= n
    return float("inf")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (n-gram hash, language), from docs not held out.

    The sample is bounded for each language: small languages are used whole, the
    others share what is left alike.  A language without a training row is left
    out.  Counting is distributed; the model has 2**BITS entries for each language and
    order, whatever the corpus.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = usable.groupBy(F.col("lang").cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS).collect()
    languages = sorted(r["lang"] for r in known)
    if not languages:
        return [], np.zeros((len(ORDERS), 1 << BITS, 0), np.float32)
    fair = fair_share([r["count"] for r in known], train_docs)
    limits = F.create_map(*(F.lit(v) for r in known for v in (r["lang"], int(np.ceil(min(1.0, fair / r["count"]) * (1 << 62))))))
    picked = usable.where(F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("train")), 2) < limits[F.col("lang").cast("string")])
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS), len(languages), 1 << BITS), np.int64)
        for batch in batches:
            for some in pieces_of(batch, "text"):
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    raw, _ = normal([text])
                    for o, h in enumerate(grams(raw)):
                        total[o, place[lang]] += np.bincount(h[raw != 32], minlength=1 << BITS)
        o, lang, h = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"o": o.astype(np.int32), "l": lang.astype(np.int32), "h": h.astype(np.int32), "n": total[o, lang, h]})

    counted = picked.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "o int, l int, h int, n long").groupBy("o", "l", "h").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((len(ORDERS), 1 << BITS, len(languages)))
    table[counted.o, counted.h, counted.l] = counted.n
    seen = table.any(axis=(0, 1))
    languages, table = [x for x, y in zip(languages, seen) if y], table[:, :, seen]
    table += SMOOTHING
    return languages, (np.log(table / table.sum(axis=1, keepdims=True)) / TEMPER).astype(np.float32)


def expect(p: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions (document, language) after some rounds, among allowed languages."""
    w = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = w[doc] * p
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        w = np.add.reduceat(r, starts, axis=0)
        w /= w.sum(axis=1, keepdims=True)
    return w


def infer(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with a letter each: the chosen language, its proportion, all proportions."""
    return judge(texts, table)[:3]


def judge(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``infer`` gives, and the mean log-likelihood of an n-gram under the chosen proportions."""
    raw, at = normal(texts)
    letter = raw != 32
    begins = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    ends = np.flatnonzero(~letter[1:] & letter[:-1]) + 1
    ll = np.zeros((len(begins), table.shape[2]), np.float32)
    cuts = np.append(np.searchsorted(begins, np.arange(0, len(raw), SLICE)), len(begins))
    for a, b in zip(cuts, cuts[1:]):  # slices of whole words, and what their n-grams reach into
        if a < b:
            low, high = begins[a], ends[b - 1]
            bounds = np.empty(2 * (b - a), np.int64)
            bounds[0::2], bounds[1::2] = begins[a:b] - low, ends[a:b] - low
            for o, h in enumerate(grams(raw[low : high + max(ORDERS)])):
                ll[a:b] += np.add.reduceat(table[o][h], bounds, axis=0)[0::2]
    doc = np.searchsorted(at, begins, "right") - 1
    starts = np.searchsorted(doc, np.arange(len(texts)))
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    k = table.shape[2]
    w = expect(p, doc, starts, np.ones((len(texts), k), np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-w, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(len(texts), -np.inf), w
    rising = np.ones(len(texts), bool)
    for size in range(1, k + 1):
        use = np.arange(len(texts)) if size <= MOST_LANGUAGES else np.flatnonzero(rising)
        if not len(use):
            break
        mine = np.isin(doc, use)
        q, d = p[mine], np.searchsorted(use, doc[mine])
        at = np.searchsorted(d, np.arange(len(use)))
        v = expect(q, d, at, (rank[use] < size).astype(np.float32), SET_ROUNDS if size > 1 else 1)
        fit = np.add.reduceat(np.log(np.maximum((v[d] * q).sum(axis=1), 1e-30)), at) - size * np.log(n[use] + 1)
        better = fit > best[use] + 1e-9
        rising[:] = False
        rising[use] = better
        best[use] = np.where(better, fit, best[use])
        if chosen is w:
            chosen = w.copy()
        chosen[use] = np.where(better[:, None], v, chosen[use])
    mean = np.add.reduceat(np.log(np.maximum((chosen[doc] * p).sum(axis=1), 1e-30)) + top[:, 0], starts) * TEMPER
    mean /= len(ORDERS) * np.bincount(doc, weights=ends - begins, minlength=len(texts))
    return chosen.argmax(axis=1), chosen.max(axis=1), chosen, mean


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score and proportions of every whole text.

    ``score`` is the share of the predicted language.  A null text, one without
    a letter or without a word of letter bytes is ``und`` with score 0, and so
    are all texts where nothing can be learned.  Rows are judged one by one and
    whole, n-grams looked up in slices; ties go to the first language by name.
    The MOST_LABELS most frequent labels are learned.  An empty table gives no
    rows.
    """
    languages, table = train(docs, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))  # BITS and the number of languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            for some in pieces_of(batch, "text", 1 << 20):
                texts = some.column(2).to_pylist()
                use = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
                lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                parts: list = [None] * len(texts)
                if use:
                    which, share, every = infer([texts[i] for i in use], model)
                    lang[use], score[use] = np.array(names, object)[which], np.clip(share, 0, 1)
                    for i, row in zip(use, every):
                        parts[i] = [(names[j], float(row[j])) for j in np.flatnonzero(row > 0.005)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(parts, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "proportions"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, least_score: float = 0.4, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs, all columns, whose language is determined with at least this share.

    Texts of any length are judged whole; ties go to the first language by name.
    A text whose n-grams are no likelier in its languages than if all were
    equally frequent is in none of them and goes as well.
    Rows go batch by batch through the model and are never shuffled.
    """
    languages, table = train(docs, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = shared.value
        for batch in batches:
            for some in pieces_of(batch, "text", 1 << 20):
                texts = some.column(some.schema.get_field_index("text")).to_pylist()
                use = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
                keep = np.zeros(len(texts), bool)
                if use:
                    _, share, _, mean = judge([texts[i] for i in use], model)
                    keep[use] = (share >= least_score) & (mean > -BITS * np.log(2))
                yield some.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
