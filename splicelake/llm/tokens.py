"""Token ids of whole texts.

A tokenizer whose normalizer and pre-tokenizer never look across ASCII white
space encodes the words of a text one by one, so that a batch needs the ids of
its distinct words only: Arrow splits and numbers the words, each distinct one
is encoded once, and numpy puts the ids of the texts together.

Most words are a run of plain letters, perhaps followed by ASCII punctuation.
Which letters are plain is asked of the tokenizer itself: those that its
normalizer leaves as they are and its pre-tokenizer joins with each other.
Such a run goes straight to the tokenizer's model; all else goes through the
whole tokenizer.  A tokenizer that looks across white space encodes whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Words of a generation of a worker's table; it holds two generations at most.
GENERATION = 100_000
#: Bytes of a text from which it is encoded in slices cut at white space.
SLICE = 8 << 20

#: Texts that are not lower-cased before words are numbered: beyond U+00FF the
#: order of lower-casing and composing counts, and special tokens have a case.
_AS_IT_IS = r"[^\x00-\xff]|<\|"
_PROBES = ("ab cd", "ab, cd.", "A\tB\n\nab'll 12", "é à", "<|ab cd|>", " ab ")
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts; exactly those of the tokenizer without special tokens added."""

    def __init__(self, path: str, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.generation = generation
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.by_words = all(self._ids(p) == [i for w in re.findall(r"[^\x20\x09-\x0D]+", p) for i in self._ids(w)] for p in _PROBES)
        self.lowers = self._ids("Ab É") == self._ids("ab é") and self._ids("aB") == self._ids("ab")
        self._find_letters()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _alone(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def _find_letters(self) -> None:
        """Plain letters of Latin scripts, and how the model spells each."""
        t, letters = self.tokenizer, {}
        if t.normalizer and t.pre_tokenizer:
            for c in map(chr, range(0x61, 0x250)):
                if c.isalpha() and t.normalizer.normalize_str(c) == c:
                    parts = t.pre_tokenizer.pre_tokenize_str(c + c + ",a")
                    if len(parts) == 3:
                        letters[c] = parts[0][0][: len(parts[0][0]) // 2]
        self.spelled = str.maketrans({c: s for c, s in letters.items() if c != s})
        every = "".join(letters)
        direct = every and all(self._direct(every[i : i + 7]) == self._alone(every[i : i + 7]) for i in range(0, len(every), 7))
        self.plain = re.compile(f"([{every}]+)([!-@\\[-`{{-~].*)?", re.S) if direct else None

    def _direct(self, letters: str) -> bytes:
        ids = [x.id for x in self.tokenizer.model.tokenize(letters.translate(self.spelled))]
        return np.array(ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        out, width, rests = [], self.kind.itemsize, {}
        tokenize, spelled = self.tokenizer.model.tokenize, self.spelled
        for word in words:
            m = self.plain.fullmatch(word) if self.plain and "<|" not in word else None
            if m is None:
                out.append(self._alone(word))
                continue
            head, rest = m.groups()
            if not head.isascii():
                head = head.translate(spelled)
            ids = b"".join([x.id.to_bytes(width, "little") for x in tokenize(head)])
            if rest:
                if rest not in rests:
                    rests[rest] = self._alone(rest)
                ids += rests[rest]
            out.append(ids)
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, through the two generations of the table."""
        young, old, new = self.young, self.old, []
        found = list(map(young.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if (ids := old.get(word)) is None:
                    new.append(i)
                else:
                    found[i] = young[word] = ids
        for i, ids in zip(new, self._learn([words[i] for i in new])):
            found[i] = young[words[i]] = ids
        if len(young) > self.generation:
            self.young, self.old = {}, young
        return found

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._ids(t) for t in texts.to_pylist()]
        return np.array([i for some in ids for i in some], self.kind), np.cumsum([0, *map(len, ids)])

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text begins in it (and the end); null counts as empty."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            return self._whole(texts)
        sizes = pc.binary_length(texts).to_numpy()
        if len(texts) and sizes.max() > SLICE:
            return self._sliced(texts.to_pylist())
        if self.lowers:
            texts = pc.if_else(pc.match_substring_regex(texts, _AS_IT_IS), texts, pc.utf8_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        found = self._known(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.kind.itemsize
        at, number = np.cumsum(size, dtype=np.int32) - size, words.indices.to_numpy()
        n = size[number]
        stops = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        place = np.arange(stops[-1], dtype=np.int32)  # SLICE bounds the ids of a call
        place += np.repeat(at[number] - stops[:-1].astype(np.int32), n)
        return flat[place], stops[split.offsets.to_numpy() - split.offsets[0].as_py()]

    def _sliced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, for batches with very long texts."""
        parts, stops = [np.zeros(0, self.kind)], [0]
        for text in texts:
            n = 0
            for part in _slices(text):
                ids = self.encode([part])[0] if len(part.encode()) <= SLICE else np.frombuffer(self._alone(part), self.kind)
                parts.append(ids)
                n += len(ids)
            stops.append(stops[-1] + n)
        return np.concatenate(parts), np.array(stops)


def _slices(text: str) -> Iterator[str]:
    """Stretches of a text that end at white space; only a word longer than that makes a longer one."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + SLICE // 8)
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, stops: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as ``<u4`` with the end id after each text, and where each text begins (and the end)."""
    n = len(stops) - 1
    out = np.empty(len(ids) + n, "<u4")
    ends = stops[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = ids, end_id
    return out, np.concatenate(([0], ends + 1))
