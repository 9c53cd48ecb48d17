"""Token ids of whole texts through the tokenizers library, with each distinct word encoded once.

The vocabulary `word_bpe_49k.json` drops white space and never joins what stands on both sides of
it, so a text's ids are those of its white-space chunks in order. Chunks go to the library as they
are written (but for the case of letters below U+0100 that begin a chunk): it normalises and looks for
special strings. A chunk that begins with letters and goes on with another ASCII character is two
independent parts, if the library's own normalisation leaves letters of those letters (a letter may become
a letter and a mark, which joins what follows). Most chunks are parted on the bytes of a slice before
distinct ones are looked for. Ids of parts are kept in two bounded tables per Python worker, of which
the older goes when the newer is full; everything else is vectorised.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker keeps in its table. A full table becomes the old one, in which words are looked up before they are encoded.
CACHE_WORDS = 200_000
#: Words that are encoded as one text.
JOINED = 256
#: Bytes of text that are encoded at once.
SLICE_BYTES = 6 << 20

_LETTERS = re.compile(r"[^\W\d_]*")
_open: dict[tuple[str, str], object] = {}


def worker_once(kind: str, key: str, make):
    """One object per Python worker."""
    if (kind, key) not in _open:
        _open[kind, key] = make()
    return _open[kind, key]


def load_tokenizer(path: str):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return worker_once("tokenizer", path, make)


_LETTER, _WHITE = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def parted(texts: pa.Array) -> pa.Array:
    """Texts with a blank between the letters that begin a chunk and another ASCII character after them, and those letters in lower case.

    Letters are those of ASCII and U+00C0 to U+00FF, which normalisation turns into one another only. What other letters
    do is the library's own matter: a chunk in which one follows stays as it is.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not n:
        return texts
    data, offsets = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + n], offsets - first
    letter, lower = _LETTER[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    letter[lead] = letter[lead + 1] = True
    capital = lead[data[lead + 1] < 0x9F] + 1
    lower[capital] += 32
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    turn = np.zeros(n + 1, bool)  # where a run of letters begins or ends
    turn[0], turn[n] = letter[0], letter[-1]
    np.not_equal(letter[1:], letter[:-1], out=turn[1:-1])
    cut = np.flatnonzero(begins[1:-1]) + 1
    both = cut[letter[cut] & letter[cut - 1]]  # a text's letters end, the next one's begin
    at = np.sort(np.concatenate((np.flatnonzero(turn), both, both)))
    starts, ends = at[::2], at[1::2]
    after = np.append(data, np.uint8(32))[ends]
    open_ = ~(begins[ends] | _WHITE[after])  # the chunk goes on
    good = (begins[starts] | _WHITE[data[starts - 1]]) & (~open_ | (after < 0x80))
    inside = np.zeros(n + 1, np.int8)
    inside[starts[good]] = 1
    inside[ends[good]] -= 1
    out = np.where(np.cumsum(inside[:-1], dtype=np.int8).view(bool), lower, data)
    blanks = ends[good & open_]
    out = np.insert(out, blanks, 32)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets + np.searchsorted(blanks, offsets)), pa.py_buffer(out))


class WordEncoder:
    """Ids of texts as one flat array and counts per text."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cache_words = cache_words

    def _exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts. Letters-only parts are encoded joined; each ends at the one piece that closes a word."""
        letters = [p for p in parts if p.isalpha()]
        groups = [letters[at : at + JOINED] for at in range(0, len(letters), JOINED)]
        out: dict[str, bytes] = {}
        for some, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, size = ids.tobytes(), self.dtype.itemsize
                bounds = [0, *(stops * size).tolist()]
                out.update(zip(some, [data[a:b] for a, b in zip(bounds, bounds[1:])], strict=True))
            else:
                out.update((p, self._exact(p)) for p in some)
        out.update((p, self._exact(p)) for p in parts if not p.isalpha())
        return out

    def _parts(self, word: str) -> tuple[str, ...]:
        """The independent parts of a chunk."""
        if word.isalpha():
            return (word,)
        start = _LETTERS.match(word)[0]
        if start and start.isalpha() and word[len(start)] < "\x80" and self.tokenizer.normalizer.normalize_str(start).isalpha():
            return (start, word[len(start) :])
        return (word,)

    def _missing(self, words: list[str]) -> None:
        """Puts the ids of words, and of their parts, into the cache."""
        cache, old = self.cache, self.old
        split = {w: ps for w in words if not w.isalpha() and len(ps := self._parts(w)) > 1}
        unknown = {p for ps in split.values() for p in ps if p not in cache}
        cache.update((p, old[p]) for p in unknown if p in old)
        cache.update(self._learn([w for w in words if w not in split] + [p for p in unknown.difference(words) if p not in cache]))
        cache.update((w, cache[a] + cache[b]) for w, (a, b) in split.items())

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each chunk. What was met since the table was last full, or in the time before, is not encoded again."""
        out: list[bytes] = []
        for at in range(0, len(words), self.cache_words):
            some = words[at : at + self.cache_words]
            if len(self.cache) + len(some) > self.cache_words:
                self.old, self.cache = self.cache, {}
            found = list(map(self.cache.get, some))
            if None in found:
                old = self.old.get
                kept = {w: ids for w, x in zip(some, found, strict=True) if x is None and (ids := old(w)) is not None}
                self.cache.update(kept)
                self._missing([w for w, x in zip(some, found, strict=True) if x is None and w not in kept])
                found = list(map(self.cache.__getitem__, some))
            out += found
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for token in self.special:  # their strings inside a text are the library's own matter
            marked |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(marked), "", texts) if marked.any() else texts
        chunks = pc.ascii_split_whitespace(parted(plain))
        keyed = chunks.flatten().dictionary_encode()
        bounds = chunks.offsets.to_numpy()
        names = keyed.dictionary.to_pylist()
        empty = [i for i, w in enumerate(names) if not w]
        values = self.words([w or "a" for w in names] if empty else names)
        for i in empty:
            values[i] = b""
        placed = pa.array(values, pa.large_binary()).take(keyed.indices)  # ids of all chunks, one after another
        size = self.dtype.itemsize
        ends = np.frombuffer(placed.buffers()[1], np.int64)[: len(placed) + 1] // size if len(placed) else np.zeros(1, np.int64)
        flat = np.frombuffer(placed.buffers()[2], self.dtype)[: ends[-1]] if ends[-1] else np.zeros(0, self.dtype)
        per = ends[bounds[1:]] - ends[bounds[:-1]]
        if marked.any():
            at = np.concatenate(([0], np.cumsum(per)))
            own = [np.frombuffer(self._exact(texts[i].as_py()), self.dtype) if marked[i] else flat[at[i] : at[i + 1]] for i in range(len(per))]
            flat, per = np.concatenate(own), np.array([len(x) for x in own])
        return flat, per


def word_encoder(path: str) -> WordEncoder:
    return worker_once("words", path, lambda: WordEncoder(path))


def by_bytes(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
