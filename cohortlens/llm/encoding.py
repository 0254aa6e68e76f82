"""Token ids of whole texts by the tokenizers library, fast on text whose words recur.

A text is cut before white space that follows something else, and between letters and signs. Both kinds of vocabulary
keep apart what stands on the two sides of such a place, so a text's ids are its segments' ids one after the other.
Cutting, counting distinct segments and putting ids together are array operations over many texts; only the distinct segments of a batch are looked up, and
only new ones reach the tokenizer. The store of a worker is bounded by `max_segments` and starts anew when full, which
costs time and never changes a result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

MAX_SEGMENTS = 1_500_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 4 << 20
_LONG = 4096
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")


def _bytes(*values: int) -> np.ndarray:
    return np.isin(np.arange(256), values)


_SPACE, _LETTER, _SIGN = _bytes(0x20, 0x0A), _bytes(*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _bytes(*b".,;:!?#$%&*()/+-")
#: Bytes that are white space in some definition, before which nothing is cut.
_BLANK = _bytes(0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))


def _after_wide_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space of two or three UTF-8 bytes."""
    a, b, c = (data[np.maximum(at - k, 0)].astype(np.int32) for k in (3, 2, 1))
    three = a << 16 | b << 8 | c
    two = (b << 8 | c == 0xC285) | (b << 8 | c == 0xC2A0)
    return two | ((three >= 0xE28080) & (three <= 0xE2808A)) | np.isin(three, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a segment starts at a byte: at a text's start, at white space after another character, at signs after a
    letter, and at a letter after a line feed that stands alone."""
    cut = np.zeros(len(data) + 1, bool)
    np.logical_and(_SPACE[data[1:]], ~_BLANK[data[:-1]], out=cut[1:-1])
    wide = np.flatnonzero(cut[1:-1] & (data[:-1] >= 0x80)) + 1
    cut[wide[_after_wide_blank(data, wide)]] = False
    cut[bounds] = True
    alone = cut[:-2] & (data[:-1] == 0x0A) & _LETTER[data[1:]]
    cut[1:-1] |= (_SIGN[data[1:]] & _LETTER[data[:-1]]) | alone
    return cut


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings; a null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _values(array: pa.LargeBinaryArray) -> list[bytes]:
    data = array.buffers()[2].to_pybytes()
    at = np.frombuffer(array.buffers()[1], np.int64)[: len(array) + 1].tolist()
    return [data[a:b] for a, b in pairwise(at)]


class SegmentEncoder:
    """encode(texts) -> ids of `dtype` and where each text's ids start.

    lead: the tokenizer keeps white space, and a space belongs to the segment after it; else it drops white space.
    """

    def __init__(self, path: str, lead: bool, max_segments: int = MAX_SEGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lead, self.max_segments = lead, max_segments
        self.lower = "Lowercase" in (repr(self.tokenizer.normalizer) if self.tokenizer.normalizer else "")
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = np.zeros(size, bool)
        for token, n in self.tokenizer.get_vocab().items():
            self.end[n] = token == "Ċ" if lead else token.endswith("</w>")
        self.store: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words of letters, encoded as texts of many words, whose ids show where each word ends."""
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([("\n" if self.lead else " ").join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.end[ids]).tolist()
            if self.lead:
                firsts, ends = [0, *(e + 1 for e in ends)], [*ends, len(ids)]
            else:
                ends = [e + 1 for e in ends]
                firsts = [0, *ends[:-1]]
            if len(ends) == len(some):
                yield from ((w, ids[a:b].tobytes()) for w, a, b in zip(some, firsts, ends, strict=True))
            else:
                yield from zip(some, self._each(some), strict=True)

    def _learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new segments; where case and white space mean nothing, words are encoded once whatever theirs is."""
        plain, others = [], []
        for s in segments:
            t = s.decode()
            (plain if _WORD.match(t) else others).append((s, t))
        if self.lead:
            out = dict(zip([s for s, _ in plain], (ids for _, ids in self._words([t for _, t in plain])), strict=True))
        else:
            keys = [(t.lower() if self.lower else t).lstrip(" ") for _, t in plain]
            self.words.update(self._words(list(set(keys) - self.words.keys())))
            out = {s: self.words[k] for (s, _), k in zip(plain, keys, strict=True)}
        for at in range(0, len(others), 4096):
            some = others[at : at + 4096]
            out.update(zip([s for s, _ in some], self._each([t for _, t in some]), strict=True))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; a null text is empty."""
        if len(self.store) > self.max_segments:
            self.store.clear()
        if len(self.words) > self.max_segments:
            self.words.clear()
        data, bounds = _utf8(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        cut = _cuts(data, bounds)
        edges = np.flatnonzero(cut)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        distinct, which = _values(coded.dictionary), coded.indices.to_numpy()
        got = list(map(self.store.get, distinct))
        if None in got:
            new = self._learn([s for s, g in zip(distinct, got, strict=True) if g is None])
            self.store.update((s, ids) for s, ids in new.items() if len(s) <= _LONG)
            got = [new[s] if g is None else g for s, g in zip(distinct, got, strict=True)]
        flat = np.frombuffer(b"".join(got), self.dtype)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        first = np.cumsum(sizes) - sizes
        own = sizes[which]
        ends = np.cumsum(own)
        ids = flat[np.repeat(first[which] - ends + own, own) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(edges, bounds)]


def encoded(batches: Iterator[pa.RecordBatch], enc: SegmentEncoder, column: int, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, ids, offsets) of column's texts with end_id after each, ids little-endian unsigned 32-bit.

    Batches are put together or cut so that each holds about BATCH_BYTES of text, or one text.
    """
    for batch in by_bytes(batches, column):
        ids, offsets = enc.encode(batch.column(column))
        at = np.arange(1, batch.num_rows + 1)
        out = np.full(len(ids) + len(at), end_id, "<u4")
        own = np.ones(len(out), bool)
        own[offsets[1:] + at - 1] = False
        out[own] = ids
        yield batch, out, np.append(0, offsets[1:] + at)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `limit` bytes in column, up to one more batch of that size and one row."""
    held, size = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = _utf8(batch.column(column))[1]
        ends = np.searchsorted(offsets, np.arange(limit, offsets[-1] + limit, limit)).clip(1, batch.num_rows)
        for a, b in pairwise(np.unique(np.concatenate([[0], ends, [batch.num_rows]])).tolist()):
            held.append(batch.slice(a, b - a))
            size += int(offsets[b] - offsets[a])
            if size >= limit:
                yield from joined()
                held, size = [], 0
    if held:
        yield from joined()


_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder(path: str, lead: bool, max_segments: int = MAX_SEGMENTS) -> SegmentEncoder:
    """One encoder a worker process and file."""
    key = (path, lead)
    if key not in _ENCODERS:
        _ENCODERS[key] = SegmentEncoder(path, lead, max_segments)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
