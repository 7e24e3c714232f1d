"""Vectorised word and shingle hashing over batches of whole texts.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum over the buffer, then mixed.
Equal words always get equal hashes; two different ones share a hash with a chance of about 2**-64.
Buffers are walked in segments of about a megabyte cut at separators, so a text of any length needs bounded memory
beside the text itself and its word hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
SEGMENT = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that end at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of ASCII letters and digits and of all that is not ASCII (texts are lower-cased first).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        up, down = np.full(size, _BASE, dtype=U64), np.full(size, _BASE_INV, dtype=U64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


class Words:
    """Words of a list of texts: document index, byte span in its lower-cased text, 64-bit hash, all in order."""

    def __init__(self, texts: list[bytes], word: np.ndarray, prefixes: tuple[int, ...] = ()):
        lengths = np.fromiter((len(x) for x in texts), dtype=np.int64, count=len(texts))
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(lengths + 1, out=offsets[1:])
        buffer = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
        self.buffer, self.offsets = buffer, offsets
        starts, ends, hashes, tops = [], [], [], [[] for _ in prefixes]
        for a, b in _segments(buffer, word):
            s, e, h, t = _hash(buffer[a:b], word, prefixes)
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(h)
            for k, x in enumerate(t):
                tops[k].append(x)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        self.starts, self.ends, self.hashes = join(starts, np.int64), join(ends, np.int64), join(hashes, U64)
        #: For each prefix length: the hash of the word's first bytes, 0 where the word is not longer than that.
        self.tops = [join(x, U64) for x in tops]
        #: Words of document i are those from bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, offsets)

    def text(self, word: int) -> bytes:
        return self.buffer[self.starts[word] : self.ends[word]].tobytes()


def _segments(buffer: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(buffer)
    while at < n:
        size = SEGMENT
        while True:
            end = min(n, at + size)
            if end == n:
                break
            apart = np.flatnonzero(~word[buffer[max(at, end - 4096) : end]])
            if not len(apart):
                apart = np.flatnonzero(~word[buffer[at:end]]) if size > 4096 else apart
                base = at
            else:
                base = max(at, end - 4096)
            if len(apart):
                end = base + int(apart[-1]) + 1
                break
            size *= 2
        yield at, end
        at = end


def _hash(low: np.ndarray, word: np.ndarray, prefixes: tuple[int, ...]):
    n = len(low)
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = word[low]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2].astype(np.int64), edges[1::2].astype(np.int64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[low] * up[:n], out=sums[1:])
    size = (ends - starts).astype(U64)
    first = sums[starts]
    h = mix((sums[ends] - first) * down[starts] + size * U64(0xA0761D6478BD642F))
    tops = []
    for k in prefixes:
        longer = size > U64(k)
        top = mix((sums[np.minimum(starts + k, n)] - first) * down[starts] + U64(k * 0xE7037ED1A0B428DB % 2**64))
        tops.append(np.where(longer, top, U64(0)))
    return starts, ends, h, tops


_LANE = mix(np.arange(101, 229, dtype=U64) * U64(0x8EBC6AF09C88C6E3)) | U64(1)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of so many consecutive words of one text."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    total = np.zeros(n - size + 1, dtype=U64)
    for k in range(size):
        total += words.hashes[k : n - size + 1 + k] * _LANE[k]
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    first = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
    return first, mix(total[first] + U64(size))


def short_hash(hashes: np.ndarray) -> int:
    """The hash of a whole sequence of words that is shorter than a window, as windows() would give it."""
    k = len(hashes)
    return int(mix(np.array([(hashes * _LANE[:k]).sum(dtype=U64) + U64(k)], dtype=U64))[0])


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text its set of word shingles as sorted distinct 64-bit hashes (words end at ASCII white space).

    A text of fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    words = Words(texts, NOT_SPACE)
    first, hashes = windows(words, size)
    cuts = np.searchsorted(first, words.bounds)
    for i in range(len(texts)):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a >= size:
            yield np.unique(hashes[cuts[i] : cuts[i + 1]])
        elif b > a:
            yield np.array([short_hash(words.hashes[a:b])], dtype=U64)
        else:
            yield np.zeros(0, dtype=U64)


def groups(texts: list[bytes], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x) + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(batch, text_col: str, rows: int = 256, limit: int = SEGMENT):
    """The Arrow batch in parts of at most so many rows and about ``limit`` bytes of texts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = size = 0
    for k, n in enumerate(sizes):
        size += n
        if size >= limit or k + 1 - start == rows:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark keeps."""
    return np.ascontiguousarray(values, dtype=U64).view(np.int64)
