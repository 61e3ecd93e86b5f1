"""Word and shingle hashes of whole Arrow text columns with numpy; no per-word Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators for features: every ASCII character that is neither a letter nor a digit.
PUNCTUATED = np.ones(256, bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_of(doc: np.ndarray, n_groups: int) -> np.ndarray:
    """The group of documents that each id lies in."""
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)


def buffers(text) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its len + 1 offsets into them."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    text = text.cast(pa.large_string())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = text.buffers()
    offsets = np.frombuffer(at, np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = False,
                separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and the len(offsets) bounds of the texts in that list.

    A word's hash is a polynomial in its bytes, taken as a difference of prefix sums over pieces of about 0.5 MB that
    are cut at separators, so that memory stays bounded for a very long text."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _PIECE)
        while end < len(raw) and not (edge[end] or separator[raw[end]]):
            more = separator[raw[end:end + 65536]] | edge[end:min(len(raw), end + 65536)]
            end += int(np.argmax(more)) if more.any() else len(more)
        piece = raw[at:end]
        word = ~separator[piece]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[at + 1:end]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[at + 1:end]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = len(piece)
        if len(s):
            power = np.full(n, _BASE, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((_LOWER[piece] if lower else piece).astype(np.uint64) * power + power, out=sums[1:])
            back = np.full(n, _INVERSE, np.uint64)
            back[0] = 1
            np.cumprod(back, out=back)
            hashes.append(mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, "left")


def rolling(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, len(words) - k + 1 of them; ``seed`` (odd) picks the function."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= np.uint64(seed)
        out += words[j:j + n]
    return mix(out)


def window_mask(bounds: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Which of the n_words - k + 1 windows lie within one text."""
    ok = np.zeros(max(0, n_words - k + 1), bool)
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e - s >= k:
            ok[s:e - k + 1] = True
    return ok
