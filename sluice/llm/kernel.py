"""NumPy kernels over the UTF-8 bytes of many texts at once: word hashes, shingles, rolling hashes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, the same in every process.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POSITION = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACES
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            out = [np.cumprod(np.concatenate([[U(1)], np.full(size - 1, U(b % (1 << 64)))]), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def even_bounds(n: int) -> np.ndarray:
    """Where each of n equal ranges of 64-bit numbers begins."""
    return np.arange(n, dtype=np.uint64) * U(min((1 << 64) // n + 1, (1 << 64) - 1))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and where each begins (with the end as last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8), starts


def words(buf: np.ndarray, starts: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and, for each text, the index of its first word (with the count as last)."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    edge = np.diff(kind[buf].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTE)[buf] * power[: len(buf)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, starts)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they lie in one text."""
    if n > 64:
        raise ValueError("n-grams of up to 64 words")
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, U(n), np.uint64)
    for j in range(n):
        out += hashes[j : j + size] * _POSITION[j]
    last = np.repeat(first[1:], np.diff(first))[:size]  # end of the text that each word is in
    return mix(out), np.arange(size) + n <= last


#: Bytes of text hashed at once: tables and sums take some forty bytes for each, and the tables stay.
_LOT = 1 << 18


def shingles(texts: list[bytes], n: int, kind: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles; of fewer words, the whole sequence is one; of none, nothing."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > _LOT:
            out += _shingled(texts[begin:i], n, kind)
            begin, size = i, 0
        size += len(text)
    return out + _shingled(texts[begin:], n, kind)


def _shingled(texts: list[bytes], n: int, kind: np.ndarray) -> list[np.ndarray]:
    buf, starts = joined(texts)
    hashes, first = words(buf, starts, kind)
    grams, _ = ngrams(hashes, first, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix((hashes[a:b] * _POSITION[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each byte on."""
    size = len(buf) - k + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    return mix((total[k:] - total[:size]) * inverse[:size])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of the w values from each value on."""
    size, span = len(x) - w + 1, 1
    if size <= 0:
        return x[:0]
    while span * 2 <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[:size], x[w - span : w - span + size])
