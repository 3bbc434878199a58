"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once: intermediates take about forty times as much.
CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wraps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _bytes(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], dtype=bool)


FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words [^\x20\x09-\x0D]+ and, on folded bytes, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
SPACED = _bytes(lambda b: b != 0x20 and not 9 <= b <= 13)
ALNUM = _bytes(lambda b: b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
#: For bytes.translate: folds A-Z and turns what is no ALNUM word into spaces.
ALNUM_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))

with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, n + 1 of each at least."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n + 1, base, dtype=np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def alnum_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split()


def texts_in_chunks(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of about CHUNK bytes; a longer text stands alone."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK):
            size += len(raw[end])
            end += 1
        offsets = np.zeros(end - at + 1, dtype=np.int64)
        np.cumsum([len(r) for r in raw[at:end]], out=offsets[1:])
        yield at, end, np.frombuffer(b"".join(raw[at:end]), dtype=np.uint8), offsets
        at = end


def word_places(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts begin and end in data."""
    word = inside[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def placed_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_hashes() with the words' begins and ends in data."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, stops = word_places(data, offsets, inside)
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[FOLD[data]] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, stops


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-folded words of all texts, and where each text's words begin (n + 1 offsets)."""
    return placed_hashes(data, offsets, inside)[:2]


def runs_of(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words (empty where there are fewer)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out = out * _U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out + _U(length))
