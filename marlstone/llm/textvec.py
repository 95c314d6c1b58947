"""Texts of an Arrow batch as code-point arrays: classes, words and polynomial hashes without per-character Python."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


@functools.cache
def class_table() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    t = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    t[:] = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    t[WHITE_SPACE] = SPACE
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in a new array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _mixed_code_points() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier ('up') or of its inverse ('down'), modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = np.full(max(n, 1 << 16), _MULTIPLIER if kind == "up" else _INVERSE)
        base[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(base)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * m**i, one longer than values; span_hash reads any span's hash off them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same for the same content anywhere."""
    return mix((prefix[end] - prefix[start]) * _powers("down", len(prefix))[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of `width` values, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:n]) * _powers("down", len(prefix))[:n])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each begins (one more entry than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def char_prefix(cps: np.ndarray) -> np.ndarray:
    return prefix_hash(_mixed_code_points()[cps])


def chunked(texts: Iterable[str], most: int = 1 << 20, most_texts: int = (1 << 16) - 1) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` code points together, at most `most_texts`, with the index of the first; a longer text stands alone, whole."""
    run: list[str] = []
    first = size = 0
    for i, t in enumerate(texts):
        if run and (size + len(t) > most or len(run) == most_texts):
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def words(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of letters and digits, never across texts: start, end and text of each."""
    inside = class_table()[cps]
    inside = (inside == LETTER) | (inside == NUMBER)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = starts[1:-1]
    edges = edges[edges < len(cps)]
    begins[edges] = inside[edges]
    edges = edges[edges > 0]
    ends[edges - 1] = inside[edges - 1]
    at = np.flatnonzero(begins)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(starts, at, side="right") - 1


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the lower-cased texts."""
    cps, starts = code_points([t.lower() for t in texts])
    begin, end, doc = words(cps, starts)
    return span_hash(char_prefix(cps), begin, end), doc


def shingles(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of k consecutive words of a text, in order."""
    h = window_hash(prefix_hash(word_hash), k)
    same = doc[: len(h)] == doc[k - 1 :] if len(h) else np.zeros(0, bool)
    return h[same], doc[: len(h)][same]


def distinct_per_text(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 48-bit hashes of each text, sorted, and where each text's begin (n + 1 entries). n is under 65536, as in the runs of chunked."""
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.r_[True, key[1:] != key[:-1]]]
    if n >= 1 << 16:
        raise ValueError("too many texts at once")
    starts = np.r_[np.searchsorted(key, np.arange(n, dtype=np.uint64) << np.uint64(48)), len(key)]
    return key & np.uint64((1 << 48) - 1), starts
