"""Texts of an Arrow batch as one array of lower-cased code points, with word bounds: the ground for vectorised text models.

Everything here is linear in the characters and keeps no table that grows with the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

def in_word(c: str) -> bool:
    """Letters, digits, and the marks that combine with what is before them: vowel signs, viramas, accents apart."""
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code point of each letter, digit and mark of the basic plane (0 for others), and whether it is a letter."""
    cls = np.zeros(0x10000, np.uint32)
    letter = np.zeros(0x10000, bool)
    for cp in range(0x10000):
        if not 0xD800 <= cp < 0xE000 and in_word(chr(cp)):
            letter[cp] = chr(cp).isalpha()
            cls[cp] = ord(chr(cp).lower()[0])
    return cls, letter


_CLS, _LETTER = _tables()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(cps: np.ndarray) -> np.ndarray:
    """Lower-cased code points of letters, digits and marks; 0 is no word character."""
    if len(cps) and cps.max() >= 0x10000:
        astral = cps >= 0x10000
        out = _CLS[np.where(astral, 0, cps)]
        for cp in np.unique(cps[astral]):
            if in_word(chr(cp)):
                out[cps == cp] = ord(chr(cp).lower()[0])
        return out
    return _CLS[cps]


def letters(cps: np.ndarray) -> np.ndarray:
    if len(cps) and cps.max() >= 0x10000:
        astral = cps >= 0x10000
        out = _LETTER[np.where(astral, 0, cps)]
        for cp in np.unique(cps[astral]):
            if chr(cp).isalpha():
                out[cps == cp] = True
        return out
    return _LETTER[cps]


@dataclass
class Words:
    """Words of some texts, laid end to end."""

    cls: np.ndarray  # lower-cased code point of every character, 0 outside words
    start: np.ndarray  # of every word, in characters
    end: np.ndarray
    doc: np.ndarray  # text of every word
    cps: np.ndarray


def lay(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text ends (after that line feed)."""
    joined = "\n".join(texts) + "\n" if texts else ""
    bounds = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return codes(joined), bounds


def split(texts: list[str]) -> Words:
    """Words: runs of letters, digits and marks."""
    cps, bounds = lay(texts)
    cls = classes(cps)
    inside = np.concatenate(([False], cls > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return Words(cls, start, end, np.searchsorted(bounds, start, "right"), cps)


_POW = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n - 1, 0), _POW, np.uint64))))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_codes(places: list[np.ndarray], bits: int) -> np.ndarray:
    """A code of so many bits for each tuple of up to four code points, the k-th from places[k]."""
    x = places[0] * _ODD[0]
    for values, odd in zip(places[1:], _ODD[1:], strict=False):
        x = x + values * odd
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x297A2D39)
    return (x >> np.uint32(32 - bits)).astype(np.int32)


def word_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over the mixed values, counted from the word's start."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = end - start
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offset + np.repeat(start, n)
    terms = mix(values[at].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[offset]
    return mix(np.add.reduceat(terms, np.cumsum(n) - n) + n.astype(np.uint64))


def positions(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - start
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def sliced(batch: pa.RecordBatch, at: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text, one row at least."""
    if not batch.num_rows:
        yield batch
        return
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(at).cast(pa.large_binary())], np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
