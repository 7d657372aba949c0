"""Content-defined chunks by a rolling hash, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Fixed values of the rolling hash: a window's hash is the sum of code * ROLL**place modulo 2**64, then mixed.
WINDOW = 4
LONGEST = 2
ROLL = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def chunk_texts(texts: list[str], divisor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, chunk hash, chunk length in characters) of every chunk, of ``divisor`` characters in the mean.

    A boundary follows each window of ``WINDOW`` characters whose rolling hash
    is the greatest of those up to ``divisor // 2`` places before and behind it,
    so boundaries depend on nearby characters alone and return to step after an
    edit, and chunks are of like length. A chunk longer than ``LONGEST * divisor``
    is cut at multiples of that from its start, so that an edit costs no more
    than what follows it up to the next boundary. Every text also ends with a boundary;
    empty texts have no chunks.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if not n:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    ends = np.cumsum(lengths)
    rolled = np.zeros(n, np.uint64)
    for k, weight in enumerate(_powers(ROLL, min(WINDOW, n))):
        rolled[WINDOW - 1 :] += codes[WINDOW - 1 - k : n - k] * weight
    rolled = (rolled ^ (rolled >> np.uint64(29))) * MIX
    rolled = (rolled >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    starts = ends - lengths
    for k in range(WINDOW - 1):  # no window reaches back into the text before
        inside = starts + k < ends
        rolled[(starts + k)[inside]] = 0
    cut = rolled > 0
    place = np.arange(n)
    behind, ahead = place - np.repeat(starts, lengths), np.repeat(ends, lengths) - 1 - place
    for k in range(1, min(divisor // 2, n - 1) + 1):
        cut[k:] &= (rolled[k:] > rolled[:-k]) | (behind[k:] < k)
        cut[:-k] &= (rolled[:-k] >= rolled[k:]) | (ahead[:-k] < k)
    cut[ends[lengths > 0] - 1] = True
    last = np.flatnonzero(cut)
    begin = np.empty_like(last)
    begin[0], begin[1:] = 0, last[:-1] + 1
    most = divisor * LONGEST
    pieces = (last - begin) // most + 1
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(begin, pieces) + place * most
    last = np.minimum(np.repeat(last, pieces), begin + most - 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
    hashes = (sums[last + 1] - sums[begin]) * _powers(_INVERSE, n)[begin]
    hashes ^= hashes >> np.uint64(32)
    hashes *= MIX
    hashes ^= hashes >> np.uint64(29)
    return np.searchsorted(ends, last, "right"), hashes.view(np.int64), last + 1 - begin


#: Bit of a packed chunk that says that it is a piece of a short text; the 15 bits below are its length.
FINE = 0x8000
LENGTH = 0x7FFF


def packed_rows(texts: list[str], divisor: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, chunk) of the distinct chunks of every text, in order; a chunk is one long: 48 bits of hash, then its length (at most 32,767)."""
    number, hashes, size = chunk_texts(texts, divisor)
    return _distinct(number, (hashes & ~np.int64(0xFFFF)) | np.minimum(size, LENGTH))


def packed_chunks(texts: list[str], divisor: int) -> list[np.ndarray]:
    """For each text its distinct chunks, see ``packed_rows``."""
    number, packed = packed_rows(texts, divisor)
    at = np.searchsorted(number, np.arange(len(texts) + 1))
    return [packed[at[i] : at[i + 1]] for i in range(len(texts))]


def packed_pieces(texts: list[str], size: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, piece) of the distinct pieces of ``size`` characters of the texts of at most ``longest``, packed with ``FINE`` and length 1."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    short = np.flatnonzero((lengths >= size) & (lengths <= longest))
    if not len(short):
        empty = np.empty(0, np.int64)
        return empty, empty
    codes = np.frombuffer("".join(texts[i] for i in short).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    count = lengths[short] - size + 1
    first = np.cumsum(lengths[short]) - lengths[short]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    hashes = np.zeros(len(at), np.uint64)
    for k, weight in enumerate(_powers(ROLL, size)):
        hashes += codes[at + k] * weight
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX
    hashes ^= hashes >> np.uint64(32)
    return _distinct(np.repeat(short, count), (hashes.view(np.int64) & ~np.int64(0xFFFF)) | FINE | 1)


def _distinct(number: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((packed, number))
    number, packed = number[order], packed[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (packed[1:] != packed[:-1])
    return number[new], packed[new]
