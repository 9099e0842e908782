"""Vectorised words, hashes and windows over Arrow batches of whole texts.

A batch is cut into pieces of about ``PIECE`` bytes (one document is never cut), and every step below works on
the bytes of a piece at once. Hashes are 64-bit polynomial sums over random byte values, finished by a mixer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from shelfwise.llm.session import release_others, spread

PIECE = 1 << 20
STRETCH = 1 << 27
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """m^0..m^n and their inverses modulo 2^64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 1)
        both = []
        for m in (_MULTIPLIER, _INVERSE):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = tuple(both)
    return _powers


def separators(kind: str) -> np.ndarray:
    """True for the bytes between words. 'space': words are [^\\x20\\x09-\\x0D]+; 'alnum': [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
    after A-Z are lower-cased. Bytes of multi-byte characters always belong to words."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:0x80] = True
        sep[0x30:0x3A] = sep[0x41:0x5B] = sep[0x61:0x7B] = False
    return sep


def lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


@dataclass
class Piece:
    """Some whole documents: ``data`` holds their bytes, ``bounds`` their n+1 offsets, ``rows`` their rows in the batch."""

    data: np.ndarray
    bounds: np.ndarray
    rows: range


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # word offsets of the documents, n+1
    doc: np.ndarray  # document of each word

    def count(self) -> np.ndarray:
        return np.diff(self.bounds)


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[Piece]:
    """Cut a string column into pieces; null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Piece(data[off[at] : off[to]], off[at : to + 1] - off[at], range(at, to))
        at = to


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in [start, end); equal for equal sequences wherever they stand."""
    z = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return spread(z + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray, lower: bool = False) -> np.ndarray:
    return (_BYTE_VALUE[lowered()] if lower else _BYTE_VALUE)[data]


def words(piece: Piece, kind: str, lower: bool) -> Words:
    data, bounds = piece.data, piece.bounds
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(bounds), np.int64), none)
    inside = ~separators(kind)[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(byte_values(data, lower))
    at = np.searchsorted(start, bounds, "left")
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    return Words(start, end, span_hash(sums, start, end), at, doc)


def gram_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Mask over token positions: a run of k tokens starts here within one document."""
    n = int(bounds[-1])
    ok = np.zeros(n + 1, np.int32)
    size = np.diff(bounds)
    long = size >= k
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, bounds[1:][long] - k + 1, -1)
    return np.cumsum(ok[:n]) > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (len(x) - w + 1 of them)."""
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


@dataclass
class Anchors:
    """Winnowed fingerprints: ``key`` is the hash of the chosen k-gram, which is the choice of the windows that start in
    [first, last] (token positions in the piece)."""

    key: np.ndarray
    first: np.ndarray
    last: np.ndarray


def winnow(sums: np.ndarray, bounds: np.ndarray, k: int, window: int) -> Anchors:
    """Keep the least k-gram hash of every window of ``window`` tokens; equal windows always make the same choice
    (ties go to the leftmost), so every shared window shares a fingerprint. Long pieces are done in overlapping stretches,
    as the place of a gram within its stretch shares a 64-bit number with its hash."""
    n = len(sums) - 1
    empty = np.empty(0, np.int64)
    if n < window:
        return Anchors(empty.astype(np.uint64), empty, empty)
    valid = gram_starts(bounds, window)[: n - window + 1]
    found = []
    for base in range(0, n - window + 1, STRETCH):
        at = np.arange(min(n - k + 1 - base, STRETCH + window - k))
        gram = span_hash(sums, at + base, at + base + k)
        low = np.uint64((1 << 28) - 1)
        chosen = (sliding_min((gram & ~low) | at.astype(np.uint64), window - k + 1) & low).astype(np.int64)
        starts = np.flatnonzero(valid[base : base + len(chosen)])
        if not len(starts):
            continue
        picks = chosen[starts]
        cut = np.flatnonzero((np.diff(picks) != 0) | (np.diff(starts) != 1)) + 1
        head = np.concatenate([[0], cut])
        tail = np.concatenate([cut, [len(starts)]]) - 1
        found.append((gram[picks[head]], starts[head] + base, starts[tail] + base))
    if not found:
        return Anchors(empty.astype(np.uint64), empty, empty)
    return Anchors(*(np.concatenate([f[j] for f in found]) for j in range(3)))


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as maximal runs in order (touching spans join)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.concatenate([at[1:], [len(end)]]) - 1]


def slices(batches, column: int, limit: int = 4 << 20, operator: str | None = None):
    """Arrow batches cut into parts of about ``limit`` bytes of text (a text is never cut), which share their memory. What
    other operators than ``operator`` keep in this worker is dropped."""
    release_others(operator)
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        off = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(off, int(off[at]) + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
