"""Vectorized text primitives: Arrow buffers, word and line bounds, polynomial hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers: fixed values, so that hashes agree between workers.
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
#: A random 64-bit value for each byte.
BYTE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=U)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i from 0 to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, PIECE + 4096)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 4 * PIECE:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which span() takes the hash of any run of values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for arrays of bounds; equal runs have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offs


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most limit bytes, or one row: first row, end row, their bytes, their offsets from 0."""
    flat, offs = utf8(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+; words end with their row."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, rows_of(start, offs)


def rows_of(at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.searchsorted(offs, at, "right") - 1


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of those aren't the first."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a run [start, start + length)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def totals(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values in each row."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
