"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cartolith.llm.common import worker_cache

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True   # digits, letters, all of a non-ASCII character
LETTER_VALUES = odd(256, 11)
R = 0x5851F42D4C957F2D


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R and 1/R to the i, for i below n at least; kept and grown as needed."""
    kept = worker_cache().get("powers")
    if kept is None or len(kept[0]) < n:
        made = []
        for base in (R, pow(R, -1, 1 << 64)):
            steps = np.full(max(n, 1 << 20), base, U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=U))
        kept = worker_cache()["powers"] = tuple(made)
    return kept


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def parts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The column in runs of rows of about `size` bytes (one row at least): the first row, offsets from 0, bytes."""
    at, data = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, min(int(np.searchsorted(at, at[row] + size, "right")) - 1, row + 4096))
        yield row, at[row:end + 1] - at[row], data[at[row]:at[end]]
        row = end


@dataclass
class Words:
    doc: np.ndarray      # row of each word within the part
    start: np.ndarray    # first byte
    end: np.ndarray
    hash: np.ndarray     # 64 bits of the lower-cased (A-Z) word
    first: np.ndarray    # first word of each row; rows + 1 numbers


def words(offsets: np.ndarray, data: np.ndarray, kind: np.ndarray) -> Words:
    """The maximal runs of bytes of a kind; none crosses a row."""
    inside = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False            # before[i]: byte i - 1 is of the kind and of the same row
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not len(start):
        return Words(doc, start, end, np.empty(0, U), first)
    up, down = powers(len(data))
    values = np.where(inside, LETTER_VALUES[LOWER[data]], U(0))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(values * up[:len(data)], start) * down[start]
        h = mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))
    return Words(doc, start, end, h, first)


def grams(w: Words, shape: tuple[int, ...], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For every word from which `shape` (word distances, from 0) fits into its row: the word's number and the hash of the words at those distances."""
    span = shape[-1] + 1
    n = len(w.hash) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    at = np.flatnonzero(w.doc[:n] == w.doc[span - 1:])
    times = odd(len(shape), 101 + seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), U(seed * 2 + 1))
        for d, m in zip(shape, times):
            h += w.hash[at + d] * m
    return at, mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)
