"""Keys that several blocks of documents share, found without sending a row per key.

A block is a set of documents of a few MB. Each block sends its distinct keys, packed by key range; one task per range sees which keys meet, and
sends back to each block those of its keys that do. A key that fills a third of the table costs one entry per block, and everything between the
passes is a table in the shared folder, so that a lost executor costs part of one pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.words import U

BLOCK = 2 << 20         # bytes of text
PER_RANGE = 1 << 18     # keys that one range holds


def blocked(base: DataFrame) -> tuple[DataFrame, int]:
    """(block, doc_id, text) and the number of bytes. Equal ids come into the same block."""
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, ceil(size / BLOCK))
    return base.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id", "text"), size


@dataclass
class Keys:
    """Distinct keys in order, each with an extra word that must agree too, and the smallest and largest value seen."""
    key: np.ndarray
    check: np.ndarray   # 32 bits
    low: np.ndarray
    high: np.ndarray

    def pick(self, at) -> "Keys":
        return Keys(self.key[at], self.check[at], self.low[at], self.high[at])


def planes(a: np.ndarray) -> np.ndarray:
    """Numbers byte by byte: a row for the lowest bytes of all, and so on."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T


def pack(k: Keys) -> bytes:
    """Steps between keys, checks, values and their widths, byte by byte; a byte that is zero in all numbers is left out."""
    rows = [row for a in (np.diff(k.key, prepend=U(0)), k.check, k.low, k.high - k.low) for row in planes(a)]
    used = [row.any() for row in rows]
    head = np.array([len(k.key), sum(1 << i for i, u in enumerate(used) if u)], np.uint32)
    return b"".join([head.tobytes(), *(row.tobytes() for row, u in zip(rows, used) if u)])


def unpack(raw: bytes) -> Keys:
    n, used = (int(x) for x in np.frombuffer(raw, np.uint32, 2))
    rows, at = np.zeros((28, n), np.uint8), 8
    for i in range(28):
        if used >> i & 1:
            rows[i] = np.frombuffer(raw, np.uint8, n, at)
            at += n
    number = lambda lo, hi, kind: np.ascontiguousarray(rows[lo:hi].T).view(kind).ravel()
    low = number(12, 20, U)
    return Keys(np.cumsum(number(0, 8, U), dtype=U), number(8, 12, np.uint32), low, low + number(20, 28, U))


def joined(each: list[Keys]) -> Keys:
    empty = Keys(np.empty(0, U), np.empty(0, np.uint32), np.empty(0, U), np.empty(0, U))
    return Keys(*(np.concatenate([getattr(k, f) for k in [empty, *each]]) for f in ("key", "check", "low", "high")))


def runs(k: Keys) -> np.ndarray:
    """Where each distinct (key, check) starts, in sorted keys."""
    return np.flatnonzero(np.concatenate([[True], (np.diff(k.key) != 0) | (np.diff(k.check) != 0)])) if len(k.key) else np.empty(0, np.int64)


def distinct(key: np.ndarray, check: np.ndarray | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Keys:
    """Sorted and combined."""
    zero = np.zeros(len(key), U)
    k = Keys(key, np.zeros(len(key), np.uint32) if check is None else check.astype(np.uint32), zero if low is None else low, (zero if low is None else low) if high is None else high)
    k = k.pick(np.lexsort((k.check, k.key)) if check is not None else np.argsort(k.key, kind="stable"))
    at = runs(k)
    return k if not len(at) else Keys(k.key[at], k.check[at], np.minimum.reduceat(k.low, at), np.maximum.reduceat(k.high, at))


def find(k: Keys, key: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is there, and its place."""
    if not len(k.key):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    at = np.minimum(np.searchsorted(k.key, key), len(k.key) - 1)
    there = k.key[at] == key
    return (there if check is None else there & (k.check[at] == check.astype(np.uint32))), at


def ranges(keys: float) -> int:
    return max(1, ceil(keys / PER_RANGE))


def sent(block: int, k: Keys, n: int) -> pa.Table:
    """A block's keys as one row per key range."""
    edges = np.searchsorted(k.key, np.array([(i << 64) // n for i in range(1, n)], U)) if n > 1 else np.empty(0, np.int64)
    lo, hi = np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(k.key)]]).astype(int)
    some = np.flatnonzero(hi > lo)
    return pa.table([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int32()), pa.array([pack(k.pick(slice(lo[i], hi[i]))) for i in some], pa.binary())], ["range", "block", "packed"])


def meeting(rule: Callable[[Keys, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """The task of one key range. rule(sorted keys, run starts, entries per run) gives which runs go back, and the value each gets."""
    def run(_, table):
        each = [unpack(raw) for raw in table.column("packed").to_pylist()]
        k = joined(each)
        block = np.repeat(table.column("block").to_numpy(), [len(e.key) for e in each])
        order = np.lexsort((k.check, k.key))
        k, block = k.pick(order), block[order]
        at = runs(k)
        n = np.diff(np.concatenate([at, [len(k.key)]]))
        back, value = rule(k, at, n)
        keep = np.repeat(back, n)
        value = np.repeat(value, n)[keep]
        k, block = k.pick(keep), block[keep]
        order = np.argsort(block, kind="stable")
        blocks, first = np.unique(block[order], return_index=True)
        packed = [pack(Keys(k.key[i], k.check[i], value[i], value[i])) for i in np.split(order, first[1:])] if len(blocks) else []
        return pa.table([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], ["block", "packed"])

    return run


def several(k: Keys, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys with two entries or two values; they get the smallest value."""
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, U)
    low = np.minimum.reduceat(k.low, at)
    return low != np.maximum.reduceat(k.high, at), low


def answers(packed: DataFrame, rule=several) -> DataFrame:
    """(block, packed): what the ranges send back."""
    return packed.groupBy("range").applyInArrow(meeting(rule), "block int, packed binary")


def received(table: pa.Table) -> Keys:
    """All keys sent back to a block, in order."""
    k = joined([unpack(raw) for raw in table.column("packed").to_pylist()])
    return k.pick(np.lexsort((k.check, k.key)))


SENT = "range int, block int, packed binary"
