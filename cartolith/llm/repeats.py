"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two documents repeat each other where a window of `depth` bytes of one also starts in the other. Ordering all suffixes through `depth` bytes would
write many times the input. Instead only the suffixes that a window chooses for itself are ordered: each window picks its gram (a string of a third
of its length) with the smallest hash, the first of equal ones, so equal windows pick the same gram at the same place, and neighbouring windows mostly
share their pick. Passes then go from the most significant digit on, each over what the pass before has left together:

1. the picked gram: only grams that stand in two documents go on;
2. the whole stretch of windows around one picked gram: stretches that are equal are settled at once, for all their windows, by the smallest
   document id; grams with several stretches are contested;
3. for the first document of each stretch of a contested gram, the gram with the half window before it or after it;
4. whole windows, of those stretches, with a half window that another document has.

Digits are compared by 64-bit hashes, windows and stretches by 96 bits; a pass is a round of blocks.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm import blocks
from cartolith.llm.blocks import Keys, distinct, find
from cartolith.llm.common import discard, documents_of, written
from cartolith.llm.words import LETTER_VALUES, U, mix, powers, raw

CHUNK = 1 << 17
PLACE = U((1 << 20) - 1)
SIGN = U(1 << 63)
GRAM, STRETCH, BEFORE, AFTER = (U(s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x243F6A8885A308D3, 0x13198A2E03707344))


@dataclass
class Picks:
    """Runs of windows of one document that picked the same place. Places count from the chunk's first byte."""
    data: np.ndarray    # the chunk and what its last windows reach beyond it
    at: int             # its first byte in the block
    gram: np.ndarray    # hash of the picked gram
    place: np.ndarray   # where it starts
    doc: np.ndarray     # row
    lo: np.ndarray      # first window
    hi: np.ndarray      # last window

    def pick(self, some: np.ndarray) -> "Picks":
        return Picks(self.data, self.at, self.gram[some], self.place[some], self.doc[some], self.lo[some], self.hi[some])

    def hashed(self):
        """A function that hashes data[a:b] for arrays a, b."""
        up, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(LETTER_VALUES[self.data] * up[:len(self.data)], dtype=U)])

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * U(0x9E3779B97F4A7C15))

        return of


def gram_length(depth: int) -> int:
    if depth < 24:
        raise ValueError("windows have 24 bytes at least")
    return min(16, depth // 3)


def picks(offsets: np.ndarray, data: np.ndarray, depth: int) -> Iterator[Picks]:
    g = gram_length(depth)
    windows = depth - g + 1   # grams in a window
    for at in range(0, max(len(data) - depth + 1, 0), CHUNK):
        part = data[at:at + CHUNK + depth - 1]
        eight = np.ascontiguousarray(np.ndarray((len(part) - 7,), "<u8", part, strides=(1,)))
        n = len(part) - g + 1
        with np.errstate(over="ignore"):
            h = mix(eight[:n] * U(0x9E3779B97F4A7C15) ^ mix(eight[g - 8:g - 8 + n]))
        least, reach = (h & ~PLACE) | np.arange(n, dtype=U), 1
        while reach < windows:
            step = min(reach, windows - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        place = (least & PLACE).astype(np.int64)
        # windows that start in a document's last depth - 1 bytes reach beyond it
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, at + len(place), "left")
        doc = np.repeat(np.arange(first, last), np.diff(np.clip(offsets[first:last + 1] - at, 0, len(place))))
        inside = np.flatnonzero(np.arange(at, at + len(place)) + depth <= offsets[doc + 1])
        if not len(inside):
            continue
        p = place[inside]
        start = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 0) | (np.diff(inside) > 1)]))
        end = np.concatenate([start[1:], [len(inside)]]) - 1
        yield Picks(part, at, h[p[start]], p[start], doc[inside[start]], inside[start], inside[end])


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (as unsigned numbers in the order of the signed ones; null is the largest), offsets and bytes."""
    text = table.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offsets, data = raw(text)
    ids = table.column("doc_id").fill_null(2 ** 63 - 1).to_numpy().astype(np.int64).view(U) ^ SIGN
    return ids, offsets - offsets[0], data[offsets[0]:offsets[-1]]


def half_keys(p: Picks, of, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: whether some window has the half before the gram, and its key; whether some has the half after it, and its key."""
    g = gram_length(depth)
    half = (depth - g) // 2
    before, after = p.place - p.lo >= half, p.place - p.hi < half
    b = of(np.where(before, p.place - half, 0), np.where(before, p.place + g, 0))
    a = of(np.where(after, p.place, 0), np.where(after, p.place + depth - half, 0))
    return before, mix(b ^ BEFORE), after, mix(a ^ AFTER)


def gram_keys(table: pa.Table, depth: int) -> Keys:
    """Pass 1: the distinct grams of a block; value 1 says that two of its documents have it."""
    ids, offsets, data = texts_of(table)
    grams, docs = [np.empty(0, U)], [np.empty(0, U)]
    for p in picks(offsets, data, depth):
        grams.append(p.gram)
        docs.append(ids[p.doc])
    k = distinct(np.concatenate(grams), None, np.concatenate(docs))
    many = (k.high != k.low).astype(U)
    return Keys(k.key, k.check, np.zeros(len(many), U), many)


def grams_meet(k: Keys, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, U)
    return (n > 1) | (np.maximum.reduceat(k.high, at) > 0), np.zeros(len(at), U)


def tag(gram: np.ndarray) -> np.ndarray:
    """32 bits of a gram, never 0, which go along with longer digits."""
    return (gram >> U(32)).astype(np.uint32) | np.uint32(1)


def stretches_meet(k: Keys, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of two documents, with the smaller one; grams with two stretches (they have no tag), without a value."""
    back, low = blocks.several(k, at, n)
    return back, np.where(k.check[at] > 0, low, U(0))


def halves_meet(k: Keys, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back, _ = blocks.several(k, at, n)
    return back, np.zeros(len(at), U)


def gram_runs(table: pa.Table, grams: Keys, depth: int):
    """The runs whose gram stands in two documents, with document and stretch hash."""
    ids, offsets, data = texts_of(table)
    for p in picks(offsets, data, depth):
        there, _ = find(grams, p.gram)
        if there.any():
            p, of = p.pick(there), p.hashed()
            yield p, ids[p.doc], of(p.lo, p.hi + depth)


def stretch_keys(table: pa.Table, grams: Keys, depth: int) -> Keys:
    """Pass 2: stretches with their documents, and grams with their stretches."""
    each = []
    for p, ids, whole in gram_runs(table, grams, depth):
        each += [distinct(mix(whole ^ STRETCH), tag(p.gram), ids), distinct(mix(p.gram ^ GRAM), None, whole)]
    k = joined(each)
    return distinct(k.key, k.check, k.low, k.high)


def shared_runs(table: pa.Table, shared: Keys, depth: int):
    """The runs that pass 2 has found something for: with document, hash function, the first document of the stretch, and whether the gram is contested."""
    ids, offsets, data = texts_of(table)
    for p in picks(offsets, data, depth):
        of = p.hashed()
        own, stretch = ids[p.doc], mix(of(p.lo, p.hi + depth) ^ STRETCH)
        contested, _ = find(shared, mix(p.gram ^ GRAM))
        there, at = find(shared, stretch, tag(p.gram))
        some = there | contested
        if some.any():
            first = np.where(there, shared.low[at], own) if len(shared.key) else own
            yield p.pick(some), own[some], of, first[some], contested[some]


def half_window_keys(table: pa.Table, shared: Keys, depth: int) -> Keys:
    """Pass 3: half windows of the first documents of contested stretches."""
    each = []
    for p, ids, of, first, contested in shared_runs(table, shared, depth):
        some = contested & (first == ids)
        p, ids = p.pick(some), ids[some]
        before, b, after, a = half_keys(p, of, depth)
        each += [distinct(b[before], None, ids[before]), distinct(a[after], None, ids[after])]
    k = joined(each)
    return distinct(k.key, k.check, k.low, k.high)


joined = blocks.joined


def open_windows(p: Picks, of, some: np.ndarray, halves: Keys, depth: int):
    """Windows that must be compared one by one: (run, first byte). Only of the runs `some`, and with a half that another document has."""
    before, b, after, a = half_keys(p, of, depth)
    half = (depth - gram_length(depth)) // 2
    before &= find(halves, b)[0]
    after &= find(halves, a)[0]
    # windows lo .. place - half have the half before the gram, windows place - half + 1 .. hi the half after it
    parts = [(before & some, p.lo, np.minimum(p.hi, p.place - half)), (after & some, np.maximum(p.lo, p.place - half + 1), p.hi)]
    run, at = [], []
    for use, lo, hi in parts:
        i = np.flatnonzero(use & (hi >= lo))
        n = hi[i] - lo[i] + 1
        run.append(np.repeat(i, n))
        at.append(np.repeat(lo[i] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    return np.concatenate(run), np.concatenate(at)


def window_keys(table: pa.Table, shared: Keys, halves: Keys, depth: int) -> Keys:
    """Pass 4: windows that no whole stretch has settled."""
    each = []
    for p, ids, of, first, contested in shared_runs(table, shared, depth):
        run, at = open_windows(p, of, contested & (first == ids), halves, depth)
        each.append(distinct(of(at, at + depth), tag(p.gram[run]), ids[run]))
    k = joined(each)
    return distinct(k.key, k.check, k.low, k.high)


def removed(table: pa.Table, shared: Keys, halves: Keys, windows: Keys, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, bytes, and which bytes go."""
    _, offsets, data = texts_of(table)
    change = np.zeros(len(data) + 1, np.int32)
    for p, ids, of, first, contested in shared_runs(table, shared, depth):
        gone = first < ids
        np.add.at(change, p.at + p.lo[gone], 1)
        np.add.at(change, p.at + p.hi[gone] + depth, -1)
        run, at = open_windows(p, of, contested & ~gone, halves, depth)
        there, i = find(windows, of(at, at + depth), tag(p.gram[run]))
        at = at[there & (windows.low[i] < ids[run])] if len(windows.key) else at[:0]
        np.add.at(change, p.at + at, 1)
        np.add.at(change, p.at + at + depth, -1)
    return offsets, data, np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, depth: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (the bytes left), span_starts and span_ends (the maximal removed runs, in bytes).

    A byte goes if a string of `depth` bytes that covers it also starts in a document with a smaller id. Texts are UTF-8 bytes, null is empty,
    no match crosses documents, and all is judged on the input. Rows with the same id count as one document and don't remove from each other; a null
    id is larger than any other. Other columns are not read. An empty table gives an empty result.
    """
    base, size = blocks.blocked(documents_of(docs, doc_id, text))
    keys = size * 2 / (depth - gram_length(depth) + 2)
    by = base.groupBy("block")

    def one(key, table):
        return blocks.sent(key[0].as_py(), gram_keys(table, depth), blocks.ranges(keys))

    def answers_of(table: pa.Table, n: int) -> list[Keys]:
        kind = table.column("pass").to_numpy()
        return [blocks.received(table.filter(pa.array(kind == i))) for i in range(n)]

    def together(known: list[DataFrame]):
        each = [d.withColumn("pass", F.lit(i)) for i, d in enumerate(known)]
        return by.cogroup(reduce(DataFrame.unionByName, each).groupBy("block"))

    def round_of(known: list[DataFrame], keys_of, rule, name: str) -> DataFrame:
        """What the ranges answer to the keys that blocks send, given the answers before."""
        n = len(known)

        def send(key, table, back):
            return blocks.sent(key[0].as_py(), keys_of(table, *answers_of(back, n), depth), blocks.ranges(keys))

        return written(blocks.answers(together(known).applyInArrow(send, blocks.SENT), rule), name)

    def first_round(key, table):
        return blocks.sent(key[0].as_py(), gram_keys(table, depth), blocks.ranges(keys))

    grams = written(blocks.answers(by.applyInArrow(first_round, blocks.SENT), grams_meet), "repeat-grams")
    shared = round_of([grams], stretch_keys, stretches_meet, "repeat-stretches")
    discard(grams)
    halves = round_of([shared], half_window_keys, halves_meet, "repeat-halves")
    windows = round_of([shared, halves], window_keys, blocks.several, "repeat-windows")

    def last(key, table, back):
        offsets, data, gone = removed(table, *answers_of(back, 3), depth)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], gone]), np.concatenate([gone, [False]])
        start = np.flatnonzero(after & (~before | edge))   # a removed byte begins a run after a kept byte or at a document's start
        end = np.flatnonzero(before & (~after | edge))
        kept_at = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        first = np.searchsorted(start, offsets)
        own = np.repeat(offsets[:-1], np.diff(first))
        lists = lambda a: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(a - own, pa.int64()))
        kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(data[~gone])])
        return pa.table([table.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), kept, lists(start), lists(end)], ["doc_id", "n_bytes", "kept", "span_starts", "span_ends"])

    return together([shared, halves, windows]).applyInArrow(last, "doc_id long, n_bytes long, kept binary, span_starts array<long>, span_ends array<long>")
