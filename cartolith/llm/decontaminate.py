"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.bpe import lists
from cartolith.llm.common import documents_of, written
from cartolith.llm.words import ALNUM, U, grams, parts, signed, words

# Every way to substitute 3 words of 16 leaves one of MASKS whole somewhere in the 16 (1: word counts, 0: ignored), so no overlap that passes
# the check below is missed for want of a seed. With NARROW the same holds for whole items of 9 to 15 words and a fifth of their words.
MASKS = ("1101111", "1100010111", "11110101")
NARROW = ("11010011", "110111")
WINDOW, SHARE = 16, 0.8
EDGE = 13        # equal words in a row that are enough where the document's edge cuts a window short
MIN_WORDS = 1    # of an item
BITS = 1 << 24   # of the filter that every task gets: 2 MB, whatever the benchmark's size


def shape(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


SHAPES = tuple(shape(m) for m in MASKS)
NARROW_SHAPES = tuple(shape(m) for m in NARROW)
WHOLE = {n: tuple(range(n)) for n in range(MIN_WORDS, 9)}   # shorter items: all of their words


def shapes_for(lengths: list[int]) -> list[tuple[int, tuple[int, ...], range]]:
    """(number, shape, numbers of words of the items that it is for), as far as items of these lengths need them."""
    every = [*[(s, range(9, 1 << 31)) for s in SHAPES], *[(s, range(9, WINDOW)) for s in NARROW_SHAPES], *[(s, range(n, n + 1)) for n, s in WHOLE.items()]]
    return [(k, s, r) for k, (s, r) in enumerate(every) if any(n in r for n in lengths)]


def seeds_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, seed, item_at) for every mask and place, and (item_id, words) with the hashes of an item's words."""
    base = documents_of(benchmark, item_id, text).withColumnRenamed("doc_id", "item_id")

    def seeds(batches):
        for batch in batches:
            for row, offsets, data in parts(batch.column(1)):
                w = words(offsets, data, ALNUM)
                n = np.diff(w.first)
                ids = batch.column(0).slice(row, len(offsets) - 1).to_numpy(zero_copy_only=False)
                for k, s, r in shapes_for(n.tolist()):
                    at, h = grams(w, s, k)
                    fits = (n[w.doc[at]] >= r.start) & (n[w.doc[at]] < r.stop)
                    at, h = at[fits], h[fits]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w.doc[at]], pa.int64(), from_pandas=True), pa.array(signed(h), pa.int64()), pa.array(at - w.first[w.doc[at]], pa.int32())], ["item_id", "seed", "item_at"])

    def whole(batches):
        for batch in batches:
            for row, offsets, data in parts(batch.column(1)):
                w = words(offsets, data, ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), lists(np.split(signed(w.hash), w.first[1:-1]), pa.int64())], ["item_id", "item_words"])

    base = base.where("item_id IS NOT NULL")
    return base.mapInArrow(seeds, "item_id long, seed long, item_at int"), base.mapInArrow(whole, "item_id long, item_words array<long>")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Which of BITS hash remainders occur among the seeds; at most BITS / 32 rows come to the driver."""
    rows = (seeds.select(F.expr(f"CAST(pmod(seed, {BITS}) AS INT)").alias("bit")).groupBy(F.expr("bit DIV 32").alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, bit % 32))").alias("bits")).toPandas())
    found = np.zeros(BITS // 32, np.uint32)
    found[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(found.view(np.uint8), bitorder="little").astype(bool)


def stretches(docs: DataFrame, present: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, first, words, at, seed: the words around places whose seed may be one of the benchmark, with those places and seeds.

    Stretches end where no such place follows within two windows."""
    packed = np.packbits(present)
    shapes = [(k, s) for k, s, _ in shapes_for(lengths)]

    def run(batches):
        here = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for row, offsets, data in parts(batch.column(1)):
                w = words(offsets, data, ALNUM)
                at, seed = [np.empty(0, np.int64)], [np.empty(0, U)]
                for k, s in shapes:
                    a, h = grams(w, s, k)
                    hit = here[h & U(BITS - 1)]
                    at.append(a[hit])
                    seed.append(h[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = w.doc[at]
                cut = np.flatnonzero((np.diff(at) > 2 * WINDOW) | (np.diff(doc) > 0)) + 1
                lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
                rows = doc[lo]
                first = np.maximum(at[lo] - WINDOW, w.first[rows])
                last = np.minimum(at[hi - 1] + 2 * WINDOW, w.first[rows + 1])
                ids = batch.column(0).take(pa.array(rows + row))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(first - w.first[rows], pa.int32()), lists([signed(w.hash[a:b]) for a, b in zip(first, last)], pa.int64()),
                    lists([at[a:b] - w.first[r] for a, b, r in zip(lo, hi, rows)], pa.int32()), lists([signed(seed[a:b]) for a, b in zip(lo, hi)], pa.int64())],
                    ["doc_id", "first", "words", "at", "seed"])

    return docs.mapInArrow(run, "doc_id long, first int, words array<long>, at array<int>, seed array<long>")


def best_window(doc: np.ndarray, first: int, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Along one alignment (document word = item word + shift): most equal words in a window, the window's length, and its first document word.

    Where the document begins or ends inside the item and leaves fewer words than a window, EDGE equal words in a row among them are enough. A stretch reaches a window's length beyond its seeds wherever the document goes on, so only the document's own edges cut windows short."""
    size = min(WINDOW, len(item))
    lo, hi = max(0, first - shift), min(len(item), first + len(doc) - shift)
    same = doc[lo + shift - first:hi + shift - first] == item[lo:hi]
    if hi - lo < size:
        at = np.flatnonzero(np.concatenate([[True], ~same, [True]])) if hi > lo else np.empty(0, np.int64)
        run = int(np.diff(at).max()) - 1 if len(at) > 1 else 0
        return (run, run, lo + shift + int(at[np.diff(at).argmax()])) if run >= EDGE else (0, size, -1)
    equal = np.concatenate([[0], np.cumsum(same)])
    sums = equal[size:] - equal[:-size]
    at = int(sums.argmax())
    return int(sums[at]), size, lo + shift + at


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, doc_word, equal_words, window: every alignment of a document and a benchmark item with a window of WINDOW words (or the whole
    of a shorter item) in which at least SHARE of the words are equal, place by place; where a document begins or ends inside an item and leaves less than
    a window, EDGE equal words in a row are enough.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters; items of up to 8 words are found word for word only, so an item of one
    common word is found in many documents. Null texts have no words; benchmark rows with a null id are left out. Only ids and texts are read.
    """
    base = documents_of(docs, doc_id, text)
    seeds, items = seeds_of(benchmark, item_id, item_text)
    lengths = [r.n for r in items.select(F.least(F.size("item_words"), F.lit(WINDOW)).alias("n")).distinct().collect()]   # at most WINDOW + 1 numbers
    found = written(stretches(base, seed_filter(seeds), lengths).withColumn("stretch", F.xxhash64("doc_id", "first", "words")), "stretches")
    hits = found.select("stretch", F.explode(F.arrays_zip("at", "seed")).alias("hit")).select("stretch", "hit.at", "hit.seed")
    lined = hits.join(seeds, "seed").select("stretch", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    both = lined.join(found.select("stretch", "doc_id", "first", "words"), "stretch").join(items, "item_id").select("doc_id", "item_id", "first", "words", "item_words", "shift")

    def check(batches):
        for batch in batches:
            keep, at, equal, size = [], [], [], []
            rows = [c.values.to_numpy() for c in (batch.column("words"), batch.column("item_words"))]
            ends = [c.offsets.to_numpy() for c in (batch.column("words"), batch.column("item_words"))]
            first, shift = batch.column("first").to_numpy(), batch.column("shift").to_numpy()
            for i in range(batch.num_rows):
                e, n, a = best_window(rows[0][ends[0][i]:ends[0][i + 1]], int(first[i]), rows[1][ends[1][i]:ends[1][i + 1]], int(shift[i]))
                if a >= 0 and e >= SHARE * n:
                    keep.append(i), at.append(a), equal.append(e), size.append(n)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("item_id"), pa.array(at, pa.int32()), pa.array(equal, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "item_id", "doc_word", "equal_words", "window"])

    return both.mapInArrow(check, "doc_id long, item_id long, doc_word int, equal_words int, window int").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items (benchmark items it overlaps with), item_id (the best, of equal ones the smallest), overlap (its share of equal words)."""
    share = F.col("equal_words") / F.col("window")
    best = (overlaps(docs, benchmark, doc_id, text, item_id, item_text).groupBy("doc_id", "item_id").agg(F.max(share).alias("share"))
            .groupBy(F.col("doc_id").alias("hit_id")).agg(F.count("*").alias("n_items"), F.max(F.struct("share", (-F.col("item_id")).alias("i"))).alias("b")))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    return ids.join(best, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), (-F.col("b.i")).alias("item_id"), F.coalesce("b.share", F.lit(0.0)).alias("overlap"))
