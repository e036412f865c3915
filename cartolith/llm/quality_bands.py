"""Quality rules by compression: zstandard ratios of whole documents and of fixed chunks, with limits that depend on the length."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import documents_of

WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SPAN = 8          # words of a window that counts as repeated
MIN_WORDS = 20
REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / plain bytes. Row i of `limits` holds for texts of starts[i] bytes and more: (smallest, largest ratio). A short text pays for
    its frame and has no earlier text to refer to, so its ratios are higher. A text whose whole ratio is out of its band goes; so does one with more
    than chunk_share of its full chunks out of chunk_limits, which finds long junk that the rest of a long text hides."""
    starts: tuple[int, ...] = (0, 64, 128, 256, 512, 1024, 2048, 8192)
    limits: tuple[tuple[float, float], ...] = ((0.0, 9.0), (0.5, 1.2), (0.4, 1.02), (0.3, 0.92), (0.25, 0.85), (0.2, 0.8), (0.18, 0.75), (0.15, 0.72))
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (0.18, 0.75)
    chunk_share: float = 0.2
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        return self.limits[bisect_right(self.starts, n) - 1]


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * self.n_words


def repeated_words(ids: np.ndarray, span: int = SPAN) -> int:
    """Words inside windows of `span` (a power of two) words that stand in the text twice or more. Windows get equal numbers just if their words are
    equal: numbers of twice the width come from pairs of numbers, so nothing is hashed."""
    n = len(ids) - span + 1
    if n < 2:
        return 0
    width = 1
    while width < span:
        pairs = ids[:-width] * np.int64(len(ids) + 1) + ids[width:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    cover = np.zeros(n + span, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + span, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str, raw: bytes) -> Base:
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(m.group(), len(number)) for m in WORD.finditer(raw)), np.int64)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            again += line in seen
            seen.add(line)
    return Base(len(ids), len(text) - sum(text.count(c) for c in WHITE), sum(text.count(c) for c in SYMBOLS), again, repeated_words(ids))


def verdict(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[int, int, int, int, bool]:
    """(compressed bytes, full chunks, of these too repetitive, of these incompressible, whether the text stays)."""
    size = len(packer.compress(raw)) if raw else 0
    low, high = bands.of(len(raw))
    fits = low <= size / len(raw) <= high if raw else True
    chunks = len(raw) // bands.chunk
    flat = noise = 0
    if chunks:
        view = memoryview(raw)
        for i in range(chunks):
            r = len(packer.compress(view[i * bands.chunk:(i + 1) * bands.chunk])) / bands.chunk
            flat += r < bands.chunk_limits[0]
            noise += r > bands.chunk_limits[1]
    return size, chunks, flat, noise, fits and flat + noise <= bands.chunk_share * chunks


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bytes long, zstd_bytes long, n_chunks long, flat_chunks long, noise_chunks long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def rate(docs: DataFrame, bands: Bands = Bands(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bytes, zstd_bytes, n_chunks, flat_chunks, noise_chunks.

    kept is false if the base rules fail (fewer than 20 words, or over 30 % of them in repeated windows of 8), else the compression bands decide.
    flat_chunks and noise_chunks count full chunks under and over the chunk limits; bytes after the last full chunk count in the whole ratio only.
    Null and empty texts have no words and fail. Rows with the same id are rated one by one; a null id stays null; an empty table gives an empty
    result; other columns are not read. Every text is read whole. There is no shuffle: a text's figures depend on that text alone, so neither equal
    texts nor hot sources matter, and a lost executor costs its tasks only. A task holds one batch of texts and, per word of one text, 8 bytes.
    """
    def run(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                raw = t.encode()
                b = base_counts(t, raw)
                size, chunks, flat, noise, stays = verdict(raw, bands, packer)
                rows.append((i, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.failed, not b.failed and stays, len(raw), size, chunks, flat, noise))
            cols = list(zip(*rows)) if rows else [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, c in zip(NAMES, cols)], NAMES)

    return documents_of(docs, doc_id, text).mapInArrow(run, FIELDS)


def band_report(rated: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """For the rows of rate(), per length band: from_bytes, n_docs, n_kept, n_too_flat, n_too_dense (whole texts beyond the band's limits) and the mean
    ratio; for choosing limits. Bands without documents have no row. Texts without bytes have no ratio."""
    start = F.lit(bands.starts[0])
    low, high = F.lit(bands.limits[0][0]), F.lit(bands.limits[0][1])
    for s, (a, b) in zip(bands.starts[1:], bands.limits[1:]):
        here = F.col("n_bytes") >= s
        start, low, high = F.when(here, F.lit(s)).otherwise(start), F.when(here, F.lit(a)).otherwise(low), F.when(here, F.lit(b)).otherwise(high)
    ratio = F.when(F.col("n_bytes") > 0, F.col("zstd_bytes") / F.col("n_bytes"))
    return (rated.select(start.cast("long").alias("from_bytes"), "kept", ratio.alias("r"), (ratio < low).alias("flat"), (ratio > high).alias("dense")).groupBy("from_bytes")
            .agg(F.count("*").alias("n_docs"), F.count_if("kept").alias("n_kept"), F.count_if("flat").alias("n_too_flat"), F.count_if("dense").alias("n_too_dense"), F.avg("r").alias("mean_ratio")))
