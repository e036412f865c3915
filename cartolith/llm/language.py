"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.bpe import slices
from cartolith.llm.common import worker_cache

SYMBOLS = 64   # 0: anything between words; 1-26: a-z; the rest: other letters by a fixed hash


def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    kept = worker_cache()
    if "symbols" not in kept:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = 27 + (c * 2654435761 >> 7) % (SYMBOLS - 27)
        table[ord("a"):ord("z") + 1] = np.arange(1, 27)
        kept["symbols"] = table
    return kept["symbols"]


def trigrams(text: str) -> np.ndarray:
    """The codes of all runs of three symbols, with a gap before, between and after words. Empty if the text has no letter."""
    s = symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    if not s.any():
        return np.empty(0, np.int32)
    s = np.concatenate([[0], s, [0]]).astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def letters(dims: int, seed: int) -> np.ndarray:
    """A random vector of +1 and -1 for each symbol."""
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.int8), (SYMBOLS, dims))


def bind(codes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The vector of each trigram: its letters' vectors, permuted once for each place from the end, multiplied."""
    a, b, c = codes // SYMBOLS ** 2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def bundle(codes: np.ndarray, counts: np.ndarray, base: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sums of trigram vectors, one row for each row of counts (rows x codes). Whole numbers, so exact whatever the order."""
    kind = np.float32 if counts.sum(axis=1).max(initial=0) < 2 ** 24 else np.float64
    total = np.zeros((len(counts), base.shape[1]), kind)
    for at in range(0, len(codes), block):
        total += counts[:, at:at + block].astype(kind) @ bind(codes[at:at + block], base).astype(kind)
    return total


def counted(texts: list[str], rows: int = 64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups: the first one's number, the trigrams that occur, counts (texts x trigrams)."""
    for at in range(0, len(texts), rows):
        each = [np.unique(trigrams(t), return_counts=True) for t in texts[at:at + rows]]
        codes = np.unique(np.concatenate([c for c, _ in each]))
        counts = np.zeros((len(each), len(codes)))
        for i, (c, n) in enumerate(each):
            counts[i, np.searchsorted(codes, c)] = n
        yield at, codes, counts


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    prototypes: np.ndarray   # languages x dims, of length 1
    base: np.ndarray


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 20) -> Profiles:
    """A prototype for each language: the bundle of all its documents' trigrams. Rows with a null text or language teach nothing.

    Tasks count trigrams, Spark adds the counts, and the driver gets at most languages x SYMBOLS^3 rows, however many documents there are."""
    def run(batches):
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            for part in slices(batch):
                found: dict[str, list[np.ndarray]] = {}
                for language, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found.setdefault(language, []).append(trigrams(t))
                for language, codes in found.items():
                    n = np.bincount(np.concatenate(codes), minlength=SYMBOLS ** 3)
                    total[language] = total[language] + n if language in total else n
            for language, n in total.items():
                codes = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes, pa.int32()), pa.array(n[codes], pa.int64())], ["lang", "code", "n"])

    rows = (docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
            .mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas())
    base = letters(dims, seed)
    languages = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy(np.int64))
    counts = np.zeros((len(languages), len(codes)))
    counts[np.searchsorted(languages, rows["lang"]) if languages else [], np.searchsorted(codes, rows["code"])] = rows["n"]
    sums = bundle(codes, counts, base).astype(np.float64)
    return Profiles(languages, sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300), base)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the prototype with the largest cosine (of equal ones the first by name), not below 0.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. Whole texts; only id and text are read."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                names, scores = [], []
                for _, codes, counts in counted(texts):
                    sums = bundle(codes, counts, profiles.base).astype(np.float64)
                    length = np.linalg.norm(sums, axis=1)
                    cosine = sums @ profiles.prototypes.T / np.maximum(length, 1e-300)[:, None]
                    for some, row in zip(counts.any(axis=1), cosine):
                        best = int(row.argmax()) if some and len(row) else None
                        names.append("und" if best is None else profiles.languages[best])
                        scores.append(0.0 if best is None else float(min(max(row[best], 0.0), 1.0)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str | Column = "doc_id", folds: int = 3) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo folds."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("long").cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = 1024) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents outside fold 1, predicted for all of them."""
    profiles = learn(docs.where(fold(doc_id) != 1), text, lang, dims)
    return predict(docs, profiles, doc_id, text).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
