"""Compression bands and the base counts against plain Python."""

import os
import random
import re

import pyarrow.parquet as pq
import zstandard

from cartolith.llm import queries, quality_bands
from cartolith.llm.quality_bands import Bands


def brute(text, bands=Bands()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    raw = text.encode()
    size = len(zstandard.ZstdCompressor(level=bands.level).compress(raw)) if raw else 0
    ratio = size / len(raw) if raw else None
    low, high = [x for s, x in zip(bands.starts, bands.limits) if len(raw) >= s][-1]
    out = []
    for i in range(0, len(raw) - bands.chunk + 1, bands.chunk):
        r = len(zstandard.ZstdCompressor(level=bands.level).compress(raw[i:i + bands.chunk])) / bands.chunk
        out.append(r < bands.chunk_limits[0] or r > bands.chunk_limits[1])
    stays = (ratio is None or low <= ratio <= high) and sum(out) <= bands.chunk_share * len(out)
    return (len(words), sum(len(w) for w in words), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed, not failed and stays)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_query_against_brute_force(spark, sf):
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_quality_bands(spark, sf).collect()}
    want = {r["doc_id"]: brute(r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    assert found == want
    assert 0 < sum(v[-1] for v in found.values()) < len(found)


def test_odd_rows(spark, docs_of, odd_rows):
    rows = odd_rows + [(None, "one"), (21, "a b\na b\n\n \n \na b \na b"), (22, "x y   z " * 9), (23, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8"), (24, "<a> & | #*$% é😀")]
    found = sorted((r.doc_id is not None, r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in quality_bands.rate(docs_of(rows)).collect())
    assert found == sorted((i is not None, i or 0, *brute(t)) for i, t in rows)
    assert quality_bands.rate(docs_of([])).collect() == []


def noise(rng, n):
    """Random characters of 14 bits, in words of 9."""
    return " ".join("".join(chr(rng.randrange(0x4E00, 0x8E00)) for _ in range(9)) for _ in range(n))


def test_bands_reject_flat_and_dense_texts(spark, docs_of):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    letters = "".join(chr(c) for c in range(33, 127))
    dense = lambda n: " ".join("".join(rng.choice(letters) for _ in range(40)) for _ in range(n))
    flat = " ".join(f"item {i} of" for i in range(3000, 4500))      # no window of 8 words repeats, yet it says little
    rows = [(1, prose(60)), (2, prose(400)), (3, prose(6000)), (4, dense(30)), (5, dense(400)), (6, flat), (7, prose(3000) + " " + dense(300)), (8, prose(9000) + " " + dense(30)), (9, os.urandom(30).hex() + " " + noise(rng, 300))]
    kept = {r.doc_id: r.kept for r in quality_bands.rate(docs_of(rows)).collect()}
    assert kept == {i: brute(t)[-1] for i, t in rows}
    assert [kept[i] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [True, True, True, False, False, False, False, True]


def test_report(spark, docs_of):
    rows = [(1, "a"), (2, "b c " * 400), (3, None), (4, "word " * 10)]
    report = {r.from_bytes: (r.n_docs, r.n_kept, r.n_too_flat, r.n_too_dense) for r in quality_bands.band_report(quality_bands.rate(docs_of(rows))).collect()}
    assert report == {0: (3, 0, 0, 1), 1024: (1, 0, 1, 0)}
