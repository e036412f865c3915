"""Repeat removal, the Jaccard join, components."""

import hashlib
import random
import re
from collections import Counter

import pytest

from cartolith.llm import blocks, jaccard, queries, repeats
from cartolith.llm.components import components


def brute_repeats(rows, depth):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for s in range(len(b) - depth + 1):
            first.setdefault(b[s:s + depth], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            if first[b[s:s + depth]] < i:
                gone[s:s + depth] = b"\1" * depth
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (len(b), bytes(x for x, g in zip(b, gone) if not g), spans)
    return out


@pytest.mark.parametrize("seed,depth", [(1, 50), (2, 24), (3, 50)])
def test_repeats(docs_of, odd_rows, monkeypatch, seed, depth):
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    monkeypatch.setattr(blocks, "PER_RANGE", 500)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    rnd = random.Random(seed)
    letters = ["ab", "abcdé", "abcdefgh "][seed % 3]
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(10, 200))) for _ in range(20)]
    piece = lambda: rnd.choice(pool)[rnd.randint(0, 20):] if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
    rows = [(i, None if rnd.random() < 0.05 else "".join(piece() for _ in range(rnd.randint(0, 6)))) for i in range(100, 220)]
    rows += [r for r in odd_rows if r[0] != 8] + [(1000, "ab" * 300), (1001, "ab" * 200 + "x" + "ab" * 100)]
    found = {r.doc_id: (r.n_bytes, bytes(r.kept), list(zip(r.span_starts, r.span_ends))) for r in repeats.remove_repeats(docs_of(rows), depth).collect()}
    want = brute_repeats(rows, depth)
    assert found == want
    assert sum(bool(s) for _, _, s in want.values()) > 50


def test_repeats_of_nothing_and_one_long_text(docs_of):
    assert repeats.remove_repeats(docs_of([])).collect() == []
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(400_000))
    found = {r.doc_id: (len(r.kept), list(zip(r.span_starts, r.span_ends))) for r in repeats.remove_repeats(docs_of([(1, long), (2, "x" + long[1000:300_000] + "y")])).collect()}
    assert found == {1: (400_000, []), 2: (2, [(1, 299_001)])}


def test_digests_of_kept_bytes(spark, sf):
    import pyarrow.parquet as pq
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    want = {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, (n, kept, spans) in brute_repeats(rows, 50).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_repeat_removal(spark, sf).collect()} == want


def test_keys_travel_whole():
    import numpy as np
    rnd = np.random.default_rng(1)
    k = blocks.distinct(rnd.integers(0, 2 ** 64, 500, np.uint64), rnd.integers(0, 3, 500).astype(np.uint32), rnd.integers(0, 9, 500).astype(np.uint64), None)
    sent = blocks.sent(7, k, 13)
    back = blocks.received(sent)
    assert all((getattr(back, f) == getattr(k, f)).all() for f in ("key", "check", "low", "high")) and len(sent) == 13


def sets(rows, size):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def brute_links(own, percent):
    ids, group = sorted(own), {i: i for i in own}
    for a in ids:
        for b in ids:
            if a < b and own[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b]) and group[a] != group[b]:
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    return group


def near_copies(rnd, n, longest):
    vocabulary, rows = [f"w{i}" for i in range(30)], []
    for i in range(n):
        if rows and rnd.random() < 0.75:
            w = rnd.choice(rows)[1].split()
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(w)) if w and rnd.random() < 0.5 else max(len(w) - 1, 0)
                w[at:at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] if rnd.random() < 0.7 else []
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, longest))]
        rows.append((i * 7 % 1009, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,longest,smallest", [(1, 25, None), (2, 60, 0), (3, 60, 20), (4, 140, None)])
def test_linked_classes(docs_of, odd_rows, monkeypatch, seed, longest, smallest):
    """Against all pairs; with the boundary as chosen, with inverted lists only, and with enumeration up to 20."""
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    if smallest is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: smallest)
    rows = near_copies(random.Random(seed), 200, longest) + [(i + 5000, t) for i, t in odd_rows]
    own = sets(rows, 4)
    group = brute_links(own, 85)
    found = jaccard.linked_classes(docs_of(rows)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), group[i]) for i, s in own.items()}
    assert len(set(group.values())) < len(own) - 20


@pytest.mark.parametrize("together", [512, 3])
def test_link_counts(docs_of, odd_rows, monkeypatch, together):
    """Links inside groups of near copies too, in one deal and in many."""
    monkeypatch.setattr(jaccard, "TOGETHER", together)
    rows = near_copies(random.Random(6), 150, 40) + [(i + 5000, t) for i, t in odd_rows] + [(7000 + i, " ".join(f"g{k}" for k in range(60)) + f" x{i % 9}") for i in range(40)]
    own = [(i, *sets([(i, t)], 4).values()) for i, t in rows]
    want = Counter()
    for k, (i, a) in enumerate(own):
        want[i, sum(1 for j, (_, b) in enumerate(own) if j != k and a and 100 * len(a & b) >= 85 * len(a | b))] += 1
    found = jaccard.linked_classes(docs_of(rows), counts=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in found) == want
    assert max(n for _, n in want) >= 39


def test_linked_classes_of_nothing(docs_of):
    assert jaccard.linked_classes(docs_of([])).collect() == []
    assert [tuple(r) for r in jaccard.linked_classes(docs_of([(5, None)])).collect()] == [(5, 0, 5, 5)]


def test_sizes():
    for a in range(1, 60):
        for b in range(1, 60):
            most = min(a, b)
            assert (b in jaccard.partners(a, 85)) == (100 * most >= 85 * (a + b - most))
            o = jaccard.needed(a, b, 85)
            assert 100 * o >= 85 * (a + b - o) and 100 * (o - 1) < 85 * (a + b - o + 1)


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(60), 100 + rnd.randrange(60)) for _ in range(40)] + [(300, 300 + i) for i in range(1, 30)] + [(500, 500)]
    group = {i: i for pair in links for i in pair}
    for _ in group:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: g for i, g in group.items() if i != 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
