"""Exact dedup, byte-level BPE, token counts, ring sharding."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cartolith.llm import bpe, exact_dedup, queries, sharding, token_counts
from check import compare


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return Counter((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, lambda c: F.unhex(F.lit("00"))], ids=["md5", "all collide"])
def test_exact_duplicates(docs_of, odd_rows, hashed):
    found = exact_dedup.exact_duplicates(docs_of(odd_rows), hashed=hashed)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == brute_groups(odd_rows)


def test_exact_duplicates_of_nothing(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    result, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert result.startswith("ok"), result


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_vocabulary_is_that_of_the_ranks():
    assert bpe.ranks_agree(bpe.default_files()[0], public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_digests(docs_of, odd_rows, reference, monkeypatch):
    rows = odd_rows + [(100 + i, "".join(random.Random(i).choice("ab é😀\n\t'sß1²Ⅷ漢字 <|endoftext|>") for _ in range(200))) for i in range(40)]
    monkeypatch.setattr(bpe, "MEMORY", 50)
    found = {r.doc_id: r for r in bpe.digests(docs_of(rows), *bpe.default_files()).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs_of([]), *bpe.default_files()).collect() == []


def test_encode_decode_and_offsets(docs_of, odd_rows, reference):
    tokens = bpe.encode(docs_of(odd_rows), *bpe.default_files(), offsets=True).cache()
    texts = dict(odd_rows)
    for r in tokens.collect():
        t = texts[r.doc_id] or ""
        assert r.ids == reference.encode_ordinary(t)
        whole = t.encode()
        assert (r.byte_ends or [0])[-1] == len(whole) and (r.char_ends or [0])[-1] == len(t)
        assert all(c == sum((b & 0xC0) != 0x80 for b in whole[:e]) for e, c in list(zip(r.byte_ends, r.char_ends))[:50])
    back = {r.doc_id: bytes(r.data) for r in bpe.decode(tokens, *bpe.default_files()).collect()}
    assert back == {i: (t or "").encode() for i, t in odd_rows}


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "STEP", 4)
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, 0, 1, 5, 5, 5, 17, 40])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, n_tokens long")
    for by in ([], ["g"]):
        found = token_counts.histogram(df, by=by).collect()
        for r in found:
            mine = [n for g, n in rows if n is not None and (not by or g == r.g)]
            assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (mine.count(r.n_tokens), sum(n >= r.n_tokens for n in mine), sum(n for n in mine if n >= r.n_tokens))
            assert (r.total_docs, r.total_tokens, r.kept_tokens) == (len(mine), sum(mine), sum(min(n, r.n_tokens) for n in mine))
            assert r.share == sum(n <= r.n_tokens for n in mine) / len(mine)
        assert len(found) == len({(g if by else 0, n) for g, n in rows if n is not None})
    mine = [n for _, n in rows if n is not None]
    hist = token_counts.histogram(df)
    assert [tuple(r) for r in token_counts.at_limits(hist, [0, 6, 100]).collect()] == [(x, sum(min(n, x) for n in mine), sum(n > x for n in mine), sum(max(n - x, 0) for n in mine)) for x in (0, 6, 100)]
    assert [r.n_tokens for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()] == [sorted(mine)[(len(mine) + 1) // 2 - 1], 40]
    assert token_counts.histogram(df.where("false")).collect() == []
    assert [r.kept_tokens for r in token_counts.at_limits(token_counts.histogram(df.where("false")), [7]).collect()] == [0]


def test_shards(docs_of, odd_rows):
    rows = odd_rows + [(i, f"text {i}") for i in range(100, 900)]
    found = sharding.shard(docs_of(rows), shards=7, virtual=16).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    for r in found:
        assert (r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 16, zlib.crc32((texts[r.doc_id] or "").encode()))
    by = {s: sorted(r.slot for r in found if r.shard == s) for s in range(7)}
    assert all(slots == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(docs_of([])).collect() == []
    assert len(sharding.shard(docs_of(rows[:3]), shards=40).collect()) == 3


def test_ring_serves_keys_like_one_by_one(docs_of):
    """Bounded loads: keys in ring order go to the first shard clockwise with room."""
    rows = [(i, "x") for i in range(500)]
    for slack in (0.0, 0.1):
        found = sharding.shard(docs_of(rows), shards=5, virtual=8, slack=slack).collect()
        ring = sharding.ring(5, 8)
        room, used = sharding.capacities(500, 5, slack), [0] * 5
        want = Counter()
        for arc, n in sorted(Counter(r.arc for r in found).items()):
            for _ in range(n):
                at = arc
                while used[ring.owner[at % len(ring.owner)]] >= room[ring.owner[at % len(ring.owner)]]:
                    at += 1
                s = ring.owner[at % len(ring.owner)]
                used[s] += 1
                want[arc, s] += 1
        assert Counter((r.arc, r.shard) for r in found) == want
        assert max(used) <= max(room)


def test_growth_moves_little(docs_of):
    """With slack, one more shard moves about its share and some overflow, not everything."""
    rows = [(i, None) for i in range(4000)]
    one = {r.doc_id: r.shard for r in sharding.shard(docs_of(rows), shards=10, slack=0.25).collect()}
    two = {r.doc_id: r.shard for r in sharding.shard(docs_of(rows), shards=11, slack=0.25).collect()}
    moved = sum(one[i] != two[i] for i in one) / len(rows)
    assert moved < 0.3
    assert sharding.ring(11).place != sharding.ring(10).place and set(sharding.ring(10).place) < set(sharding.ring(11).place)
