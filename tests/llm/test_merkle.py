"""The manifest against a plain tree in Python."""

import hashlib
import zlib

import pyarrow.parquet as pq
import pytest

from cartolith.llm import merkle, queries


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def grown(digests, fan=3):
    """The top, and for each digest the (before, after) siblings on its way up."""
    ways = [[] for _ in digests]
    level, under = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        new, above = [], []
        for at in range(0, len(level), fan):
            run = level[at:at + fan]
            for k in range(len(run)):
                for i in under[at + k]:
                    ways[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            new.append(H("".join(run)))
            above.append([i for u in under[at:at + fan] for i in u])
        level, under = new, above
    return level[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: grown([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, up = grown([made[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, up):
        for (_, _, d, r), way in zip(sorted(groups[g], key=lambda x: x[:3]), made[g][1]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, proof = leaf(r, text), ""
            for a, b in [*way, *above]:
                now, proof = H(a + now + b), proof + a + b
            out.append((r["doc_id"], d, made[g][0], root, H(proof), now, now == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query_against_plain_tree(spark, sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = found(queries.op11_merkle_manifest(spark, sf))
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string, grp string, lo string, total string, digest string, other string, part string, row string, bucket string, name string"
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], schema).repartition(3) if rows else spark.createDataFrame([], schema)


def named(rows):
    return [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r)) for r in rows]


ODD = [(1, None, None, None, None), (2, "", "en", 0, ""), (None, "a", "en", 3, "x\ny"), (None, "a", "en", 3, "x\ny"), (3, "a", None, 3, "x\ny"), (3, "a", None, 3, "x\ny"), (3, "a", None, 4, "other"),
       (-7, "é", "fr", 1, "😀\n"), (8, "é", "fr", 1, "😀\n" * 40000), *[(100 + i, "z", "de", i, f"line\n{i}") for i in range(29)], *[(500 + i, f"s{i}", "de", i, "\n") for i in range(11)]]


def test_odd_rows(spark):
    assert found(merkle.audit(table(spark, ODD), merkle.without_newlines())) == plain(named(ODD))
    assert found(merkle.audit(table(spark, []), merkle.without_newlines())) == []
    one = [(5, "only", "en", 1, "a\n")]
    assert found(merkle.audit(table(spark, one), merkle.without_newlines())) == plain(named(one))


@pytest.mark.parametrize("n", [9, 10, 27, 28, 81, 82, 250])
def test_tiers(spark, n, monkeypatch):
    """Blocks of nine leaves, so that a few rows make several tiers and last runs of one node."""
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    rows = [(i * 7 % 1009, "big", "en", 1, f"t\n{i}") for i in range(n)] + ([(2000 + i, f"s{i}", "en", 1, "\n") for i in range(12)] if n == 82 else [])
    assert found(merkle.audit(table(spark, rows), merkle.without_newlines())) == plain(named(rows))


def test_manifest(spark):
    rows = merkle.manifest(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) and len({r.root for r in rows}) == 1
    for r in rows:
        now = r.leaf
        for a, b in zip(r.left, r.right):
            now = H(a + now + b)
        assert now == r.root
    z = sorted((r for r in rows if r.grp == "z"), key=lambda r: r.lo)
    assert [(r.lo, r.total, r.doc_id) for r in z] == [(i, 29, 100 + i) for i in range(29)]
