"""The pipeline against stages done by brute force."""

import hashlib
import re

import pyarrow.parquet as pq

import corpus_pipeline
from cartolith.llm import toxicity
from tests.llm.test_repeats_and_jaccard import brute_links, sets
from tests.llm.test_text_operators import brute_overlap


def test_pipeline(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    items = [r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    judged = toxicity.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    left = {r.doc_id: docs[r.doc_id] for r in judged if not r.toxic}
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in seen.values()}
    group = brute_links(sets(list(left.items()), 5), 80)
    left = {i: t for i, t in left.items() if group[i] == i}
    left = {i: t for i, t in left.items() if not any(brute_overlap(t, x) for x in items)}
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert found == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
    assert len(left) < len(docs)


def test_stages_keep_columns_and_nulls(spark, docs_of, odd_rows, sf):
    docs = docs_of(odd_rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for some in (docs, docs_of([])):
            out = stage(spark, some, sf)
            assert out.columns == docs.columns, name
            assert out.count() <= some.count()


def test_near_copies_at_the_threshold(spark, docs_of, sf):
    """One word of 50 differs: 0.804 by five words, 0.843 by four. Of 48: 0.796 by five."""
    def pair(first, n):
        w = [f"{'v' if n == 50 else 'w'}{i}" for i in range(n)]
        return [(first, " ".join(w)), (first + 1, " ".join([*w[:20], "other", *w[21:]]))]

    rows = pair(1, 50) + pair(3, 48)
    group = brute_links(sets(rows, 5), 80)
    left = {r.doc_id for r in corpus_pipeline.jaccard_stage(spark, docs_of(rows), sf).collect()}
    assert left == {i for i in group if group[i] == i} == {1, 3, 4}
