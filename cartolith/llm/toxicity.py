"""Toxicity by a classifier chain: linear models in a row, each one fed with the probabilities of those before it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.bpe import lists
from cartolith.llm.common import documents_of, written
from cartolith.llm.words import ALNUM, LOWER, NOT_SPACE, U, mix, parts, words

DIMS = 1 << 22        # hashed features
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 4_000        # labelled documents that the models learn from, at most
FOLDS = 3
FEATURES = 300        # of a model, at most
LEAST_Z = 4.0
LEAST_ROWS = 5        # that a feature occurs in
OFTEN = 3
RIDGE = 0.3


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a part: each word, its prefixes by bytes, and the last three bytes of each run without spaces. Not distinct."""
    padded = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    w, runs = words(offsets, data, ALNUM), words(offsets, data, NOT_SPACE)
    rows, found = [w.doc], [w.hash]
    length = w.end - w.start
    heads = np.ascontiguousarray(eight[w.start]).view("<u8").ravel() if len(w.start) else np.empty(0, U)
    with np.errstate(over="ignore"):
        for n in PREFIXES:
            some = length > n
            mask = U(2 ** 64 - 1) if n == 8 else U((1 << 8 * n) - 1)
            rows.append(w.doc[some])
            found.append(mix((heads[some] & mask) + U(n) * U(0x9E3779B97F4A7C15)))
        some = runs.end - runs.start >= 3
        tails = np.ascontiguousarray(eight[runs.end[some] - 3]).view("<u8").ravel() if some.any() else np.empty(0, U)
        rows.append(runs.doc[some])
        found.append(mix((tails & U((1 << 24) - 1)) + U(3)))
    return np.concatenate(rows), (np.concatenate(found) & U(DIMS - 1)).astype(np.int64)


def often(found: np.ndarray) -> np.ndarray:
    """The feature that says that another one occurs OFTEN times or more."""
    return (found * 2654435761 + 97) % DIMS


def distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), in order, with a second feature for those that a row holds OFTEN times."""
    key, n = np.unique(rows * DIMS + found, return_counts=True)
    many = key[n >= OFTEN]
    key = np.union1d(key, many // DIMS * DIMS + often(many % DIMS))
    return key // DIMS, key % DIMS


@dataclass
class Linear:
    """Logistic regression on the presence of some features and on `extra` numbers."""
    chosen: np.ndarray    # sorted feature numbers
    weights: np.ndarray   # of the chosen, then of the extra numbers, then the constant

    def logits(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.concatenate([x, extra], axis=1) @ self.weights[:-1] + self.weights[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def matrix(rows: np.ndarray, found: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    """Presence (rows x chosen) from distinct (row, feature)."""
    x = np.zeros((n, len(chosen)))
    if len(chosen):
        at = np.searchsorted(chosen, found).astype(np.int32)
        at[at == len(chosen)] = 0
        some = chosen[at] == found
        x[rows[some], at[some]] = 1
    return x


def fit(rows: np.ndarray, found: np.ndarray, kinds: int, y: np.ndarray, extra: np.ndarray, use: np.ndarray) -> Linear:
    """One model, from the rows of `use`: features (below kinds) that are far more or less frequent where y holds, then ridge-penalised Newton steps."""
    n, p = max(int(use.sum()), 1), float(y[use].mean()) if use.any() else 0.0
    few = np.empty(0, np.int64)
    if not 0 < p < 1:   # one class, or no rows: its share is all there is to say
        return Linear(few, np.concatenate([np.zeros(extra.shape[1]), [np.log((p * n + 0.5) / ((1 - p) * n + 0.5)) if use.any() else -30.0]]))
    mine = use[rows]
    f, hit = found[mine], y[rows[mine]]
    total = np.bincount(f, minlength=kinds)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(np.bincount(f, weights=hit, minlength=kinds) - total * p) / np.sqrt(total * p * (1 - p))
    z[total < LEAST_ROWS] = 0
    order = np.lexsort((np.arange(kinds)[z >= LEAST_Z], -z[z >= LEAST_Z]))[:FEATURES]
    chosen = np.sort(np.flatnonzero(z >= LEAST_Z)[order])
    mine &= np.isin(found, chosen, kind="table" if kinds < 1 << 24 else None)
    x = np.concatenate([matrix(rows[mine], found[mine], len(y), chosen)[use], extra[use], np.ones((n, 1))], axis=1)
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y[use] - q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(chosen, w)


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def candidates(held: DataFrame, n: int) -> list[int]:
    """The features that some model may choose: for each category, and for all rows or all but a fold, the FEATURES whose frequency where the category holds is
    farthest from chance. Counted by Spark; FEATURES x categories x (folds + 1) numbers come to the driver, whatever the texts hold."""
    rows = held.withColumn("fold", fold_of(F.col("doc_id")))
    uses = [None, *range(FOLDS)]
    there = lambda k: F.lit(True) if k is None else F.col("fold") != k
    shares = rows.agg(*[F.count_if(there(k)).alias(f"n{j}") for j, k in enumerate(uses)], *[F.count_if(there(k) & (F.col(f"y{i}") == 1)).alias(f"p{i}_{j}") for i in range(n) for j, k in enumerate(uses)]).first()
    each = rows.select("fold", *[f"y{i}" for i in range(n)], F.explode("f").alias("feature")).groupBy("feature").agg(
        *[F.count_if(there(k)).alias(f"t{j}") for j, k in enumerate(uses)], *[F.count_if(there(k) & (F.col(f"y{i}") == 1)).alias(f"h{i}_{j}") for i in range(n) for j, k in enumerate(uses)])
    each = written(each.where(F.col("t0") >= LEAST_ROWS), "feature-counts")   # rarer ones can't be chosen; most are
    best = None
    for i in range(n):
        for j in range(len(uses)):
            p = shares[f"p{i}_{j}"] / shares[f"n{j}"] if shares[f"n{j}"] else 0.0
            if not 0 < p < 1:
                continue
            t = F.col(f"t{j}")
            z = F.abs(F.col(f"h{i}_{j}") - t * p) / F.sqrt(t * p * (1 - p))
            one = each.where(t >= LEAST_ROWS).select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z * (1 - 1e-9)).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature")
            best = one if best is None else best.unionByName(one)
    return [] if best is None else sorted(r.feature for r in best.distinct().collect())


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Linear]:
    """A model for each category (name: condition on the columns of labels), in order.

    Learned from at most `sample` labelled documents, those with the smallest hash of their id; labels with a null category or id teach nothing.
    The probabilities that a later model sees in training are out of fold: from models that have not seen the document.
    """
    names = list(categories)
    rows = labels.select(F.col(doc_id).cast("long").alias("label_id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).dropna()
    some = rows.groupBy("label_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    texts = documents_of(docs, doc_id, text).join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))   # at most `sample` rows are broadcast
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])   # of several texts of an id the least

    def run(batches):
        for batch in batches:
            for row, offsets, data in parts(batch.column("text")):
                n = len(offsets) - 1
                r, f = distinct(*features(offsets, data))
                cuts = np.searchsorted(r, np.arange(1, n))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), *(batch.column(f"y{i}").slice(row, n) for i in range(len(names))), lists(np.split(f, cuts), pa.int32())], ["doc_id", *(f"y{i}" for i in range(len(names))), "f"])

    schema = "doc_id long, " + "".join(f"y{i} int, " for i in range(len(names))) + "f array<int>"
    held = written(texts.mapInArrow(run, schema), "features")
    wanted = candidates(held, len(names))
    here = F.array(*map(F.lit, wanted)) if wanted else F.array().cast("array<int>")
    got = held.withColumns({"f": F.array_intersect("f", here), "fold": fold_of(F.col("doc_id"))}).toArrow().sort_by("doc_id")   # at most `sample` rows with FEATURES numbers for each model and fold
    n = got.num_rows
    ids, ys = got.column("doc_id").to_numpy().astype(np.int64), [got.column(f"y{i}").to_numpy().astype(float) for i in range(len(names))]
    own = [np.array(f, np.int64) for f in got.column("f").to_pylist()]
    at, kept = np.repeat(np.arange(n, dtype=np.int32), [len(f) for f in own]), np.array(sorted(wanted), np.int64)
    found = np.searchsorted(kept, np.concatenate([np.empty(0, np.int64), *own])).astype(np.int32)
    fold = got.column("fold").to_numpy().astype(int)
    extra, models = np.zeros((n, 0)), []
    for i in range(len(names)):
        m = fit(at, found, len(kept), ys[i], extra, np.ones(n, bool))
        models.append(Linear(kept[m.chosen], m.weights))
        if i + 1 < len(names):
            unseen = np.zeros(n)
            for k in range(FOLDS):
                m = fit(at, found, len(kept), ys[i], extra, fold != k)
                own = fold == k
                unseen[own] = sigmoid(m.logits(matrix(at, found, n, m.chosen), extra)[own])
            extra = np.concatenate([extra, unseen[:, None]], axis=1)
    return models


def score(docs: DataFrame, models: list[Linear], names: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and p_<name> for each category: whole texts, null as empty. A document's probabilities are computed in the chain's order."""
    wanted = np.unique(np.concatenate([m.chosen for m in models]))

    def run(batches):
        here = np.zeros(DIMS, bool)
        here[wanted] = True
        here |= here[often(np.arange(DIMS))]   # a feature also counts where only its being frequent does
        for batch in batches:
            for row, offsets, data in parts(batch.column("text")):
                n = len(offsets) - 1
                r, f = features(offsets, data)
                some = here[f]
                r, f = distinct(r[some], f[some])
                extra = np.zeros((n, 0))
                for m in models:
                    p = sigmoid(m.logits(matrix(r, f, n, m.chosen), extra))
                    extra = np.concatenate([extra, p[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), *(pa.array(extra[:, i], pa.float64()) for i in range(len(models)))], ["doc_id", *(f"p_{c}" for c in names)])

    return documents_of(docs, doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in names))


def categories() -> dict[str, Column]:
    """The chain over the given labels: low quality first, then toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, p_low_quality, p_toxic, toxic (p_toxic at or over the threshold; of labelled clean documents almost none reaches it). Without labels nothing is toxic."""
    chain = categories()
    models = learn(docs, labels, chain, doc_id, text, sample)
    return score(docs, models, list(chain), doc_id, text).withColumn("toxic", F.col("p_toxic") >= threshold)
