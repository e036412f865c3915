"""N-gram Jaccard join: a size-aware join of shingle sets, with fixed-size subsets for small sets and inverted lists for large ones."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm import blocks
from cartolith.llm.blocks import Keys, distinct, find
from cartolith.llm.bpe import lists
from cartolith.llm.common import documents_of, written
from cartolith.llm.components import components
from cartolith.llm.words import NOT_SPACE, U, grams, mix, odd, parts, signed, words

SKETCHES, MINIMA = 4, 3   # of a set: so many groups of so many minima
TOGETHER = 512       # sets of a component that are compared at a time
LARGEST_SMALL = 48   # sizes for which a cost is worked out; enumeration beyond is never the cheaper way


def needed(a: int, b: int, percent: int) -> int:
    """Smallest intersection with which sets of a and b elements link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    """Sizes that a set of a elements can link with."""
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def prefix_length(n: int, percent: int) -> int:
    """So many first elements, in any order that all sets share, two linked sets can't both miss each other in."""
    return n - -(-percent * n // 100) + 1


def shingle_sets(column: pa.Array, size: int):
    """For each row the sorted distinct hashes of its shingles; with fewer words than `size`, of the whole sequence."""
    for _, offsets, data in parts(column):
        w = words(offsets, data, NOT_SPACE)
        at, h = grams(w, tuple(range(size)))
        count = np.diff(w.first)
        cuts = np.searchsorted(at, w.first[1:-1])
        own = np.split(h, cuts)
        for n in range(1, size):
            short = np.flatnonzero(count == n)
            if len(short):
                a, g = grams(w, tuple(range(n)), n)
                for row, x in zip(short, g[np.searchsorted(a, w.first[short])]):
                    own[row] = np.array([x], U)
        for s in own:
            yield np.unique(s)


def sketches(s: np.ndarray) -> np.ndarray:
    """Signatures that near copies often share: each from MINIMA smallest hashes."""
    with np.errstate(over="ignore"):
        least = [mix(s ^ U(0xD1B54A32D192ED03 * (i + 1) & (2 ** 64 - 1))).min() for i in range(SKETCHES * MINIMA)]
        rows = np.array(least, U).reshape(SKETCHES, MINIMA)
        return signed(mix((rows * odd(MINIMA, 7)).sum(axis=1, dtype=U)))


def text_column(table: pa.Table) -> pa.Array:
    c = table.column("text").combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def block_shingles(table: pa.Table, size: int) -> Keys:
    """The distinct shingles of a block with the number of its documents that have them."""
    h = np.sort(np.concatenate([np.empty(0, U), *shingle_sets(text_column(table), size)]))
    at = np.flatnonzero(np.concatenate([[True], np.diff(h) != 0])) if len(h) else np.empty(0, np.int64)
    n = np.diff(np.concatenate([at, [len(h)]])).astype(U)
    return Keys(h[at], np.zeros(len(at), np.uint32), n, n)


def in_several(k: Keys, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two documents or more go back with their number of documents."""
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, U)
    total = np.add.reduceat(k.low, at)
    return total >= 2, total


def sets_of(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, n (set size), and where a link is possible s1, s2 (128 bits of the set), shared (its shingles that other documents have, rarest first by
    documents, then by hash), prefix (how many of them stand in the prefix) and sketch. Shingles of one document only come first in that order and
    never match, so a set whose prefix holds nothing else has no link."""
    base, total = blocks.blocked(documents_of(docs, doc_id, text))
    by, keys = base.groupBy("block"), total / 6

    def send(key, table):
        return blocks.sent(key[0].as_py(), block_shingles(table, size), blocks.ranges(keys))

    common = written(blocks.answers(by.applyInArrow(send, blocks.SENT), in_several), "shingles")

    def make(_, table, back):
        known = blocks.received(back)
        n, s1, s2, shared, prefix, sketch = [], [], [], [], [], []
        for s in shingle_sets(text_column(table), size):
            there, at = find(known, s)
            own = s[there]
            p = prefix_length(len(s), percent) - (len(s) - len(own))
            possible = len(s) > 0 and p > 0
            n.append(len(s))
            s1.append(int(signed(mix(s ^ U(0x3C6EF372FE94F82B)).sum(dtype=U).reshape(1))[0]) if possible else None)
            s2.append(int(signed(mix(s ^ U(0xA54FF53A5F1D36F1)).sum(dtype=U).reshape(1))[0]) if possible else None)
            shared.append(signed(own[np.lexsort((own, known.low[at[there]]))]) if possible else np.empty(0, np.int64))
            prefix.append(p if possible else None)
            sketch.append(sketches(s) if possible else np.empty(0, np.int64))
        return pa.table([table.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists(shared, pa.int64()), pa.array(prefix, pa.int32()), lists(sketch, pa.int64())],
                        ["doc_id", "n", "s1", "s2", "shared", "prefix", "sketch"])

    return by.cogroup(common.groupBy("block")).applyInArrow(make, "doc_id long, n long, s1 long, s2 long, shared array<long>, prefix int, sketch array<long>")


def subset_cost(n: int, percent: int) -> int:
    return sum(comb(n, needed(n, b, percent)) for b in partners(n, percent) if needed(n, b, percent) <= min(n, b))


def boundary(meets: float, percent: int) -> int:
    """Sets up to this size are enumerated: as long as a set's subsets are fewer than the entries its prefix would meet in inverted lists."""
    b = 0
    while b < LARGEST_SMALL and subset_cost(b + 1, percent) <= max(prefix_length(b + 1, percent) * meets, 2):
        b += 1
    return b


def subset_links(reps: DataFrame, largest: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what small sets link. Two sets of x and y elements link if they share a subset of needed(x, y) elements, so sets
    with the same key (x, y, subset) need no further check; all go to the smallest id of the key."""
    def run(batches):
        drops: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            out = {c: [np.empty(0, np.int64)] for c in ("rep", "n", "x", "y", "k1", "k2")}
            for rep, n, shared in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("shared").to_pylist()):
                t = np.array(shared, np.int64).view(U)
                one, two = mix(t ^ U(0x510E527FADE682D1)), mix(t ^ U(0x9B05688C2B3E6C1F))
                for b in partners(n, percent):
                    o = needed(n, b, percent)
                    if b > largest or o > min(n, b, len(t)):
                        continue
                    if (len(t), o) not in drops:
                        drops[len(t), o] = np.array(list(combinations(range(len(t)), len(t) - o)), np.int64).reshape(comb(len(t), o), len(t) - o)
                    d = drops[len(t), o]
                    with np.errstate(over="ignore"):
                        k1, k2 = one.sum(dtype=U) - one[d].sum(axis=1, dtype=U), two.sum(dtype=U) - two[d].sum(axis=1, dtype=U)
                    for c, v in (("rep", rep), ("n", n), ("x", min(n, b)), ("y", max(n, b))):
                        out[c].append(np.full(len(k1), v, np.int64))
                    out["k1"].append(signed(k1))
                    out["k2"].append(signed(k2))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in out.values()], list(out))

    keyed = reps.where(F.col("n") <= largest).select("rep", "n", "shared").mapInArrow(run, "rep long, n long, x long, y long, k1 long, k2 long")
    key = ["x", "y", "k1", "k2"]
    heads = keyed.groupBy(*key).agg(F.min("rep").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets")).where("sets > 1 AND least = x AND most = y").drop("least", "most", "sets")
    return keyed.join(heads, key).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def comparable(a: Column, b: Column, percent: int) -> Column:
    """Sizes that can link at all."""
    return (a * percent <= b * 100) & (b * percent <= a * 100)


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link. Shared shingles hold every common one, so the intersection is exact."""
    left = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def sketch_links(reps: DataFrame, percent: int) -> DataFrame:
    """Links found by comparing each set with the smallest id of its signatures: most of what holds a group of near copies together, at a cost that
    is linear in the group. What they miss is for the lists to find."""
    signed_by = reps.select("rep", "n", F.posexplode("sketch").alias("i", "sketch"))
    heads = signed_by.groupBy("i", "sketch").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("sets")).where("sets > 1")
    pairs = signed_by.join(heads, ["i", "sketch"]).where((F.col("rep") != F.col("head.rep")) & comparable(F.col("n"), F.col("head.n"), percent))
    return verified(pairs.select(F.col("rep").alias("a"), F.col("head.rep").alias("b")).distinct(), reps, percent)


def list_links(postings: DataFrame, reps: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The links between sets that the known links (a, b) do not connect yet.

    postings (word, rep, n, at) are the inverted lists of prefixes; at is the word's place in its set. Sets of one component need no comparison, so a
    list's sets are compared only across components: those outside its largest component with all others. The positional filter leaves out pairs
    whose words from the shared one on are too few on either side; a linked pair passes it at its first shared word, so none is lost.
    """
    group = components(links)
    placed = written(postings.join(group, F.col("rep") == F.col("id"), "left").select("word", "rep", "n", "at", F.coalesce("component", "rep").alias("component")), "postings")
    sizes = placed.groupBy("word", "component").agg(F.count("*").alias("sets"))
    mixed = sizes.groupBy("word").agg(F.max(F.struct("sets", "component")).alias("top"), F.sum("sets").alias("all")).where("all > top.sets").select("word", F.col("top.component").alias("main"))
    others = placed.join(mixed, "word").where("component <> main")
    far = placed.select("word", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("component").alias("cb"))
    apart = (F.col("component") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("rep") < F.col("b")))
    enough = F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("at_b")) * (100 + percent) >= (F.col("n") + F.col("nb")) * percent
    pairs = others.join(far, "word").where(apart & comparable(F.col("n"), F.col("nb"), percent) & enough)
    return verified(pairs.select(F.col("rep").alias("a"), "b").distinct(), reps, percent)


def intersections(a: list[np.ndarray], b: list[np.ndarray], most: int = 1 << 13) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of presence matrices over so many elements at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    all_a, all_b = np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])
    both = np.intersect1d(all_a, all_b)
    at_a, at_b = np.searchsorted(both, all_a), np.searchsorted(both, all_b)
    for lo in range(0, len(both), most):
        parts_of = []
        for rows, at, values, n in ((row_a, at_a, all_a, len(a)), (row_b, at_b, all_b, len(b))):
            mine = (at >= lo) & (at < min(lo + most, len(both)))
            mine[mine] = both[at[mine]] == values[mine]
            x = np.zeros((n, min(most, len(both) - lo)), np.float32)
            x[rows[mine], at[mine] - lo] = 1
            parts_of.append(x)
        out += parts_of[0] @ parts_of[1].T
    return out.astype(np.int64)


def link_counts(reps: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(class, n_links): for the sets of found (class_id, docs, component_id) with a component of several sets, how many documents with other sets one of
    its documents links with. Links only lie inside components, so these are all.

    The sets of a component are dealt into blocks of about TOGETHER; each pair of blocks is compared in one task, which sends back a count per set, never
    a pair. So the work in a component grows with the square of its different texts, as the links do, and the rows with that square over TOGETHER.
    """
    sizes = found.groupBy("component_id").agg(F.count("*").alias("sets")).where("sets > 1").withColumnRenamed("component_id", "c")
    own = found.join(sizes, F.col("component_id") == F.col("c")).select("class_id", "docs", F.col("c"), F.ceil(F.col("sets") / TOGETHER).cast("int").alias("deals"))
    own = own.withColumn("deal", F.pmod(F.xxhash64("class_id"), F.col("deals")).cast("int"))
    sets = own.join(reps.select("rep", "n", "shared"), F.col("class_id") == F.col("rep")).select("class_id", "docs", "c", "deals", "deal", "n", "shared")
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    # components of one deal share tasks, as many as the sets ask for; of several, each pair of deals is a group
    tasks = max(1, ceil(found.count() / (8 * TOGETHER)))
    several = F.col("deals") > 1
    met = met.select("class_id", "docs", "c", "deal", "n", "shared", F.least("deal", "other").alias("x"), F.greatest("deal", "other").alias("y"),
                     F.when(several, F.col("c")).otherwise(-1 - F.pmod(F.xxhash64("c"), F.lit(tasks))).alias("task"))

    def count(table: pa.Table) -> pa.Table:
        ids, n, docs, comp = (table.column(c).to_numpy() for c in ("class_id", "n", "docs", "c"))
        deal, x, y = (table.column(c).to_numpy() for c in ("deal", "x", "y"))
        shared = [np.array(v, np.int64) for v in table.column("shared").to_pylist()]
        links = np.zeros(len(ids), np.int64)
        order = np.argsort(comp, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            a, b = rows[deal[rows] == x[rows]], rows[deal[rows] == y[rows]]
            for i in range(0, len(a), TOGETHER):
                for j in range(0, len(b), TOGETHER):
                    p, q = a[i:i + TOGETHER], b[j:j + TOGETHER]
                    both = intersections([shared[k] for k in p], [shared[k] for k in q])
                    linked = (100 * both >= percent * (n[p][:, None] + n[q][None, :] - both)) & (ids[p][:, None] != ids[q][None, :])
                    links[p] += linked @ docs[q]
                    if x[rows[0]] != y[rows[0]]:
                        links[q] += linked.T @ docs[p]
        return pa.table([table.column("class_id"), pa.array(links)], ["class", "links"])

    parts_of = met.groupBy("task", "x", "y").applyInArrow(count, "class long, links long")
    return parts_of.groupBy("class").agg(F.sum("links").alias("n_links"))


def linked_classes(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable by links), and with
    `counts` n_links, the number of other documents that it links with (those with the same set, too).

    A document's set holds its distinct shingles of `size` words (runs of other than white space, A-Z lower-cased), or the whole sequence if it has
    fewer words; a text without words, or null, has none and is linked with nothing. Two documents link when 100 * intersection >= percent * union.
    Rows with the same id and text count as one document more than once (and as links of each other); a null id gets null as class and component unless it has copies.
    Other columns are not read. An empty table gives an empty result. Shingles are told apart by 64-bit hashes, sets by 128 bits.
    """
    sets = written(sets_of(docs, size, percent, doc_id, text), "sets")
    some = sets.where("prefix IS NOT NULL AND doc_id IS NOT NULL")
    classes = written(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "classes")
    reps = written(some.join(classes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")))
                   .select("rep", "n", "shared", "prefix", "sketch").dropDuplicates(["rep"]), "set-reps")
    entries = reps.select("rep", "n", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("i", "word"), (F.col("n") - F.size("shared")).alias("own"))
    entries = entries.select("word", "rep", "n", (F.col("own") + F.col("i")).alias("at"))
    lengths = entries.groupBy("word").count().agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    largest = boundary((lengths[0] or 0) / max(lengths[1] or 0, 1), percent)
    near = -(-percent * (largest + 1) // 100)   # the smallest size that links with a large set
    heavy = entries.where(F.col("n") >= near)
    several = heavy.groupBy("word").agg(F.count("*").alias("sets")).where("sets > 1").select("word")
    postings = written(heavy.join(several, "word"), "postings")
    links = written(subset_links(reps, largest, percent).unionByName(sketch_links(reps, percent)).distinct(), "set-links")
    group = components(links.unionByName(written(list_links(postings, reps, links, percent), "list-links")))
    found = written(classes.join(group, F.col("rep") == F.col("id"), "left").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"), "docs"), "classes")
    if counts:
        links = link_counts(reps, found, percent)
        found = found.join(links, F.col("class_id") == F.col("class"), "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("docs") - 1)
    both = sets.select("doc_id", "n", "s1", "s2").join(found, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), "left")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return both.select(*out, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if counts else []))
