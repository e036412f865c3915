"""A Merkle manifest of a dataset: nodes labelled with the interval of leaf ranks that they cover.

Leaves get their rank within their group. A node of level k covers up to FAN^k ranks, so it holds a leaf just if its interval contains the leaf's rank,
and the siblings of a node are the nodes inside its parent's interval without its own. DEPTH levels are a tier: the nodes of a tier inside one interval
of WIDTH = FAN^DEPTH of them are a block, worked off together; the tops of the blocks are the nodes of the next tier. A containment join on the
interval's number within its tier attaches to every block the ancestors above it, from the last tier down. Leaves are shuffled by block twice, tops are
fewer by WIDTH; no group, whatever its size, is one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import written

FAN, DEPTH = 3, 8
WIDTH = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with lo, the rank within their grp, and total, the group's rows. A range-partitioned sort numbers the rows of each task; what comes before a
    task's stretch of a group is one number per stretch, so a hot group is sorted by many tasks."""
    keys = ["grp", *order, "row"]
    placed = (rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("row"))
    placed = written(placed, "ranked")
    runs = placed.groupBy("part", "grp").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    of = Window.partitionBy("grp")
    runs = runs.select(F.col("part").alias("r_part"), F.col("grp").alias("r_grp"), "start", F.sum("n").over(of).alias("total"),
                       F.coalesce(F.sum("n").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = placed.join(runs, (F.col("part") == F.col("r_part")) & F.col("grp").eqNullSafe(F.col("r_grp")))
    return both.withColumn("lo", F.col("before") + F.col("at") - F.col("start")).drop("part", "at", "start", "before", "r_part", "r_grp")


@dataclass
class Level:
    """The nodes of one level of a block, in order: where their intervals start, and their digests."""
    lo: list[int]
    digest: list[str]


def levels(nodes: Level, span: int, whole: bool) -> list[Level]:
    """The levels of a block over nodes whose intervals are `span` wide: up to one node if the block is its whole group, else always DEPTH more."""
    out = [nodes]
    while len(out[-1].lo) > 1 if whole else len(out) <= DEPTH:
        span *= FAN
        below, here = out[-1], Level([], [])
        at = 0
        for i in range(1, len(below.lo) + 1):
            if i == len(below.lo) or below.lo[i] // span != below.lo[at] // span:
                here.lo.append(below.lo[at] // span * span)
                here.digest.append(sha("".join(below.digest[at:i])))
                at = i
        out.append(here)
    return out


Steps = tuple[tuple[str, str], ...]   # from a node upwards: the digests before and after it among its siblings


def climbs(every: list[Level], span: int, above: Steps) -> Iterator[Steps]:
    """For each node of the lowest level the siblings on its way up: those in the parent's interval whose interval is another. Nodes share what is above them."""
    wide = span * FAN ** (len(every) - 1)
    up = {every[-1].lo[0] // wide: above}
    for level in reversed(every[:-1]):
        wide //= FAN
        children: dict[int, list[int]] = {}
        for i, lo in enumerate(level.lo):
            children.setdefault(lo // (wide * FAN), []).append(i)
        here = {}
        for parent, own in children.items():
            for i in own:
                here[level.lo[i] // wide] = (("".join(level.digest[j] for j in own if j < i), "".join(level.digest[j] for j in own if j > i)), *up[parent])
        up = here
    return iter(up.values()) if len(every) > 1 else iter([above])


def blocks_of(table: pa.Table, span: int) -> Iterator[tuple[str | None, int, int, list[int], list[int]]]:
    """(grp, block, total, rows in order, their lo) for each block in an Arrow table of nodes."""
    grp, lo, total = (table.column(c).to_pylist() for c in ("grp", "lo", "total"))
    order = sorted(range(len(lo)), key=lambda i: (grp[i] is not None, grp[i] or "", lo[i]))
    at = 0
    for k in range(1, len(order) + 1):
        i = order[at]
        if k == len(order) or grp[order[k]] != grp[i] or lo[order[k]] // (span * WIDTH) != lo[i] // (span * WIDTH):
            yield grp[i], lo[i] // (span * WIDTH), total[i], order[at:k], [lo[j] for j in order[at:k]]
            at = k


def bucketed(df: DataFrame, span: int, n: int) -> DataFrame:
    """bucket: equal for what lies in the same block; a bucket holds a few blocks' worth of nodes, whether groups are large or many."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("grp", F.expr(f"lo DIV {span * WIDTH}L")), F.lit(n)).cast("int"))


def buckets(nodes: int) -> int:
    return max(1, ceil(2 * nodes / WIDTH))


def tops(nodes: DataFrame, span: int, n: int) -> DataFrame:
    """(grp, lo, total, digest) of the block tops over nodes with the same columns."""
    def run(table):
        out = []
        for grp, block, total, rows, lo in blocks_of(table, span):
            digest = table.column("digest").take(pa.array(rows)).to_pylist()
            top = levels(Level(lo, digest), span, total <= span * WIDTH)[-1]
            out.append((grp, block * span * WIDTH, total, top.digest[0]))
        cols = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["grp", "lo", "total", "digest"])

    return bucketed(nodes.select("grp", "lo", "total", "digest"), span, n).groupBy("bucket").applyInArrow(run, "grp string, lo long, total long, digest string")


def attached(nodes: DataFrame, above: DataFrame, span: int, n: int, emit, schema: str) -> DataFrame:
    """emit(rows of a block as a table, hi of each, the row of `above` that holds the block, the way up of each) for every block of nodes. above has grp,
    lo, hi, left, right and more: the interval of each block's top and its way up. The join is one on the number of the interval, and checked by containment."""
    names, types = [f.split()[0] for f in schema.split(", ")], [ARROW[f.split()[1]] for f in schema.split(", ")]

    def run(table, heads):
        held: dict = {}
        for h in heads.to_pylist():
            held.setdefault(h["grp"], []).append(h)
        cols = [[] for _ in names]
        for grp, _, total, rows, lo in blocks_of(table, span):
            head = next(h for h in held[grp] if h["lo"] <= lo[0] < h["hi"])
            part = table.take(pa.array(rows))
            every = levels(Level(lo, part.column("digest").to_pylist()), span, total <= span * WIDTH)
            ways = climbs(every, span, tuple(zip(head["left"], head["right"])))
            for r in emit(part, [min(x + span, total) for x in lo], head, ways):
                for c, v in zip(cols, r):
                    c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names)

    return bucketed(nodes, span, n).groupBy("bucket").cogroup(bucketed(above, span, n).groupBy("bucket")).applyInArrow(run, schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
WAY = "grp string, lo long, hi long, top string, left array<string>, right array<string>"


def emit_ways(part, hi, head, ways):
    for grp, lo, h, way in zip(part.column("grp").to_pylist(), part.column("lo").to_pylist(), hi, ways):
        yield grp, lo, h, head["top"], [a for a, _ in way], [b for _, b in way]


def ancestry(nodes: DataFrame, span: int, count: int, largest: int) -> DataFrame:
    """(grp, lo, hi, top, left, right): for each block of nodes its interval, the group's top and the siblings from the block's own top upwards."""
    made = written(tops(nodes, span, buckets(count)), "tops")
    wide = span * WIDTH
    if largest <= wide:
        none = F.array().cast("array<string>")
        return made.select("grp", "lo", F.col("total").alias("hi"), F.col("digest").alias("top"), none.alias("left"), none.alias("right"))
    n = made.count()
    return attached(made, ancestry(made, wide, n, largest), wide, buckets(n), emit_ways, WAY)


def tree(nodes: DataFrame, emit, schema: str, more=lambda above: above) -> DataFrame:
    """emit's rows for all leaves (grp, lo, total, digest and more) of the trees of all groups; `more` may lengthen the ways of the tops."""
    n, largest = nodes.agg(F.count("*"), F.max("total")).first()
    above = written(ancestry(nodes, 1, n, largest or 0), "ancestry")
    return attached(nodes, written(more(above), "ways"), 1, buckets(n), emit, schema)


def groups_above(above: DataFrame) -> DataFrame:
    """The ways of blocks within their groups, lengthened by the way of the group's top (subroot) to the root over all groups in order."""
    subroots = written(above.where("lo = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("digest")), "subroots")

    def emit(part, hi, head, ways):
        for name, digest, way in zip(part.column("name").to_pylist(), part.column("digest").to_pylist(), ways):
            yield name, digest, head["top"], [a for a, _ in way], [b for _, b in way]

    up = tree(written(ranked(subroots, ["name"]), "subroots"), emit, "name string, subroot string, root string, more_left array<string>, more_right array<string>")
    return above.join(up, F.col("grp").eqNullSafe(F.col("name"))).select("grp", "lo", "hi", "subroot", "root", F.concat("left", "more_left").alias("left"), F.concat("right", "more_right").alias("right"))


def leaves(docs: DataFrame, doc_id: str, group: str, fields: tuple[str, ...], changed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, grp, digest and, with `changed` columns, other: the digest of the changed row where it is another."""
    other = F.lit(None).cast("string")
    if changed:
        differs = F.lit(False)
        for f, c in changed.items():
            differs = differs | ~c.cast("string").eqNullSafe(F.col(f).cast("string"))
        other = F.when(differs, leaf_digest([changed.get(f, F.col(f)) for f in fields]))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(group).cast("string").alias("grp"), leaf_digest([F.col(f) for f in fields]).alias("digest"), other.alias("other"))


def manifest(docs: DataFrame, doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of docs: doc_id, grp, lo (its rank; its interval is [lo, lo + 1)), total, leaf, subroot, root, left, right.

    A leaf is the digest of its fields, each `-` if null, else byte count, colon, value. Per group, leaves stand by doc_id (nulls first; equal ids by
    digest); while there are several nodes, each FAN consecutive ones become the digest of theirs. left and right are the digests of the siblings
    before and after, level by level up to the subroot and, through the tree over all subroots (null group first, then bytewise), to the root: folding
    leaf with them gives the root. A table of one row has no siblings. An empty table gives an empty result. Other columns are not read.
    """
    def emit(part, hi, head, ways):
        for i, grp, lo, total, leaf, way in zip(*(part.column(c).to_pylist() for c in ("doc_id", "grp", "lo", "total", "digest")), ways):
            yield i, grp, lo, total, leaf, head["subroot"], head["root"], [a for a, _ in way], [b for _, b in way]

    nodes = written(ranked(written(leaves(docs, doc_id, group, fields), "leaves"), ["doc_id", "digest"]), "nodes")
    return tree(nodes, emit, "doc_id long, grp string, lo long, total long, leaf string, subroot string, root string, left array<string>, right array<string>", groups_above)


def without_newlines(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """The tampering of the audit: rows whose id has an even CRC lose the line ends of their text."""
    even = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return {text: F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))}


def audit(docs: DataFrame, changed: dict[str, Column], doc_id: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. The tree is that of manifest(); proof_sha256 is the digest
    of all siblings on the way up; folded_root is folded from the leaf of the row as `changed` makes it. See manifest() for odd rows; a row with a
    null id stands first in its group, and what `changed` gives for it counts."""
    def emit(part, hi, head, ways):
        for i, leaf, other, way in zip(*(part.column(c).to_pylist() for c in ("doc_id", "digest", "other")), ways):
            now = other or leaf
            for a, b in way:
                now = sha(a + now + b)
            yield i, leaf, head["subroot"], head["root"], sha("".join(a + b for a, b in way)), now, now == head["root"]

    nodes = written(ranked(written(leaves(docs, doc_id, group, fields, changed), "leaves"), ["doc_id", "digest"]), "nodes")
    return tree(nodes, emit, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", groups_above)


def oracle(levels: int = 12) -> str:
    """DuckDB SQL for audit(documents, without_newlines()); groups of up to FAN^levels rows. CRC-32 goes bit by bit, as DuckDB has no function for it."""
    hashed = lambda text: "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [256 + ascii(d), 512, 512, 512, 512, 512, 512, 512, 512]))),
        lambda a, b: CASE WHEN b < 512 THEN xor(a, b - 256) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"""
    ctes = [f"d AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents)",
            f"n0 AS (SELECT doc_id, source AS g, {hashed('text')} AS d, {hashed('other')} AS o, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM d)"]

    def grow(name: str, first: str, leaf: str) -> None:
        for k in range(levels):
            n = f"{name}{k}"
            ctes.append(f"{name}s{k} AS (SELECT a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r "
                        f"FROM {n} a LEFT JOIN {n} b ON a.g IS NOT DISTINCT FROM b.g AND a.i // {FAN} = b.i // {FAN} AND a.i <> b.i WHERE a.c > 1 GROUP BY a.g, a.i)")
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // {FAN} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, (any_value(c) + {FAN - 1}) // {FAN} AS c FROM {n} WHERE c > 1 GROUP BY g, i // {FAN})")
            ctes.append(f"{leaf}{k + 1} AS (SELECT p.* REPLACE (p.i // {FAN} AS i, CASE WHEN s.l IS NULL THEN p.proof ELSE p.proof || s.l || s.r END AS proof, CASE WHEN s.l IS NULL THEN p.o ELSE sha256(s.l || p.o || s.r) END AS o) "
                        f"FROM {leaf}{k} p LEFT JOIN {name}s{k} s ON p.g IS NOT DISTINCT FROM s.g AND p.i = s.i)")

    ctes.append("p0 AS (SELECT doc_id, g, i, d AS leaf, o, '' AS proof FROM n0)")
    grow("n", "n0", "p")
    ctes.append("top AS (" + " UNION ALL ".join(f"SELECT g, d FROM n{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    ctes.append("m0 AS (SELECT 0 AS g, g AS name, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM top)")
    ctes.append(f"q0 AS (SELECT p.doc_id, p.leaf, m.d AS subroot, 0 AS g, m.i, p.o, p.proof FROM p{levels} p JOIN m0 m ON p.g IS NOT DISTINCT FROM m.name)")
    grow("m", "m0", "q")
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT d FROM m{k} WHERE c = 1" for k in range(levels + 1)) + ")")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, o AS folded_root, o = root.d AS verified FROM q{levels}, root"
