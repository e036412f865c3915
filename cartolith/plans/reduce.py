"""Merging many geometries per key without ever holding a whole group.

Round 1 merges inside the partitions as they are (a map-side combine for
geometry), round 2 brings pieces of one key and one neighbourhood together,
round 3 brings the pieces of one key together.  Every round sorts its
partitions and streams over them, so a key that owns most rows is spread over
all tasks of round 1 and memory holds a few partial results only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codec import decode, encode
from ..layer import GEOM, bbox_of

FAN_IN = 32       # partial results merged at once
ROWS_OUT = 256    # rows per output batch


class _Tree:
    """Merges like a counter: FAN_IN results of one rank become one of the next."""

    def __init__(self, merge_many):
        self.merge_many, self.ranks = merge_many, []

    def add(self, g, rank=0):
        while len(self.ranks) <= rank:
            self.ranks.append([])
        self.ranks[rank].append(g)
        if len(self.ranks[rank]) >= FAN_IN:
            merged, self.ranks[rank] = self.merge_many([self.ranks[rank]])[0], []
            self.add(merged, rank + 1)

    def rest(self):
        """What is left to merge, and whether anything was merged before."""
        return [g for r in self.ranks for g in r], len(self.ranks) > 1


def _merger(merge_many: Callable, single: Callable, n_keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, keys, lists, ready, schema = None, None, [], [], [], None

        def close():
            left, merged = tree.rest()
            keys.append(key)
            done = None if len(left) > 1 else (left[0] if merged else single(left[0])) if left else None
            ready.append(done)
            lists.append(left if len(left) > 1 else None)

        def flush():
            open_ = [i for i, l in enumerate(lists) if l is not None]
            for i, g in zip(open_, merge_many([lists[i] for i in open_]) if open_ else ()):
                ready[i] = g
            cols = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(n_keys)]
            out = pa.RecordBatch.from_arrays([*cols, encode(ready)], names=names)
            keys.clear(); lists.clear(); ready.clear()
            return out

        for batch in batches:
            schema = batch.schema
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
            for k, g in zip(rows, decode(batch.column(n_keys))):
                if tree is None or k != key:
                    if tree is not None:
                        close()
                        if len(keys) >= ROWS_OUT:
                            yield flush()
                    key, tree = k, _Tree(merge_many)
                if g is not None and g[1]:
                    tree.add(g)
        if tree is not None:
            close()
            yield flush()

    return run


def _neighbourhood(geom: Column) -> Column:
    """Coarse cell of the lower-left corner, sized to the piece itself."""
    b = bbox_of(geom)
    side = F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    size = F.pow(F.lit(4.0), F.when(side > 0, F.ceil(F.ln(side) / 1.3862943611198906)).otherwise(F.lit(-10)) + 2)
    return F.when(b.isNotNull(), F.xxhash64(size, F.floor(b["xmin"] / size), F.floor(b["ymin"] / size)))


def merge_by_key(df: DataFrame, keys: list[str], geom: str, merge_many: Callable, single: Callable | None = None) -> DataFrame:
    """One row per key with its geometries merged (NULL and empty ones are skipped).

    ``merge_many`` takes lists of geometries and returns one geometry per list; it
    must be associative.  ``single`` is its cheap form for one geometry."""
    work = df.select(*[F.col(f"`{k}`") for k in keys], F.col(geom).alias("geom"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[:-1]] + [f"geom {GEOM}"])
    names = [*keys, "geom"]
    first = _merger(merge_many, single or (lambda g: merge_many([[g]])[0]), len(keys), names)
    again = _merger(merge_many, lambda g: g, len(keys), names)   # later rounds see merged pieces only
    # a fixed number keeps the costly merges spread even when the rows are few
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(f"`{k}`") for k in keys]

    def place(d, run):
        b = bbox_of(F.col("geom"))
        return d.sortWithinPartitions(*order, b["xmin"], b["ymin"]).mapInArrow(run, schema)

    local = place(work, first)
    near = place(local.repartition(n, *order, _neighbourhood(F.col("geom"))), again)
    return place(near.repartition(n, *order), again)
