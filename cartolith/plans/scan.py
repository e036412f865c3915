"""Ordered work per key (numbers, ranks, running and moving values) without one task per key.

A plain window puts all rows of a key into one task, which is right as long as the
largest key is small.  One count per key tells; beyond ROWS_PER_BLOCK rows the order
columns are cut into blocks by bounds from a small random sample, as many as the
largest key needs: the block number rises with the order, so results are exact for any
bounds.  Windows then run per (key, block); one row per (key, block) carries totals
across blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BLOCK = 1_000_000
PER_BOUND = 40       # rows sampled on the driver for each bound
CHUNK = 100_000      # rows per chunk of a moving window, or twice the frame if that is more


def _spec(order: list[str]) -> list[tuple[str, bool]]:
    """'-name' sorts downwards."""
    return [(c[1:], False) if c.startswith("-") else (c, True) for c in order]


def sort_columns(order: list[str]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in _spec(order)]


def blocks_needed(df: DataFrame, by: list[str]) -> int:
    """How many blocks the rows of the largest key ask for."""
    rows = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return max(1, math.ceil(rows / ROWS_PER_BLOCK))


def block_column(df: DataFrame, by: list[str], order: list[str]) -> Column | bool:
    """Block number that never falls as the order goes on (ties share a block); False where every key is small.

    Counting and sampling run ``df``; callers with a costly plan take the column from
    cheaper rows of the same columns and pass it on as ``block``."""
    blocks = blocks_needed(df, by)
    if blocks == 1:
        return False
    spec = _spec(order)
    same = all(up == spec[0][1] for _, up in spec)
    cols = [c for c, _ in spec] if same else [spec[0][0]]
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    rows = df.select(*cols).orderBy(F.rand(11)).limit(blocks * PER_BOUND).collect()   # a few rows per block, only to place the bounds
    rows = sorted(tuple(r) for r in rows if all(v is not None for v in r))
    step = max(1, len(rows) // blocks)
    bounds = sorted(set(rows[step::step]))
    if not bounds:
        return F.lit(0)
    types = [df.schema[c].dataType for c in cols]
    made = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types))]) for b in bounds]
    # bounds in groups: first the group, then the place in it
    wide = math.isqrt(len(made)) + 1
    groups = [made[i:i + wide] for i in range(0, len(made), wide)]
    g = F.size(F.filter(F.array(*[x[0] for x in groups]), lambda b: b <= key))
    n = F.when(g == 0, F.lit(0)).otherwise((g - 1) * wide + F.size(F.filter(F.element_at(F.array(*[F.array(*x) for x in groups]), F.greatest(g, F.lit(1))), lambda b: b <= key)))
    n = F.when(F.col(cols[0]).isNull(), F.lit(0)).otherwise(n)
    return n if spec[0][1] else -n


def ranked(df: DataFrame, by: list[str], order: list[str], *names: str, block: Column | bool | None = None) -> DataFrame:
    """Add row_number, rank, dense_rank, percent_rank and / or cume_dist per key."""
    names = names or ("row_number",)
    sort = sort_columns(order)
    block = block_column(df, by, order) if block is None else block
    if block is False:
        w = Window.partitionBy(*by).orderBy(*sort)
        plain = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}
        return df.select(*df.columns, *[plain[n]().over(w).alias(n) for n in names])
    d = df.withColumn("_block", block)
    w = Window.partitionBy(*by, "_block").orderBy(*sort)
    d = d.withColumn("_rn", F.row_number().over(w)).withColumn("_rk", F.rank().over(w)).withColumn("_dr", F.dense_rank().over(w))
    if "cume_dist" in names:
        d = d.withColumn("_le", F.max("_rn").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    total = d.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_c"), F.max("_dr").alias("_d"))
    back = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = (total.withColumn("_c0", F.coalesce(F.sum("_c").over(back), F.lit(0))).withColumn("_d0", F.coalesce(F.sum("_d").over(back), F.lit(0)))
             .withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))))
    d = _carry(d, total.drop("_c", "_d"), by)
    rank = F.col("_c0") + F.col("_rk")
    made = {"row_number": F.col("_c0") + F.col("_rn"), "rank": rank, "dense_rank": F.col("_d0") + F.col("_dr"),
            "percent_rank": F.when(F.col("_n") > 1, (rank - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0)),
            "cume_dist": (F.col("_c0") + F.col("_le")) / F.col("_n") if "cume_dist" in names else None}
    return d.select(*df.columns, *[made[n].alias(n) for n in names])


def _carry(d: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Join the one-row-per-(key, block) totals back (NULL keys included)."""
    l, r = d.alias("l"), totals.alias("r")
    on = F.col("l._block") == F.col("r._block")
    for c in by:
        on = on & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    extra = [c for c in totals.columns if c not in by and c != "_block"]
    return l.join(r, on).select("l.*", *[F.col(f"r.`{c}`") for c in extra])


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals per key: ``sums`` maps new column to source column; the order must be unique per key."""
    block = block_column(df, by, order)
    if block is False:
        w = Window.partitionBy(*by).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(s).over(w).alias(n) for n, s in sums.items()])
    d = df.withColumn("_block", block)
    w = Window.partitionBy(*by, "_block").orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    total = d.groupBy(*by, "_block").agg(*[F.sum(s).alias("_t" + n) for n, s in sums.items()])
    back = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "_block", *[F.sum("_t" + n).over(back).alias("_o" + n) for n in sums])
    d = _carry(d.withColumns({n: F.sum(s).over(w) for n, s in sums.items()}), total, by)
    return d.select(*df.columns, *[(F.coalesce(F.col("_o" + n), F.lit(0)) + F.col(n)).alias(n) for n in sums])


def windowed(df: DataFrame, by: list[str], order: list[str], columns: dict, before: int = 0, after: int = 0, chunk: int = CHUNK,
             block: Column | bool | None = None) -> DataFrame:
    """Lag, lead and moving frames: ``columns`` maps names to ``fn(window) -> Column``.

    Rows are numbered per key and cut into chunks; the rows a neighbour chunk needs
    (``before`` / ``after`` of them) are copied there, so frames are complete."""
    block = block_column(df, by, order) if block is None else block
    if block is False:
        w = Window.partitionBy(*by).orderBy(*sort_columns(order))
        return df.select(*df.columns, *[fn(w).alias(n) for n, fn in columns.items()])
    chunk = max(chunk, 2 * max(before, after))
    d = ranked(df, by, order, "row_number", block=block).withColumnRenamed("row_number", "_rn")
    c = F.floor((F.col("_rn") - 1) / chunk)
    at = (F.col("_rn") - 1) % chunk
    copies = [F.struct(c.alias("c"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(at >= chunk - before, F.struct((c + 1).alias("c"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when((at < after) & (c > 0), F.struct((c - 1).alias("c"), F.lit(False).alias("own"))))
    d = d.withColumn("_z", F.explode(F.filter(F.array(*copies), lambda z: z.isNotNull()))).withColumn("_chunk", F.col("_z.c"))
    w = Window.partitionBy(*by, "_chunk").orderBy("_rn")
    d = d.withColumns({n: fn(w) for n, fn in columns.items()}).where("_z.own")
    return d.select(*df.columns, *columns)


def last_before(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, block: Column | bool | None = None) -> DataFrame:
    """Add the last non-NULL ``value`` of the rows before each row; the order must be unique per key."""
    block = block_column(df, by, order) if block is None else block
    if block is False:
        w = Window.partitionBy(*by).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, F.last(value, ignorenulls=True).over(w).alias(name))
    d = df.withColumn("_v", value).withColumn("_block", block)
    w = Window.partitionBy(*by, "_block").orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*[F.col(c) for c, _ in _spec(order)])
    pick = F.max_by if _spec(order)[0][1] else F.min_by
    total = d.groupBy(*by, "_block").agg(pick("_v", F.when(F.col("_v").isNotNull(), key)).alias("_b"))
    back = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "_block", F.last("_b", ignorenulls=True).over(back).alias("_p"))
    d = _carry(d.withColumn("_l", F.last("_v", ignorenulls=True).over(w)), total, by)
    return d.select(*df.columns, F.coalesce("_l", "_p").alias(name))
