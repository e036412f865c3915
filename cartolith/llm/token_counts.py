"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import written

STEP = 1024   # lengths of one part of the suffix sums


def histogram(lengths: DataFrame, length: str = "n_tokens", by: Sequence[str] = ()) -> DataFrame:
    """One row per occurring length (and group): the group's columns, n_tokens, n_docs, docs_at_least, tokens_at_least, total_docs, total_tokens, kept_tokens, share.

    docs_at_least and tokens_at_least are suffix sums over documents of this length or more; kept_tokens is the corpus cut to a context of this many
    tokens; share is the part of documents that are no longer. Null lengths are left out; a null group value is a group. Rows are combined before
    the shuffle, so a group or a length that holds a third of them is one entry per task; what follows has a row per length, not per document.
    Sums run within parts of STEP lengths, and over the parts.
    """
    group = [f"by_{i}" for i in range(len(by))]
    base = lengths.select(*[F.col(c).alias(g) for c, g in zip(by, group)], F.col(length).cast("long").alias("n_tokens")).where("n_tokens IS NOT NULL")
    rows = written(base.groupBy(*group, "n_tokens").agg(F.count("*").alias("n_docs")), "lengths")   # what follows reads it twice; encoding ran once
    rows = rows.withColumn("part", F.expr(f"n_tokens DIV {STEP}"))
    rows = rows.withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    parts = rows.groupBy(*group, "part").agg(F.sum("n_docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    above = over.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select(*[F.col(g).alias(f"p_{g}") for g in group], F.col("part").alias("p_part"), zero(F.sum("part_docs").over(above)).alias("docs_above"), zero(F.sum("part_tokens").over(above)).alias("tokens_above"),
                         F.sum("part_docs").over(over).alias("total_docs"), F.sum("part_tokens").over(over).alias("total_tokens"))
    same = F.col("part") == F.col("p_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"p_{g}"))
    here = Window.partitionBy(*group, "part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(parts, same).withColumns({"docs_at_least": F.sum("n_docs").over(here) + F.col("docs_above"), "tokens_at_least": F.sum("tokens").over(here) + F.col("tokens_above")})
    return both.select(*[F.col(g).alias(c) for g, c in zip(group, by)], "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
                       (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("kept_tokens"),
                       ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share"))


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For a histogram without groups and each context limit: context_limit, kept_tokens, docs_cut, tokens_cut. The limits are a short list of the caller's."""
    out = [x for limit in limits for x in (
        F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(f"kept_{limit}"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias(f"cut_{limit}"))]
    one = hist.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("total"), *out)
    rows = F.array(*[F.struct(F.lit(x).cast("long").alias("context_limit"), F.col(f"kept_{x}").alias("kept_tokens"), F.col(f"cut_{x}").alias("docs_cut"), (F.col("total") - F.col(f"kept_{x}")).alias("tokens_cut")) for x in limits])
    return one.select(F.inline(rows))


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For a histogram without groups: share, n_tokens, the smallest length that at least this share of documents don't exceed (null if there are none)."""
    out = [F.min(F.when(F.col("share") >= s, F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    return hist.agg(*out).select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])))
