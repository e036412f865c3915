"""Aggregates of the query builder and the statistical tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def group_concat(c: str, separator: str = ",", distinct: bool = False) -> Column:
    """Values as text in sorted order, joined by a separator."""
    d = "DISTINCT " if distinct else ""
    return F.expr(f"listagg({d}CAST(`{c}` AS STRING), '{separator}') WITHIN GROUP (ORDER BY CAST(`{c}` AS STRING))")


def total(c: str) -> Column:
    """Sum that is 0.0 for no rows."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


AGGREGATES = {
    "max": F.max, "min": F.min, "avg": F.avg, "count": F.count, "sum": F.sum, "total": total, "group_concat": group_concat,
    "var_pop": F.var_pop, "var_samp": F.var_samp, "stddev_pop": F.stddev_pop, "stddev_samp": F.stddev_samp,
    "variance": F.variance, "median": F.median, "mode": F.mode, "collect": F.collect_list,
}


def aggregate(df: DataFrame, by: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """``aggs`` maps a new column to (aggregate name, source column)."""
    return df.groupBy(*by).agg(*[AGGREGATES[f](c).alias(n) for n, (f, c) in aggs.items()])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs in long form."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))




def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson statistic of a contingency table with its degrees of freedom."""
    cells = crosstab(df, a, b)
    rows, cols = cells.groupBy(a).agg(F.sum("n").alias("r")), cells.groupBy(b).agg(F.sum("n").alias("c"))
    n = cells.agg(F.sum("n").cast("double").alias("t")).scalar()
    # cells with no rows add their expected count; these sum to n minus the expected counts of the filled cells
    full = cells.join(rows, a).join(cols, b).withColumn("e", F.col("r") * F.col("c") / n)
    s = full.agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("s"), F.sum("e").alias("e"))
    dof = (rows.agg(F.count(F.lit(1)) - 1).scalar() * cols.agg(F.count(F.lit(1)) - 1).scalar())
    return s.select((F.col("s") + n - F.col("e")).alias("statistic"), dof.alias("dof"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance from group moments."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"),
              F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("n") * F.col("m") * F.col("m")
    return t.select((between / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_value"),
                    (F.col("k") - 1).alias("dof_between"), (F.col("n") - F.col("k")).alias("dof_within"))


def ks_two_sample(df: DataFrame, group: str, first, second, value: str) -> DataFrame:
    """Largest gap between the distribution functions of two groups (grouped by value first)."""
    from ..plans.scan import running
    d = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    per = d.groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    n = d.agg(F.count_if(F.col(group) == first).cast("double").alias("na"), F.count_if(F.col(group) == second).cast("double").alias("nb"))
    cum = running(per, [], [value], {"ca": "a", "cb": "b"})
    na, nb = n.select("na").scalar(), n.select("nb").scalar()
    return cum.agg(F.max(F.abs(F.col("ca") / na - F.col("cb") / nb)).alias("statistic"))
