"""Exact quantiles by selection of ranks: histograms, refined only inside the bins that hold a wanted rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BINS = 1024     # of one pass over an interval
SMALL = 4096    # values of an interval that are sorted in one place


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: tuple[float, ...], discrete: bool = False) -> DataFrame:
    """(by, quantile, value) per group: between the two nearest values in proportion, or with ``discrete`` the first value whose share reaches the quantile.

    Every pass counts the values of each open interval in BINS bins and keeps, for each wanted rank, the bin that holds it, from its least to its largest
    value; intervals of SMALL values or fewer are sorted. So a group's state is its histogram, whatever its rows or distinct values, and passes are few:
    each one divides what is left by up to BINS. ``df`` is read once a pass. NULL and NaN are left out; a NULL group is a group; empty groups have no row."""
    from ..operators.aggregate import save_step
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    g = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.struct(F.lit(None).cast("int").alias("_none"))
    v = df.select(g.alias("_g"), F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    heads = v.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    asked = heads.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    pos = F.greatest(F.ceil(F.col("q") * F.col("n") - 1e-12) - 1, F.lit(0)).cast("double") if discrete else F.col("q") * (F.col("n") - 1)
    asked = save_step(asked.withColumn("pos", pos).withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")}), "ranks")
    left = asked.select("_g", F.explode(F.array("lo", "hi")).alias("rank"), "a", "b", F.lit(0).cast("long").alias("below"), F.col("n").alias("cnt")).distinct()

    def inside(open_: DataFrame) -> DataFrame:
        """(_g, a, b, v): the values of the open intervals; a group has two for each quantile at most."""
        each = open_.groupBy("_g").agg(F.collect_set(F.struct("a", "b")).alias("iv"))
        hit = F.filter("iv", lambda x: (F.col("v") >= x["a"]) & (F.col("v") <= x["b"]))
        return v.join(each, "_g").select("_g", "v", F.explode(hit).alias("x")).select("_g", "x.a", "x.b", "v")

    done = None
    while True:
        left = save_step(left, "ranks")
        few = left.where((F.col("a") < F.col("b")) & (F.col("cnt") <= SMALL))
        sorted_ = inside(few).groupBy("_g", "a", "b").agg(F.sort_array(F.collect_list("v")).alias("s"))
        picked = few.join(sorted_, ["_g", "a", "b"]).select("_g", "rank", F.element_at("s", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
        found = left.where("a = b").select("_g", "rank", F.col("a").alias("value")).unionByName(picked)
        done = found if done is None else done.unionByName(found)
        many = left.where((F.col("a") < F.col("b")) & (F.col("cnt") > SMALL))
        if many.isEmpty():
            break
        # halves first, so that no difference overflows
        at = F.least(F.floor((F.col("v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2) * BINS), F.lit(BINS - 1).cast("long"))
        bins = inside(many).withColumn("bin", at).groupBy("_g", "a", "b", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        w = Window.partitionBy("_g", "a", "b").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)   # BINS rows
        bins = bins.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
        nth = F.col("rank") - F.col("below") - F.col("before")
        left = many.join(bins, ["_g", "a", "b"]).where((nth >= 0) & (nth < F.col("c"))).select("_g", "rank", F.col("least").alias("a"), F.col("most").alias("b"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("cnt"))
    done = save_step(done, "ranks")
    ends = asked.select("_g", "q", "pos", "lo", "hi")
    for c in ("lo", "hi"):
        ends = ends.join(done.select("_g", F.col("rank").alias(c), F.col("value").alias(c + "_value")), ["_g", c])
    out = F.col("lo_value") + (F.col("pos") - F.col("lo")) * (F.col("hi_value") - F.col("lo_value"))
    return ends.select(*[F.col("_g")[c].alias(c) for c in by], F.col("q").alias("quantile"), out.alias("value"))
