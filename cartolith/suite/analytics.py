"""Queries of the table side: builder, windows, set operations, statistics, profiles, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import native as N, scalars as SC
from ..operators import profile as PR, statistics as ST, tables as T
from ..plans.ranks import exact_quantiles
from ..plans.scan import ranked, running, windowed
from .registry import query


def t(spark, sf, name):
    return fx.table(spark, sf, name)


# ---------------------------------------------------------------- builder, previews

@query("builder_query", "SELECT n_name, count(*) AS n, sum(s_acctbal) AS total FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY n_name ORDER BY n_name".replace("sum(s_acctbal)", "round(sum(s_acctbal), 2)"))
def builder_query(spark, sf):
    spec = T.QuerySpec(["n_name", "count(*) AS n", "round(sum(s_acctbal), 2) AS total"], {"supplier": t(spark, sf, "supplier"), "nation": t(spark, sf, "nation")},
                       "s_nationkey = n_nationkey AND s_acctbal > 0", ["n_name"], ["n_name"])
    return spec.to_df(spark)


@query("builder_operators", """SELECT p_partkey FROM part WHERE (p_type LIKE 'STANDARD%' OR p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 10 AND 30) AND p_size <> 20
    AND p_name IS NOT NULL AND NOT p_retailprice < 950 AND regexp_matches(p_brand, '[1-3]$') AND p_brand GLOB 'Brand#?*' AND p_name || '!' >= ''""")
def builder_operators(spark, sf):
    p = t(spark, sf, "part")
    w = """(p_type LIKE 'STANDARD%' OR p_brand IN ('Brand#1', 'Brand#2') AND p_size BETWEEN 10 AND 30) AND p_size <> 20
        AND p_name IS NOT NULL AND NOT p_retailprice < 950 AND p_brand REGEXP '[1-3]$' AND p_name || '!' >= ''"""
    return T.subset(p, w).where(T.glob("p_brand", "Brand#?*")).select("p_partkey")


@query("builder_subqueries", """SELECT c_custkey FROM customer c WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)
    AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def builder_subqueries(spark, sf):
    """ALL as a maximum, EXISTS as a semi join, NOT IN with its rules for NULL."""
    c = t(spark, sf, "customer")
    top = t(spark, sf, "supplier").where("s_nationkey = 3").agg(F.coalesce(F.max("s_acctbal"), F.lit(float("-inf")))).scalar()
    o = t(spark, sf, "orders").where("o_totalprice > 1000").select(F.col("o_custkey").alias("c_custkey"))
    n = t(spark, sf, "nation").where("n_regionkey = 1")
    return T.not_in(c.where(F.col("c_acctbal") > top).join(o, "c_custkey", "left_semi"), "c_nationkey", n, "n_nationkey").select("c_custkey")


@query("attribute_columns", "SELECT parcel_id, p_brand, p_type FROM parcels", "parcels")
def attribute_columns(spark, sf):
    return T.select_attributes(fx.parcels(spark, sf))


@query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS _uid_ FROM orders")
def row_ids(spark, sf):
    return T.with_row_id(t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("preview_text", "SELECT parcel_id::VARCHAR AS parcel_id, p_brand, 'POLYGON' AS geom FROM parcels", "parcels")
def preview_text(spark, sf):
    return T.preview(fx.parcels(spark, sf).select("parcel_id", "p_brand", "geom"))


@query("preview_page", "SELECT o_orderkey, left(o_orderpriority, 300) AS o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 201 OFFSET 201")
def preview_page(spark, sf):
    return T.page(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), 1, ["o_orderkey"])


@query("map_preview", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def map_preview(spark, sf):
    return T.map_preview(t(spark, sf, "orders").select("o_orderkey"), order=["o_orderkey"])


@query("distinct_values", "SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 10")
def distinct_values(spark, sf):
    return T.distinct_values(t(spark, sf, "part"), "p_type")


# ---------------------------------------------------------------- joins and set operations

SLICES = 16   # of a nation in sql_joins


@query("sql_joins", """SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal
    UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'right', count(*) FROM orders RIGHT JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'full', count(*) FROM part FULL JOIN lineitem ON p_partkey = l_partkey AND p_size > 25 UNION ALL SELECT 'using', count(*) FROM nation JOIN (SELECT r_regionkey AS n_regionkey FROM region) USING (n_regionkey)
    UNION ALL SELECT 'lateral', count(*) FROM nation, LATERAL (SELECT 1 FROM region WHERE r_regionkey = n_regionkey) z""")
def sql_joins(spark, sf):
    c, s, o, p, l, n, r = (t(spark, sf, x) for x in ("customer", "supplier", "orders", "part", "lineitem", "nation", "region"))
    # a nation's pairs are spread over SLICES tasks: its customers are dealt out by their key, its suppliers copied
    cs = c.withColumn("slice", F.pmod(F.xxhash64("c_custkey"), F.lit(SLICES)).cast("int"))
    ss = s.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    ones = {"inner": cs.join(ss.hint("merge"), (cs.c_nationkey == ss.s_nationkey) & (cs.slice == ss.copy) & (cs.c_acctbal < ss.s_acctbal)), "left": c.join(o, c.c_custkey == o.o_custkey, "left"),
            "right": o.join(c, c.c_custkey == o.o_custkey, "right"), "full": p.join(l, (p.p_partkey == l.l_partkey) & (p.p_size > 25), "full"),
            "using": n.join(r.select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey"),
            "lateral": spark.sql("SELECT n_name FROM {n} n, LATERAL (SELECT 1 FROM {r} WHERE r_regionkey = n.n_regionkey) z", n=n, r=r)}
    out = None
    for k, d in ones.items():
        one = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("set_operations", """SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    UNION ALL SELECT 'except all', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf):
    c, s, o = t(spark, sf, "customer"), t(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), t(spark, sf, "orders")
    nk = lambda d: d.select(F.col("c_nationkey").alias("k"))
    parts = {"union": T.set_operation(nk(c.where("c_acctbal > 0")), s, "union"), "intersect": T.set_operation(nk(c.where("c_acctbal > 9000")), s, "intersect"),
             "except": T.set_operation(o.select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "except"),
             "except all": T.set_operation(nk(c), s, "except", True)}
    out = None
    for k, d in parts.items():
        one = d.select(F.lit(k).alias("kind"), F.col("k").cast("long").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- aggregates

@query("builder_aggregates", """SELECT l_returnflag, max(l_quantity) AS mx, min(l_quantity) AS mn, round(avg(l_discount), 8) AS av, count(l_tax) AS n, round(sum(l_extendedprice), 2) AS sm,
    round(coalesce(sum(l_tax), 0), 2) AS tot, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS gc, round(var_pop(l_quantity), 5) AS vp, round(var_samp(l_quantity), 5) AS vs,
    round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY 1""")
def builder_aggregates(spark, sf):
    l = t(spark, sf, "lineitem")
    out = ST.aggregate(l, ["l_returnflag"], {"mx": ("max", "l_quantity"), "mn": ("min", "l_quantity"), "av": ("avg", "l_discount"), "n": ("count", "l_tax"), "sm": ("sum", "l_extendedprice"),
                                             "tot": ("total", "l_tax"), "vp": ("var_pop", "l_quantity"), "vs": ("var_samp", "l_quantity"), "sp": ("stddev_pop", "l_quantity"), "ss": ("stddev_samp", "l_quantity")})
    gc = l.groupBy("l_returnflag").agg(ST.group_concat("l_linestatus", ",", True).alias("gc"))
    digits = {"av": 8, "sm": 2, "tot": 2, "vp": 5, "vs": 5, "sp": 6, "ss": 6}
    return out.join(gc, "l_returnflag").withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("more_aggregates", """SELECT o_orderpriority, round(corr(o_totalprice, o_custkey), 8) AS cr, round(covar_pop(o_totalprice, o_custkey), 1) AS cp, round(covar_samp(o_totalprice, o_custkey), 1) AS cs,
    round(median(o_totalprice), 4) AS md, round(quantile_cont(o_totalprice, 0.9), 4) AS pc, quantile_disc(o_totalprice, 0.25) AS pd, arg_min(o_totalprice, o_orderkey) AS f, arg_max(o_totalprice, o_orderkey) AS l,
    count(DISTINCT o_custkey) AS nd, round(variance(o_totalprice), 0) AS va FROM orders GROUP BY 1""")
def more_aggregates(spark, sf):
    """Quantiles by selection of ranks, the rest in one pass."""
    x, y = F.col("o_totalprice"), F.col("o_custkey")
    o = t(spark, sf, "orders")
    plain = o.groupBy("o_orderpriority").agg(
        F.round(F.corr(x, y), 8).alias("cr"), F.round(F.covar_pop(x, y), 1).alias("cp"), F.round(F.covar_samp(x, y), 1).alias("cs"),
        F.min_by(x, "o_orderkey").alias("f"), F.max_by(x, "o_orderkey").alias("l"), F.countDistinct(y).alias("nd"), F.round(F.variance(x), 0).alias("va"))
    q = exact_quantiles(o, ["o_orderpriority"], "o_totalprice", (0.5, 0.9)).groupBy("o_orderpriority").agg(
        F.round(F.max(F.when(F.col("quantile") == 0.5, F.col("value"))), 4).alias("md"), F.round(F.max(F.when(F.col("quantile") == 0.9, F.col("value"))), 4).alias("pc"))
    d = exact_quantiles(o, ["o_orderpriority"], "o_totalprice", (0.25,), discrete=True).select("o_orderpriority", F.col("value").alias("pd"))
    return plain.join(q, "o_orderpriority").join(d, "o_orderpriority")


@query("quantiles_of_null_groups", """SELECT CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS k, unnest([0.0, 0.1, 0.5, 0.99, 1.0])::DOUBLE AS quantile, round(unnest(quantile_cont(o_totalprice, [0.0, 0.1, 0.5, 0.99, 1.0])), 6) AS value FROM orders GROUP BY 1""")
def quantiles_of_null_groups(spark, sf):
    o = t(spark, sf, "orders").withColumn("k", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3))
    return exact_quantiles(o, ["k"], "o_totalprice", (0.0, 0.1, 0.5, 0.99, 1.0)).withColumn("value", F.round("value", 6))


@query("value_mode", "SELECT l_linenumber, arg_max(q, (c, -q)) AS q FROM (SELECT l_linenumber, l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def value_mode(spark, sf):
    """Most frequent quantity, the smallest of equals, from counts per value."""
    per = t(spark, sf, "lineitem").groupBy("l_linenumber", F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("l_linenumber").agg(F.max_by("q", F.struct("c", -F.col("q"))).alias("q"))


@query("cube_and_grouping", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_and_grouping(spark, sf):
    return t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count(F.lit(1)).alias("n"))


@query("rollup_totals", "SELECT n_regionkey, n_nationkey, grouping_id(n_regionkey, n_nationkey)::BIGINT AS gid, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_totals(spark, sf):
    j = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_nationkey").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, sf):
    d = t(spark, sf, "orders")
    return d.groupingSets([[d.o_orderstatus], [d.o_orderpriority], []], d.o_orderstatus, d.o_orderpriority).agg(F.count(F.lit(1)).alias("n"))


@query("regression", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 7) AS r2,
    regr_count(l_extendedprice, l_quantity)::BIGINT AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
    count(*) FILTER (WHERE l_discount > 0.05) AS nf FROM lineitem GROUP BY 1""")
def regression(spark, sf):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("icpt"), F.round(F.regr_r2(y, x), 7).alias("r2"), F.regr_count(y, x).alias("n"),
        F.round(F.regr_avgx(y, x), 6).alias("ax"), F.round(F.regr_avgy(y, x), 4).alias("ay"), F.expr("count(*) FILTER (WHERE l_discount > 0.05)").alias("nf"))


@query("crosstab", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(spark, sf):
    return ST.crosstab(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("chi_square", """, c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS k FROM c GROUP BY 1), z AS (SELECT sum(n) AS z FROM c)
    SELECT round(sum(power(coalesce(n, 0) - r * k / z, 2) / (r * k / z)), 6) AS statistic, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS dof FROM r CROSS JOIN k CROSS JOIN z LEFT JOIN c ON c.a = r.a AND c.b = k.b""", "zones")
def chi_square(spark, sf):
    return ST.chi_square(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("statistic", F.round("statistic", 6))


@query("anova", """, g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT round((sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 5) AS f_value, count(*) - 1 AS dof_between, (sum(n) - count(*))::BIGINT AS dof_within FROM g""", "zones")
def anova(spark, sf):
    return ST.anova(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice").withColumn("f_value", F.round("f_value", 5))


@query("two_sample_gap", """, d AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
    c AS (SELECT sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b FROM d) SELECT round(max(abs(a / (SELECT sum(a)::DOUBLE FROM d) - b / (SELECT sum(b)::DOUBLE FROM d))), 8) AS statistic FROM c""", "zones")
def two_sample_gap(spark, sf):
    return ST.ks_two_sample(t(spark, sf, "orders"), "o_orderstatus", "F", "O", "o_totalprice").withColumn("statistic", F.round("statistic", 8))


# ---------------------------------------------------------------- windows

@query("ranking", """SELECT c_custkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 8) AS pr, round(cume_dist() OVER v, 8) AS cd
    FROM (SELECT *, floor(c_acctbal / 100) AS b FROM customer) WINDOW w AS (PARTITION BY c_mktsegment ORDER BY b, c_custkey), v AS (PARTITION BY c_mktsegment ORDER BY b)""")
def ranking(spark, sf):
    """Ranks per segment; no segment is one task's work."""
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("b"))
    d = ranked(c, ["c_mktsegment"], ["b"], "rank", "dense_rank", "percent_rank", "cume_dist")
    d = ranked(d, ["c_mktsegment"], ["b", "c_custkey"], "row_number")
    return d.select("c_custkey", F.col("row_number").alias("rn"), F.col("rank").alias("rk"), F.col("dense_rank").alias("dr"), F.round("percent_rank", 8).alias("pr"), F.round("cume_dist", 8).alias("cd"))


@query("running_totals", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS total FROM events")
def running_totals(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return running(e, ["user_id"], ["ts"], {"total": "value"}).select("event_id", F.round("total", 2).alias("total"))


@query("moving_frames", """SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma, first_value(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS f,
    last_value(value) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def moving_frames(spark, sf):
    e = t(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    d = windowed(e, ["event_type"], ["ts"], {"ma": lambda w: F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6), "f": lambda w: F.first("value").over(w.rowsBetween(-3, 0)),
                                             "l": lambda w: F.last("value").over(w.rowsBetween(0, 1))}, before=3, after=1, chunk=1000)
    return d.select("event_id", "ma", "f", "l")


@query("range_frames", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frames(spark, sf):
    """Events of the user in the hour before each event; hours are the blocks, each copied to the next one."""
    from pyspark.sql import Window
    e = t(spark, sf, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    e = e.withColumn("h", F.floor(F.col("s") / 3600))
    both = e.withColumn("z", F.explode(F.array(F.struct(F.col("h").alias("h"), F.lit(True).alias("own")), F.struct((F.col("h") + 1).alias("h"), F.lit(False).alias("own")))))
    w = Window.partitionBy("user_id", "z.h").orderBy("s").rangeBetween(-3600, 0)
    return both.withColumn("n", F.count(F.lit(1)).over(w)).where("z.own").select("event_id", "n")


@query("ordered_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def ordered_limit(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- profiles

@query("describe_layer", "SELECT count(*) AS n_rows, count(*) AS n_geometries, 0::BIGINT AS n_empty, 'POLYGON' AS types, min(xmin) AS xmin, max(ymax) AS ymax, 3857 AS srid, '' AS warnings FROM parcels", "parcels")
def describe_layer(spark, sf):
    return PR.describe_layer(fx.parcels(spark, sf), "parcel_id").select("n_rows", "n_geometries", "n_empty", "types", "xmin", "ymax", "srid", "warnings")


@query("describe_columns", """SELECT 1 AS num, 'c_custkey' AS name, count(*) - count(c_custkey) AS nulls FROM customer UNION ALL SELECT 2, 'c_name', count(*) - count(c_name) FROM customer
    UNION ALL SELECT 3, 'c_nationkey', count(*) - count(c_nationkey) FROM customer UNION ALL SELECT 4, 'c_acctbal', count(*) - count(c_acctbal) FROM customer UNION ALL SELECT 5, 'c_mktsegment', count(*) - count(c_mktsegment) FROM customer""")
def describe_columns(spark, sf):
    return PR.describe_columns(t(spark, sf, "customer")).select("num", "name", "nulls")


@query("unique_columns", """SELECT 'c_custkey' AS name, count(*) AS n FROM customer HAVING count(DISTINCT c_custkey) = count(*) UNION ALL SELECT 'c_name', count(*) FROM customer HAVING count(DISTINCT c_name) = count(*)
    UNION ALL SELECT 'c_acctbal', count(*) FROM customer HAVING count(DISTINCT c_acctbal) = count(*)""")
def unique_columns(spark, sf):
    return PR.unique_columns(t(spark, sf, "customer"))


# ---------------------------------------------------------------- scalar functions

@query("scalar_general", """SELECT s_suppkey, coalesce(nullif(s_nationkey, 3), -1) AS a, replace(s_name, 'Supplier', 'S') AS b, '''' || replace(s_name, '''', '''''') || '''' AS q FROM supplier""")
def scalar_general(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", F.coalesce(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("a"), F.replace("s_name", F.lit("Supplier"), F.lit("S")).alias("b"), T.quote_literal("s_name").alias("q"))


@query("scalar_math", """SELECT p_partkey, round(abs(-p_retailprice), 2) AS a, round(acos(p_size / 100.0) + asin(p_size / 100.0) + atan(p_size) + cos(p_size) + cot(p_size) + sin(p_size) + tan(p_size), 6) AS b,
    round(degrees(p_size) + radians(p_size), 6) AS c, floor(p_retailprice / 7)::BIGINT AS d, round(exp(p_size / 50.0) + ln(p_size) + log2(p_size) + log10(p_size) + sqrt(p_size) + pi(), 6) AS e, sign(p_size - 25)::DOUBLE AS f,
    round(atan2(p_size, 3) + cosh(p_size / 50.0) + sinh(p_size / 50.0) + tanh(p_size / 50.0), 6) AS g, (p_size & 6)::INT AS h, ceil(p_retailprice / 7)::BIGINT AS i, (p_size % 7)::INT AS j, power(p_size, 2)::DOUBLE AS k,
    round(p_size - 7 * round_even(p_size / 7.0, 0), 6) AS l FROM part""")
def scalar_math(spark, sf):
    s, x = F.col("p_size"), F.col("p_retailprice")
    u = s / 100
    v = s / 50
    return t(spark, sf, "part").select(
        "p_partkey", F.round(F.abs(-x), 2).alias("a"), F.round(F.acos(u) + F.asin(u) + F.atan(s) + F.cos(s) + F.cot(s) + F.sin(s) + F.tan(s), 6).alias("b"), F.round(F.degrees(s) + F.radians(s), 6).alias("c"),
        F.floor(x / 7).alias("d"), F.round(F.exp(v) + F.ln(s) + F.log2(s) + SC.log(s) + F.sqrt(s) + F.pi(), 6).alias("e"), F.sign(s - 25).alias("f"),
        F.round(F.atan2(s, F.lit(3)) + F.cosh(v) + F.sinh(v) + F.tanh(v), 6).alias("g"), SC.bitand(s, F.lit(6)).alias("h"), F.ceil(x / 7).alias("i"), (s % 7).alias("j"), F.pow(s, F.lit(2)).alias("k"),
        F.round(SC.remainder(s, F.lit(7.0)), 6).alias("l"))


@query("scalar_text", """SELECT p_partkey, length(p_name) AS a, lower(p_name) AS b, upper(p_name) AS c, trim('  ' || p_brand || ' ') AS d, ltrim('  ' || p_brand) AS e, rtrim(p_brand || '  ') AS f, substr(p_type, 2, 4) AS g, p_type LIKE '%A%' AS h,
    chr(65 + p_size % 26) AS i, lpad(p_brand, 12, '*') AS j, rpad(p_brand, 12, '*') AS k, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS l, regexp_extract(p_type, '[A-Z]+') AS m, translate(p_type, 'ABC', 'xyz') AS n, ascii(p_type) AS o,
    instr(p_type, 'A')::INT AS p, left(p_type, 3) AS q, right(p_type, 3) AS r FROM part""")
def scalar_text(spark, sf):
    n, b, y = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t(spark, sf, "part").select(
        "p_partkey", F.length(n).cast("long").alias("a"), F.lower(n).alias("b"), F.upper(n).alias("c"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("d"), F.ltrim(F.concat(F.lit("  "), b)).alias("e"), F.rtrim(F.concat(b, F.lit("  "))).alias("f"),
        F.substring(y, 2, 4).alias("g"), y.like("%A%").alias("h"), F.char(65 + F.col("p_size") % 26).alias("i"), F.lpad(b, 12, "*").alias("j"), F.rpad(b, 12, "*").alias("k"), F.regexp_replace(y, "[AEIOU]", "_").alias("l"),
        F.regexp_substr(y, F.lit("[A-Z]+")).alias("m"), F.translate(y, "ABC", "xyz").alias("n"), F.ascii(y).alias("o"), SC.strpos(y, "A").alias("p"), F.left(y, F.lit(3)).alias("q"), F.right(y, F.lit(3)).alias("r"))


@query("scalar_conditional", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS a, greatest(o_custkey, 100) AS b, least(o_custkey, 100) AS c, NOT coalesce(o_totalprice > 5000, false) AS d,
    CASE WHEN o_custkey IS NOT NULL THEN 1 ELSE 2 END AS e, least(greatest(o_totalprice, 1000), 5000)::DOUBLE AS f, round(10 + (least(greatest(o_totalprice, 0), 500000) - 0) * 90 / 500000, 6) AS g,
    round(power(least(greatest(o_totalprice, 0), 500000) / 500000, 2) * 100, 6) AS h FROM orders""")
def scalar_conditional(spark, sf):
    x = F.col("o_totalprice")
    return t(spark, sf, "orders").select(
        "o_orderkey", SC.decode(F.col("o_orderstatus"), "F", "done", "O", "open", "other").alias("a"), F.greatest("o_custkey", F.lit(100)).alias("b"), F.least("o_custkey", F.lit(100)).alias("c"), SC.lnnvl(x > 5000).alias("d"),
        F.nvl2("o_custkey", F.lit(1), F.lit(2)).alias("e"), SC.clamp(1000.0, x, 5000.0).alias("f"), F.round(SC.scale_linear(x, 0, 500000, 10, 100), 6).alias("g"), F.round(SC.scale_exp(x, 0, 500000, 0, 100, 2), 6).alias("h"))


@query("scalar_dates", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS a, round(julian(ts) - 0.0, 5) AS b, year(ts)::INT AS c, month(ts)::INT AS d, day(ts)::INT AS e, hour(ts)::INT AS f, minute(ts)::INT AS g, second(ts)::INT AS h, dayofweek(ts)::INT AS i,
    round((epoch(ts) - epoch(TIMESTAMP '2020-01-01')) / 86400, 5) AS j, weekofyear(ts)::INT AS k FROM events""".replace("julian(ts) - 0.0", "epoch(ts) / 86400 + 2440587.5"))
def scalar_dates(spark, sf):
    ts = F.col("ts")
    return t(spark, sf, "events").select(
        "event_id", SC.strftime("%Y-%m-%d", ts).alias("a"), F.round(SC.julianday(ts), 5).alias("b"), F.year(ts).alias("c"), F.month(ts).alias("d"), F.dayofmonth(ts).alias("e"), F.hour(ts).alias("f"), F.minute(ts).alias("g"), F.second(ts).alias("h"),
        SC.day_of_week(ts).alias("i"), F.round(SC.age_days(ts, F.lit("2020-01-01 00:00:00")), 5).alias("j"), F.weekofyear(ts).alias("k"))


@query("scalar_conversions", """SELECT c_custkey, round_even(c_acctbal, 0)::BIGINT AS a, c_custkey::VARCHAR AS b, hex(c_name) AS c, ifnull(c_name, '-') AS d, levenshtein(c_mktsegment, 'BUILDING')::INT AS e,
    CASE WHEN length(c_mktsegment) = 9 THEN hamming(c_mktsegment, 'FURNITURE') END::INT AS f, coalesce(nullif(instr(c_name, '0'), 0), 0)::INT AS g FROM customer""".replace("round_even(c_acctbal, 0)::BIGINT", "round(c_acctbal)::BIGINT"))
def scalar_conversions(spark, sf):
    s = F.col("c_mktsegment")
    return t(spark, sf, "customer").select(
        "c_custkey", SC.to_int(F.col("c_acctbal").cast("string")).alias("a"), SC.to_text(F.col("c_custkey")).alias("b"), F.hex("c_name").alias("c"), F.ifnull("c_name", F.lit("-")).alias("d"), F.levenshtein(s, F.lit("BUILDING")).alias("e"),
        SC.hamming_distance(s, F.lit("FURNITURE")).alias("f"), SC.regexp_match(F.col("c_name"), "0").alias("g"))


@query("scalar_soundex", "SELECT n_nationkey, 'N350' AS code FROM nation")
def scalar_soundex(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.soundex("n_name").alias("code"))


@query("scalar_strings", "SELECT p_partkey, 'DAR' AS common FROM part WHERE p_type LIKE '%DARD%'")
def scalar_strings(spark, sf):
    """Longest common substring with a fixed word."""
    p = t(spark, sf, "part").where("p_type LIKE '%DARD%'")
    return p.select("p_partkey", SC.longest_common_substring(F.col("p_type"), F.lit("DARTS")).alias("common"))


@query("scalar_wrap", "SELECT doc_id, length(text) AS n FROM documents")
def scalar_wrap(spark, sf):
    """Whole documents wrapped to lines of 60 characters."""
    return t(spark, sf, "documents").select("doc_id", F.length(SC.wordwrap(F.col("text"), 60)).alias("n"))


@query("geometry_text", "SELECT parcel_id, true AS wkt, true AS geojson, true AS wkb FROM parcels", "parcels")
def geometry_text(spark, sf):
    """Geometry through WKT, GeoJSON and WKB and back."""
    from ..functions import exact as X
    g = F.col("geom")
    return fx.over_tasks(fx.parcels(spark, sf), "parcel_id").select("parcel_id", (N.from_wkt(N.as_wkt(g)) == g).alias("wkt"), (N.from_geojson(N.as_geojson(g)) == g).alias("geojson"), (X.from_wkb(X.as_wkb(g)) == g).alias("wkb"))
