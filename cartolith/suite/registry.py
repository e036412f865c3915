"""Named queries over the given tables, each with an SQL twin where plain SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The derived layers as SQL; the arithmetic is that of cartolith.fixtures.
LAYERS = {
    "zones": """SELECT n_nationkey AS zone_id, n_name, n_regionkey, 20.0::DOUBLE * (n_nationkey % 5) AS xmin, 20.0::DOUBLE * (n_nationkey // 5) AS ymin,
        20.0::DOUBLE * (n_nationkey % 5) + 20 AS xmax, 20.0::DOUBLE * (n_nationkey // 5) + 20 AS ymax FROM nation""",
    "sites": """SELECT c_custkey AS site_id, c_mktsegment, c_acctbal, ((c_custkey * 7919) % 10007) / 100.07::DOUBLE AS x,
        ((c_custkey * 104729) % 10009) / 100.09::DOUBLE AS y FROM customer""",
    "depots": """SELECT s_suppkey AS depot_id, ((s_suppkey * 7919) % 10007) / 100.07::DOUBLE AS x,
        ((s_suppkey * 15485863) % 10009) / 100.09::DOUBLE AS y FROM supplier""",
    "parcels": """SELECT p_partkey AS parcel_id, p_brand, p_type, xmin, ymin, xmin + p_size / 10.0::DOUBLE AS xmax, ymin + (1 + p_partkey % 7) / 2.0::DOUBLE AS ymax
        FROM (SELECT *, ((p_partkey * 6151) % 9973) / 99.73::DOUBLE AS xmin, ((p_partkey * 3571) % 9967) / 99.67::DOUBLE AS ymin FROM part)""",
    "routes": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS site_id, l_suppkey AS depot_id,
        ((o_custkey * 7919) % 10007) / 100.07::DOUBLE AS x1, ((o_custkey * 104729) % 10009) / 100.09::DOUBLE AS y1,
        ((l_suppkey * 7919) % 10007) / 100.07::DOUBLE AS x2, ((l_suppkey * 15485863) % 10009) / 100.09::DOUBLE AS y2
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "track_points": """SELECT event_id, user_id, ts, event_type, value, ((event_id * 37) % 101)::DOUBLE AS x, ((event_id * 53) % 103)::DOUBLE AS y FROM events""",
    "heat": """SELECT event_id % 100 AS col, event_id // 100 AS row, ((event_id // 100) // 25) * 4 + (event_id % 100) // 25 AS rid,
        CASE WHEN event_type <> 'error' THEN value END AS b1, user_id::DOUBLE AS b2, (SELECT max(event_id) // 100 + 1 FROM events) AS h FROM events""",
    "changes": """SELECT o_custkey AS key, o_orderdate AS ts, o_orderkey AS seq, o_orderpriority AS priority, o_totalprice AS total,
        CASE WHEN row_number() OVER w = 1 THEN 'I' WHEN lead(o_orderkey) OVER w IS NULL AND o_orderstatus = 'F' THEN 'D' ELSE 'U' END AS op
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
}


def with_layers(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({LAYERS[n]})" for n in names.split()) + " " + body


def query(name: str, sql: str | None = None, layers: str = ""):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = with_layers(layers, sql) if layers else sql
        return fn

    return add
