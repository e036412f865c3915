"""The one physical plan behind every spatial join.

Each row goes to the cells of a grid whose cell size fits the size of its box
(at most 3 x 3 cells, usually 1 to 4).  Cell sizes are powers of four, so a
small box meets a large one on the large one's grid.  Where the rows lie so
dense that most rows of a cell do not meet, all cells are 4 or 16 times finer:
a box has more copies, but a copy sees few rows that lie apart from it.  The join is an equi-join
on the cell key; a box comparison follows, and a pair is kept only in the cell
that holds the lower-left corner of the common box, so every pair appears once.

One small statistics job per join (row counts, bytes, box sizes, and the most
frequent cells from a mergeable sketch) decides three things:
* how fine the cells are, from the copies and the tests to be expected;
* a side is broadcast only when its measured bytes are under a bound;
* cells that hold a large share of the rows are split over many tasks by a
  two-sided salt (each left slice meets each right slice once).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.native import is_rect, is_segment
from ..layer import ensure_bbox, is_bbox, is_geometry

BROADCAST_BYTES = 32 << 20   # measured upper bound for a broadcast side
SALT_ROWS = 200_000          # a cell above this many rows is split
MAX_SALT = 1024              # slices per side of one hot cell
TRACKED = 512                # hot cells looked for (bounds the driver result)
FINEST = 2                   # powers of four by which cells may be finer than the boxes ask for
COPY_COST = 50               # tests of a pair that take the time of one more copy of a row


@dataclass
class Side:
    rows: int = 0
    bytes: int = 0
    levels: tuple = ()
    types: tuple = ()
    reach: float = 1.0
    rects: bool = False      # every geometry is an axis-aligned rectangle
    segments: bool = False   # every geometry is a line of two vertices

    @property
    def points(self) -> bool:
        return self.types == ("POINT",)


@dataclass
class GridPlan:
    """What the statistics job found; pass it back in to reuse it."""
    left: Side
    right: Side
    floor: int
    hot: list = field(default_factory=list)   # (hash of the cell, left rows, right rows, pairs of slices, left slices, right slices)
    fine: int = 0            # cells are 4^fine times finer than the boxes ask for

    @property
    def broadcast(self) -> str | None:
        """The side whose rows, once copied to their cells, stay under the bound; only joins without one have finer cells."""
        if self.fine:
            return None
        left = self.left.bytes * 4 * (1 + len(self.right.levels))
        right = self.right.bytes * 4 * (1 + len(self.left.levels))
        if min(left, right) > BROADCAST_BYTES:
            return None
        return "left" if left < right else "right"


def row_bytes(df: DataFrame) -> Column:
    """Estimated width of a row from its actual contents."""
    total = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if is_geometry(f):
            total = total + F.coalesce(F.size(F.flatten(F.flatten(c["parts"]))), F.lit(0)) * 16 + 16
        elif is_bbox(f):
            total = total + 32
        elif kind in ("string", "binary", "varchar", "char"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind in ("array", "map", "struct", "variant"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def own_level(box: Column, floor, fine: int = 0) -> Column:
    """Grid level whose cell side is at least the longer side of the box, or ``fine`` levels below."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    lv = F.ceil(F.ln(side) / math.log(4.0)).cast("int") - fine
    return F.when(side > 0, F.greatest(lv, F.lit(floor))).otherwise(F.lit(floor))


def _side_row(df: DataFrame, box: Column, geom: str | None, tag: int) -> DataFrame:
    b = F.when(box.isNotNull(), box)
    big = F.greatest(*[F.abs(b[k]) for k in ("xmin", "ymin", "xmax", "ymax")])
    types = F.collect_set(F.col(geom)["gtype"]) if geom else F.array().cast("array<string>")
    rects = F.coalesce(F.bool_and(is_rect(F.col(geom), F.col("bbox"))), F.lit(False)) if geom else F.lit(True)
    segments = F.coalesce(F.bool_and(is_segment(F.col(geom))), F.lit(False)) if geom else F.lit(False)
    return (df.where(box.isNotNull())
            .groupBy(own_level(b, -300).alias("level"))   # a few dozen levels at most in practice, some 800 by the range of doubles
            .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes"),
                 types.alias("types"), rects.alias("rects"), segments.alias("segments"),
                 F.coalesce(F.max(big), F.lit(1.0)).alias("reach"), F.lit(tag).alias("tag"),
                 F.avg(b["xmax"] - b["xmin"]).alias("w"), F.avg(b["ymax"] - b["ymin"]).alias("h"),
                 F.min(b["xmin"]).alias("x0"), F.min(b["ymin"]).alias("y0"), F.max(b["xmax"]).alias("x1"), F.max(b["ymax"]).alias("y1")))


def plan_pairs(a: DataFrame, b: DataFrame, abox: Column, bbox: Column, ageom: str | None, bgeom: str | None, grown_b: bool = False) -> GridPlan:
    """Run the statistics job of a join: one row per side and level of its boxes reaches the driver."""
    rows = _side_row(a, abox, ageom, 0).unionByName(_side_row(b, bbox, bgeom, 1)).collect()
    reach = max(max((r["reach"] for r in rows), default=1.0), 1e-300)
    floor = math.ceil(math.log(reach / 2.0 ** 40, 4))   # keeps cell numbers exact in a double
    per_side = [[r for r in rows if r["tag"] == tag] for tag in (0, 1)]

    def sides(fine):
        return [Side(sum(r["n"] for r in rs), sum(r["bytes"] for r in rs), tuple(sorted({max(r["level"] - fine, floor) for r in rs})),
                     tuple(sorted({t for r in rs for t in r["types"]})), max((r["reach"] for r in rs), default=1.0),
                     all(r["rects"] for r in rs) and (bool(rs) or not geom), bool(rs) and all(r["segments"] for r in rs))
                for rs, geom in zip(per_side, (ageom, bgeom))]

    plan = GridPlan(*sides(0), floor)
    if plan.broadcast is None:
        plan.fine = _fineness(rows, floor)
        plan.left, plan.right = sides(plan.fine)
        plan.hot = _hot_cells(a, b, abox, bbox, plan, grown_b)
    return plan


def _fineness(rows: list, floor: int) -> int:
    """How much finer than the boxes the cells should be: the least copies and tests if rows lie evenly. Any number gives the same pairs."""
    x, y = (max(r[k + "1"] for r in rows) - min(r[k + "0"] for r in rows) for k in "xy")

    def cost(fine):
        copies = tests = 0.0
        for r in rows:
            own = max(r["level"] - fine, floor)
            met = {own}
            for q in rows:
                if q["tag"] == r["tag"]:
                    continue
                level = max(own, q["level"] - fine)
                met.add(level)
                if r["tag"] == 0:
                    s = 4.0 ** level
                    there = min((q["w"] + s) / (x + s) * ((q["h"] + s) / (y + s)), 1.0)   # share of the other rows that have a given cell
                    tests += r["n"] * (r["w"] / s + 1) * (r["h"] / s + 1) * q["n"] * there
            copies += r["n"] * sum((r["w"] / 4.0 ** level + 1) * (r["h"] / 4.0 ** level + 1) for level in met)
        return COPY_COST * copies + tests

    best, least = 0, cost(0)
    for fine in range(1, FINEST + 1):
        c = cost(fine)
        if c < 0.8 * least:
            best, least = fine, c
    return best


def _hot_cells(a, b, abox, bbox, plan, grown_b):
    """Cells with many rows, from a mergeable heavy-hitter sketch per side."""
    def sketch(df, box, side, other, tag, grown=False):
        df, box = df.select(box.alias("_box")).where("_box IS NOT NULL"), F.col("_box")
        df = spread(df, side, NATIVE_ROWS) if plan.fine else df
        keyed = df.select(F.explode(cell_array(box, side.levels, other.levels, plan.floor, tag, side.points and not grown, plan.fine)).alias("c"))
        key = "xxhash64(c.level, c.cx, c.cy, c.role)"   # cells that share it are split alike
        return keyed.agg(F.expr(f"approx_top_k({key}, {TRACKED}, {TRACKED * 16})").alias("top"), F.lit(tag).alias("tag"))

    found: dict = {}
    for r in sketch(a, abox, plan.left, plan.right, 0).unionByName(sketch(b, bbox, plan.right, plan.left, 1, grown_b)).collect():
        for item in r["top"] or ():
            found.setdefault(item["item"], [0, 0])[r["tag"]] = item["count"]
    hot = []
    for key, counts in found.items():
        if max(counts) > SALT_ROWS:
            sa, sb = (min(MAX_SALT, max(1, -(-n // SALT_ROWS))) for n in counts)
            hot.append((key, *counts, sa * sb, sa, sb))
    return hot


def cell_array(box: Column, own: tuple, other: tuple, floor: int, tag: int, points: bool = False, fine: int = 0) -> Column:
    """Cells of a row: on its own level, and on the coarser levels of the other side.

    Role 0 pairs a left row on its own level with right rows that are as fine or
    finer; role 1 pairs a right row on its own level with finer left rows.  So two
    small rows never meet on a coarse grid."""
    wanted = []   # (level, role, is it the row's own level)
    for level in sorted(set(own) | set(other)):
        left, right = (own, other) if tag == 0 else (other, own)
        role0 = level in left and any(v <= level for v in right)
        role1 = level in right and any(v < level for v in left)
        if level in own:
            wanted += [(level, 0, True)] if role0 else []
            wanted += [(level, 1, True)] if role1 and tag == 1 else []
        if any(v < level for v in own) and (role1 if tag == 0 else role0):
            wanted.append((level, 1 - tag, False))
    if not wanted:
        return F.array().cast("array<struct<level:int,cx:bigint,cy:bigint,role:int,size:double>>")

    def cell(cx, cy, level, role, size):
        return F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy"), role.alias("role"), size.alias("size"))

    if points and len(own) == 1:
        x, y = box["xmin"], box["ymin"]
        return F.array(*[cell(F.floor(x / 4.0 ** l), F.floor(y / 4.0 ** l), F.lit(l), F.lit(r), F.lit(4.0 ** l)) for l, r, _ in wanted])
    lv = own_level(box, floor, fine)
    table = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(r).alias("r"), F.lit(o).alias("o"), F.lit(4.0 ** l).alias("s")) for l, r, o in wanted])
    mine = table if len(own) == 1 else F.filter(table, lambda t: F.when(t["o"], lv == t["l"]).otherwise(lv < t["l"]))

    def cells(t):
        across = F.sequence(F.floor(box["xmin"] / t["s"]), F.floor(box["xmax"] / t["s"]))
        up = F.sequence(F.floor(box["ymin"] / t["s"]), F.floor(box["ymax"] / t["s"]))
        return F.flatten(F.transform(across, lambda cx: F.transform(up, lambda cy: cell(cx, cy, t["l"], t["r"], t["s"]))))

    return F.flatten(F.transform(mine, cells))


def _keyed(df: DataFrame, box: Column, prefix: str, side: Side, other: Side, plan: GridPlan, tag: int, geom: str | None, grown: bool) -> DataFrame:
    cols = [F.col(f"`{c}`").alias(prefix + c) for c in df.columns]
    rect = [is_rect(F.col(geom), F.col("bbox")).alias(prefix + "_rect")] if geom and not side.rects and not side.points else []
    cells = cell_array(box, side.levels, other.levels, plan.floor, tag, side.points and not grown, plan.fine)
    out = df.where(box.isNotNull()).select(*cols, *rect, box.alias(prefix + "_box"), F.explode(cells).alias(prefix + "_cell"))
    c = F.col(prefix + "_cell")
    if not plan.hot or plan.broadcast:
        return out
    spark = df.sparkSession
    hot = F.broadcast(spark.createDataFrame(plan.hot, "hc long, na long, nb long, n int, sa int, sb int").select("hc", "sa", "sb"))  # at most 2 * TRACKED rows
    out = out.join(hot, F.xxhash64(c["level"], c["cx"], c["cy"], c["role"]) == hot.hc, "left")
    sa, sb = F.coalesce("sa", F.lit(1)), F.coalesce("sb", F.lit(1))
    mine, theirs = (sa, sb) if tag == 0 else (sb, sa)
    slot = F.pmod(F.xxhash64(*[F.col(f"`{prefix}{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]), mine).cast("int")
    all_slots = F.sequence(F.lit(0), theirs - 1)
    salts = F.transform(all_slots, (lambda j: slot * sb + j) if tag == 0 else (lambda i: i * sb + slot))
    return out.withColumn(prefix + "_salt", F.explode(salts)).drop("hc", "sa", "sb")


SPREAD_BYTES = 2 << 30       # below this a layer is re-spread before costly exact tests


def spread(df: DataFrame, side: Side, least: int = 500) -> DataFrame:
    """Give a small layer enough partitions to keep all cores busy with exact tests."""
    if side.bytes > SPREAD_BYTES or side.rows < least:
        return df
    return df.repartition(min(df.sparkSession.sparkContext.defaultParallelism, -(-side.rows // 200)))


def boxes_meet(p: Column, q: Column) -> Column:
    return ((p["xmin"] <= q["xmax"]) & (q["xmin"] <= p["xmax"]) & (p["ymin"] <= q["ymax"]) & (q["ymin"] <= p["ymax"]))


def grow(box: Column, d) -> Column:
    """Box that surely covers everything within ``d`` (a little slack for rounding)."""
    d = d if isinstance(d, Column) else F.lit(float(d))

    def side(v, sign):
        slack = d * (1 + 1e-6) + F.abs(v) * 1e-15
        return v + sign * slack

    return F.struct(side(box["xmin"], -1).alias("xmin"), side(box["ymin"], -1).alias("ymin"),
                    side(box["xmax"], 1).alias("xmax"), side(box["ymax"], 1).alias("ymax"))


# The borders that touching boxes share, as (border of the left box, border of the right one).
CONTACTS = (("xmin", "xmax"), ("xmax", "xmin"), ("ymin", "ymax"), ("ymax", "ymin"))


def _with_borders(df: DataFrame, prefix: str, tag: int) -> DataFrame:
    """A row once per border, under the border's number and place."""
    box = F.col(prefix + "_box")
    return df.withColumn(prefix + "_border", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), box[pair[tag]].alias("at")) for i, pair in enumerate(CONTACTS)])))


def first_contact(p: Column, q: Column) -> Column:
    """Number of the first border that two boxes share."""
    return F.coalesce(*[F.when(p[l] == q[r], F.lit(i)) for i, (l, r) in enumerate(CONTACTS)])


def candidate_pairs(a: DataFrame, b: DataFrame, grow_b=None, ageom: str | None = "geom", bgeom: str | None = "geom",
                    plan: GridPlan | None = None, post=None, only: str | None = None) -> tuple[DataFrame, GridPlan]:
    """All pairs whose boxes meet, once each; columns get the prefixes ``a_`` and ``b_``.

    ``grow_b`` widens the boxes of ``b`` (a number or a column of ``b``).  ``only`` narrows the pairs where the test is one of boxes
    (points and rectangles are their boxes): "equals" to equal boxes, which meet by their four numbers, "touches" to boxes that share
    a border, which meet by its place too."""
    a, b = ensure_bbox(a, ageom or "geom"), ensure_bbox(b, bgeom or "geom")
    abox = F.col("bbox")
    bbox = F.col("bbox") if grow_b is None else F.when(F.col("bbox").isNotNull(), grow(F.col("bbox"), grow_b))
    plan = plan or plan_pairs(a, b, abox, bbox, ageom, bgeom, grow_b is not None)
    if not plan.left.levels or not plan.right.levels:
        l = a.select(*[F.col(f"`{c}`").alias("a_" + c) for c in a.columns])
        r = b.select(*[F.col(f"`{c}`").alias("b_" + c) for c in b.columns])
        none = l.join(r, F.lit(False), "inner")   # one side is empty: no pairs
        return none.withColumn("a__rect", F.lit(False)).withColumn("b__rect", F.lit(False)), plan
    if only == "equals" and boxes_only(plan):
        return _equal_boxes(a, b), plan
    side = plan.broadcast
    least = NATIVE_ROWS if boxes_only(plan) else 500
    if side == "right":
        a = spread(a, plan.left, least)
    elif side == "left":
        b = spread(b, plan.right, least)
    elif plan.fine:   # rows of few files are copied to many cells: over all tasks
        a, b = spread(a, plan.left, least), spread(b, plan.right, least)
    l = _keyed(a, abox, "a_", plan.left, plan.right, plan, 0, ageom, False)
    r = _keyed(b, bbox, "b_", plan.right, plan.left, plan, 1, bgeom, grow_b is not None)
    on = _same_cell(l)
    p, q = F.col("a__box"), F.col("b__box")
    size = F.col("a__cell.size")
    once = ((F.floor(F.greatest(p["xmin"], q["xmin"]) / size) == F.col("a__cell.cx")) & (F.floor(F.greatest(p["ymin"], q["ymin"]) / size) == F.col("a__cell.cy")))
    if only == "touches" and boxes_only(plan):
        l, r = _with_borders(l, "a_", 0), _with_borders(r, "b_", 1)
        on = on & (F.col("a__border.i") == F.col("b__border.i")) & (F.col("a__border.at") == F.col("b__border.at"))
        once = once & (F.col("a__border.i") == first_contact(p, q))
    out = _join(l, r, on, side, "inner").where(boxes_meet(p, q) & once)
    return out.drop("a__cell", "b__cell", "a__salt", "b__salt", "a__border", "b__border", "a__box", "b__box"), plan


def _same_cell(l: DataFrame) -> Column:
    lc, rc = F.col("a__cell"), F.col("b__cell")
    on = (lc["cx"] == rc["cx"]) & (lc["cy"] == rc["cy"]) & (lc["level"] == rc["level"]) & (lc["role"] == rc["role"])
    return on & (F.col("a__salt") == F.col("b__salt")) if "a__salt" in l.columns else on


def _join(l: DataFrame, r: DataFrame, on: Column, side: str | None, how: str) -> DataFrame:
    """Broadcast by measured bytes only: a file's size says little of the rows derived from it, so a join without a small side is
    told to shuffle and no side reaches the driver by an estimate."""
    if side == "left" and how == "inner":
        return F.broadcast(l).join(r, on, how)
    return l.join(F.broadcast(r) if side == "right" else r.hint("merge"), on, how)


def _equal_boxes(a: DataFrame, b: DataFrame) -> DataFrame:
    l = a.where(F.col("bbox").isNotNull()).select(*[F.col(f"`{c}`").alias("a_" + c) for c in a.columns])
    r = b.where(F.col("bbox").isNotNull()).select(*[F.col(f"`{c}`").alias("b_" + c) for c in b.columns])
    on = F.lit(True)
    for k in ("xmin", "ymin", "xmax", "ymax"):
        on = on & (F.col("a_bbox")[k] == F.col("b_bbox")[k])
    return _join(l, r, on, None, "inner").withColumn("a__rect", F.lit(True)).withColumn("b__rect", F.lit(True))


def rows_with_pair(a: DataFrame, b: DataFrame, test: Column, plan: GridPlan) -> DataFrame:
    """Rows of ``a`` that have a pair by a test of the columns ``a_bbox`` and ``b_bbox``, under the prefix ``a_``; a row may show up once
    per cell.  The search for a row ends with its first pair, so nothing grows with the number of pairs."""
    if not plan.left.levels or not plan.right.levels:
        return a.select(*[F.col(f"`{c}`").alias("a_" + c) for c in a.columns]).where(F.lit(False))
    if plan.broadcast == "right" or plan.fine:
        a = spread(a, plan.left, NATIVE_ROWS)
    if plan.fine:
        b = spread(b, plan.right, NATIVE_ROWS)
    l = _keyed(a, F.col("bbox"), "a_", plan.left, plan.right, plan, 0, None, False)
    r = _keyed(b.select("bbox"), F.col("bbox"), "b_", plan.right, plan.left, plan, 1, None, False)
    on = _same_cell(l) & boxes_meet(F.col("a__box"), F.col("b__box")) & test
    out = _join(l, r, on, plan.broadcast, "left_semi")
    return out.drop("a__cell", "a__salt", "a__box")


def boxes_only(plan: GridPlan) -> bool:
    """Points and rectangles on both sides: their boxes say everything."""
    return (plan.left.points or plan.left.rects) and (plan.right.points or plan.right.rects)


NATIVE_ROWS = 50_000         # from here on a layer is re-spread for column tests too


def both_rects(plan: GridPlan) -> Column | bool:
    """Which candidate pairs are two rectangles: True for all, else a column."""
    if plan.left.rects and plan.right.rects:
        return True
    if plan.left.points or plan.right.points:
        return F.lit(False)
    flag = F.lit(True)
    for side, name in ((plan.left, "a__rect"), (plan.right, "b__rect")):
        flag = flag if side.rects else flag & F.col(name)
    return flag


def tidy(pairs: DataFrame) -> DataFrame:
    """Drop the helper columns of candidate pairs."""
    return pairs.drop("a__rect", "b__rect")
