"""Plain table work around layers: queries from picks, row ids, previews, merge, storage order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import native as N
from ..layer import attribute_columns, ensure_bbox, geometry_columns, is_bbox, is_geometry, set_srid, srid_of, with_bbox
from ..plans.scan import ranked
from .transform import force_single, reproject


SPATIAL = re.compile(r"\s*st_(?P<predicate>intersects|within|contains|covers|coveredby|crosses|overlaps|touches|equals)\(\s*(?P<a>\w+)\.geom\s*,\s*(?P<b>\w+)\.geom\s*\)\s*(AND\s+|$)", re.I)


@dataclass
class QuerySpec:
    """SELECT cols FROM tables [WHERE] [GROUP BY] [ORDER BY] from picked pieces.

    ``tables`` maps names to DataFrames; several tables are comma-joined, and their
    WHERE equalities become the join keys.  A spatial predicate between two tables,
    ``st_within(a.geom, b.geom) AND ...``, becomes a grid join of the two, so their
    columns are then named with their table."""
    cols: list[str]
    tables: dict[str, DataFrame]
    where: str | None = None
    group: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)

    def to_sql(self) -> str:
        names = ", ".join("{%s} %s" % (t, t) for t in self.tables)
        q = f"SELECT {', '.join(self.cols) or '*'} FROM {names}"
        if self.where:
            q += f" WHERE {self.where}"
        if self.group:
            q += f" GROUP BY {', '.join(self.group)}"
        if self.order:
            q += f" ORDER BY {', '.join(self.order)}"
        return q

    def to_df(self, spark: SparkSession) -> DataFrame:
        found = SPATIAL.match(self.where or "")
        if found and len(self.tables) == 2 and {found["a"], found["b"]} == set(self.tables):
            return self._joined(found["predicate"].lower(), found["a"], found["b"], self.where[found.end():])
        return spark.sql(self.to_sql(), **self.tables)

    def _joined(self, predicate: str, a: str, b: str, rest: str) -> DataFrame:
        from .joins import spatial_join
        pairs = spatial_join(self.tables[a], self.tables[b], predicate)
        side = lambda prefix, name: F.struct(*[F.col(f"`{prefix}{c}`").alias(c) for c in self.tables[name].columns]).alias(name)
        both = pairs.select(side("a_", a), side("b_", b))
        spec = QuerySpec(self.cols, {"pairs": both}, rest or None, self.group, self.order)
        return both.sparkSession.sql(spec.to_sql(), pairs=both)


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""   # a doubled quote is two quoted texts side by side


def clean_sql(text: str) -> str:
    """A typed statement on one line: comments to the end of a line go, line breaks become spaces, trailing semicolons go; quoted text stays as it is."""
    one = re.sub(rf"({_QUOTED})|--[^\n]*|\s*\n\s*", lambda m: m[1] or " ", text, flags=re.DOTALL)
    return re.sub(r"[;\s]+$", "", one).strip()


def glob(c: Column | str, pattern: str) -> Column:
    """GLOB operator: * any text, ? one character, [..] a set, [^..] all but a set; anything else is itself."""
    out, i = [], 0
    while i < len(pattern):
        inverted = pattern.startswith("[^", i)
        end = pattern.find("]", i + 2 + inverted) if pattern[i] == "[" else -1
        if end > 0:
            out.append(("[^" if inverted else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", pattern[i + 1 + inverted:end]) + "]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(pattern[i], re.escape(pattern[i])))
        i += 1
    return (F.col(c) if isinstance(c, str) else c).rlike(f"(?s)^{''.join(out)}$")


def quote_literal(c: Column | str) -> Column:
    """SQL literal text of a value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def select_attributes(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Chosen attributes, or all non-geometry columns in order."""
    return df.select(*(attribute_columns(df) if cols is None else cols))


def subset(df: DataFrame, expression: str) -> DataFrame:
    return df.where(expression)


def with_row_id(df: DataFrame, order: list[str] | None = None, name: str = "_uid_") -> DataFrame:
    """Row id of any query: numbers 1, 2, .. in the order of ``order`` (no single-task sort),
    or unique but unordered numbers without it."""
    if not order:
        return df.withColumn(name, F.monotonically_increasing_id() + 1)
    return ranked(df, [], order, "row_number").withColumnRenamed("row_number", name)


def preview(df: DataFrame) -> DataFrame:
    """All columns as text; a geometry shows its type, a raster the word RASTER, NULL stays NULL."""
    def show(f):
        c = F.col(f"`{f.name}`")
        if is_geometry(f):
            return c["gtype"].alias(f.name)
        if is_bbox(f):
            return F.concat_ws(" ", *[c[k].cast("string") for k in ("xmin", "ymin", "xmax", "ymax")]).alias(f.name)
        if f.name == "bands" and f.dataType.typeName() == "array":
            return F.when(c.isNotNull(), "RASTER").alias(f.name)
        return c.cast("string").alias(f.name)

    return df.select(*[show(f) for f in df.schema.fields])


PAGE = 201          # fixed values: rows of a page, characters shown of a text, rows of a map preview
TEXT_SHOWN = 300
MAP_ROWS = 1000


def page(df: DataFrame, number: int = 0, order: list[str] | None = None, size: int = PAGE) -> DataFrame:
    """One page of rows; long texts are cut for display and binary values hidden."""
    if order:
        df = df.orderBy(*order)
    cut = [F.substring(F.col(f"`{f.name}`"), 1, TEXT_SHOWN).alias(f.name) if f.dataType.typeName() == "string" else
           F.when(F.col(f"`{f.name}`").isNotNull(), "BINARY").alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`")
           for f in df.schema.fields]
    return df.select(*cut).offset(number * size).limit(size)


def map_preview(df: DataFrame, rows: int = MAP_ROWS, order: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(rows)


def distinct_values(df: DataFrame, col: str, n: int | None = 10) -> DataFrame:
    """Distinct values of a column in order; the first ``n`` or all."""
    d = df.select(col).distinct().orderBy(col)
    return d if n is None else d.limit(n)


# Usual names of a geometry column.
GEOMETRY_NAMES = ("geom", "geometry", "the_geom", "way")


def guess_columns(df: DataFrame) -> tuple[str | None, str | None]:
    """(geometry column, id column): a usual name, else any geometry; the first name with 'id' in it."""
    geom = next((c for c in df.columns if c.lower() in GEOMETRY_NAMES), None) or next(iter(geometry_columns(df)), None)
    return geom, next((c for c in df.columns if "id" in c.lower()), None)


# ---------------------------------------------------------------- merge

def merge_layers(layers: list[DataFrame], single: bool = False, distinct: bool = True, by_name: bool = False) -> DataFrame:
    """Union of layers on attributes and geometry, by position (or by name with gaps as NULL).

    Layers take the SRID of the first one.  Mixed dimensions are refused."""
    if not layers:
        raise ValueError("nothing to merge")
    kinds = set()
    for d in layers:
        kinds |= {r[0] for r in d.where(F.col("geom").isNotNull()).select(N.dimension(F.col("geom"))).distinct().collect()}
    if len(kinds) > 1:
        raise ValueError("the layers hold different geometry types; nothing is merged")
    base = srid_of(layers[0])
    out = None
    for d in layers:
        if base is not None and srid_of(d) not in (None, base):
            d = reproject(d, base)
        d = d.select(*attribute_columns(d), "geom")
        if out is None:
            out = d
        else:
            out = out.unionByName(d, allowMissingColumns=True) if by_name else out.union(d)
    out = with_bbox(out)
    if single:
        out = force_single(out)
    if distinct:
        out = out.dropDuplicates([c for c in out.columns if c != "bbox"])
    return set_srid(out, base)


def set_operation(a: DataFrame, b: DataFrame, kind: str, keep_all: bool = False) -> DataFrame:
    ops = {("union", False): lambda: a.union(b).distinct(), ("union", True): lambda: a.union(b),
           ("intersect", False): lambda: a.intersect(b), ("intersect", True): lambda: a.intersectAll(b),
           ("except", False): lambda: a.subtract(b), ("except", True): lambda: a.exceptAll(b)}
    return ops[kind, keep_all]()


def not_in(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not in the list, as SQL has it: a NULL in the list leaves no row, a NULL value stays only if the list is empty."""
    facts = values.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"))
    n, k = facts.select("n").scalar(), facts.select("k").scalar()
    listed = values.select(F.col(value).alias("_listed")).where(F.col("_listed").isNotNull()).distinct()
    return df.join(listed, F.col(column) == F.col("_listed"), "left_anti").where((n == 0) | ((n == k) & F.col(column).isNotNull()))


# ---------------------------------------------------------------- storage order

def with_zkey(df: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0, name: str = "z") -> DataFrame:
    """Morton key of the box centre on a grid of ``cell`` from (x0, y0)."""
    b = F.col("bbox")
    cx = F.floor(((b["xmin"] + b["xmax"]) / 2 - x0) / cell)
    cy = F.floor(((b["ymin"] + b["ymax"]) / 2 - y0) / cell)
    outside = F.raise_error(F.lit("a box centre lies left of or below the grid's origin")).cast("long")
    return ensure_bbox(df).withColumn(name, F.when((cx < 0) | (cy < 0), outside).otherwise(N.morton(cx, cy, 31)))


def spatial_sort(df: DataFrame, partitions: int | None = None, bits: int = 16) -> DataFrame:
    """Order for storage: near features near each other, so Parquet row groups get tight boxes.

    One small aggregate finds the extent; the sort is a range partitioning."""
    d = ensure_bbox(df)
    e = d.agg(F.min("bbox.xmin").alias("a"), F.min("bbox.ymin").alias("b"), F.max("bbox.xmax").alias("c"), F.max("bbox.ymax").alias("d")).first()
    if e["a"] is None:
        return d
    cell = max(e["c"] - e["a"], e["d"] - e["b"], 1e-9) / (1 << bits)
    z = with_zkey(d, cell, e["a"], e["b"], "_z")
    z = z.repartitionByRange(partitions, "_z") if partitions else z.repartitionByRange("_z")
    return set_srid(z.sortWithinPartitions("_z").drop("_z"), srid_of(df))
