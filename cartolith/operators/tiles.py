"""Raster operators on the tile form: one row per tile with an array of values per band.

A tile row is (rid, tx, ty, width, height, bands): the pixel of its upper-left corner, its size, and row-major values; NULL (and NaN) is nodata. The grid
travels in the metadata of ``bands``. Blocks of values are numpy arrays inside the tasks; what crosses a shuffle is a block, never a row per pixel:

* bands of one tile are combined in place, without any shuffle;
* neighbourhoods are worked off inside each tile; only the strips along tile borders travel, to square cells where the strips of neighbours meet;
* resampling and overviews send, per source tile and target tile, sums of weighted values, already of the target's resolution;
* retiling and burning send the pieces that fall into a target tile.

Results may hold several rows of one ``rid`` (its inside and its border strips); ``whole_tiles`` puts them together for storage.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.codec import decode
from ..layer import make_bbox, make_box, set_srid

TILES = "rid long, tx int, ty int, width int, height int, bands array<array<double>>"
NAMES = ["rid", "tx", "ty", "width", "height", "bands"]
BANDS_T = pa.list_(pa.list_(pa.float64()))
CELL = 1024        # pixels a side of the cells where border strips meet
NEAR = (128, 32)   # pixels a side of the cells where places meet the data around them, and how far around

Box = tuple[int, int, int, int]   # first column, first row, width, height


def stamp(t: DataFrame, grid, flat: bool = False) -> DataFrame:
    """``flat`` says that no two tiles share a pixel, so nothing needs to look for overlaps."""
    return t.withMetadata("bands", {"grid": {k: v for k, v in asdict(grid).items() if v is not None}, "flat": flat})


def is_flat(t: DataFrame) -> bool:
    return bool(t.schema["bands"].metadata.get("flat"))


def _as(t: DataFrame, source: DataFrame) -> DataFrame:
    """With the grid of another raster of the same tiles."""
    return stamp(t, grid_of(source), is_flat(source))


def grid_of(t: DataFrame):
    from .raster import Grid
    meta = t.schema["bands"].metadata.get("grid")
    if meta is None:
        raise ValueError("the raster carries no grid; stamp it first")
    return Grid(**meta)


def is_tiles(r: DataFrame) -> bool:
    return "bands" in r.columns


# ---------------------------------------------------------------- Arrow and numpy

def blocks(batch: pa.RecordBatch | pa.Table, column: str = "bands") -> list[np.ndarray]:
    """(bands, height, width) per row; nodata is NaN, and so is a band that is missing."""
    col = batch.column(column)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return []
    outer, inner = col.offsets.to_numpy(), col.values
    at, values = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
    out = []
    for i, (w, h) in enumerate(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist())):
        a = np.full((outer[i + 1] - outer[i], h * w), np.nan)
        for k, b in enumerate(range(outer[i], outer[i + 1])):
            if at[b + 1] > at[b]:
                a[k] = values[at[b]:at[b + 1]]
        out.append(a.reshape(-1, h, w))
    return out


def bands_array(arrays: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([a.ravel() for a in arrays]) if arrays else np.empty(0)
    sizes = [n for a in arrays for n in [a[0].size if len(a) else 0] * len(a)]
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, mask=np.isnan(values)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32()), inner)


def tile_batch(rows: list[tuple], extra: dict[str, list] | None = None) -> pa.RecordBatch:
    """From (rid, tx, ty, array) rows."""
    cols = [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([v(r) for r in rows], pa.int32()) for v in (lambda r: r[1], lambda r: r[2], lambda r: r[3].shape[2], lambda r: r[3].shape[1])], bands_array([r[3] for r in rows])]
    names = list(NAMES)
    for name, values in (extra or {}).items():
        names.append(name)
        cols.append(pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays(cols, names)


def corners(batch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in NAMES[:5])))


def from_pixels(r: DataFrame, grid) -> DataFrame:
    """Tiles from (rid, band, col, row, value): a tile is the rectangle of its pixels; places without a pixel are nodata. One shuffle by rid."""
    def run(table: pa.Table) -> pa.Table:
        band, col, row = (table.column(c).to_numpy() for c in ("band", "col", "row"))
        c0, r0 = int(col.min()), int(row.min())
        a = np.full((int(band.max()), int(row.max()) - r0 + 1, int(col.max()) - c0 + 1), np.nan)
        a[band - 1, row - r0, col - c0] = table.column("value").to_numpy()
        return pa.Table.from_batches([tile_batch([(table.column("rid")[0].as_py(), c0, r0, a)])])

    return stamp(r.select("rid", "band", "col", "row", "value").groupBy("rid").applyInArrow(run, TILES), grid)


def to_pixels(t: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(rid, band, col, row, value) of every place of every tile."""
    px = t.select(*extra, "rid", "tx", "ty", "width", F.posexplode("bands").alias("b", "vals"))
    px = px.select(*extra, "rid", (F.col("b") + 1).alias("band"), "tx", "ty", "width", F.posexplode("vals").alias("i", "value"))
    return px.select(*extra, "rid", "band", (F.col("tx") + F.col("i") % F.col("width")).alias("col"), (F.col("ty") + F.expr("i div width")).cast("int").alias("row"), "value")


def with_box(t: DataFrame) -> DataFrame:
    """Tiles with their rectangle in the world as ``geom`` and ``bbox``."""
    g = grid_of(t)
    x0, y0 = g.to_world(F.col("tx"), F.col("ty"))
    x1, y1 = g.to_world(F.col("tx") + F.col("width"), F.col("ty") + F.col("height"))
    c = (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return set_srid(t.withColumn("geom", make_box(*c)).withColumn("bbox", make_bbox(*c)), g.srid)


# ---------------------------------------------------------------- mosaic, retile

def has_overlap(t: DataFrame) -> bool:
    """Whether two tiles share a pixel; reads the tiles' corners only."""
    from ..plans.grid import candidate_pairs
    boxes = t.select(F.struct("rid", "tx", "ty").alias("key"), make_bbox(F.col("tx") + 0.25, F.col("ty") + 0.25, F.col("tx") + F.col("width") - 0.25, F.col("ty") + F.col("height") - 0.25).alias("bbox"))
    pairs, _ = candidate_pairs(boxes, boxes, ageom=None, bgeom=None)
    return not pairs.where("a_key < b_key").isEmpty()


def cut(box: Box, w: int, h: int) -> Iterator[tuple[int, int, Box]]:
    """The pieces of a box in the cells of a regular grid of w x h: (cell column, cell row, piece)."""
    c0, r0, n, m = box
    for j in range(r0 // h, (r0 + m - 1) // h + 1):
        for i in range(c0 // w, (c0 + n - 1) // w + 1):
            a, b = max(c0, i * w), max(r0, j * h)
            yield i, j, (a, b, min(c0 + n, (i + 1) * w) - a, min(r0 + m, (j + 1) * h) - b)


PIECES = "ti int, tj int, " + TILES


def _merge_pieces(grid, w: int, h: int):
    """One target tile from its pieces; the highest rid with data wins."""
    across = -(-grid.width // w)

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        box = (i * w, j * h, min(w, grid.width - i * w), min(h, grid.height - j * h))
        each = sorted(zip(corners(table), blocks(table)), key=lambda x: x[0])
        out = np.full((max(len(a) for _, a in each), box[3], box[2]), np.nan)
        for (_, c, r, n, m), a in each:
            spot = out[:len(a), r - box[1]:r - box[1] + m, c - box[0]:c - box[0] + n]
            np.copyto(spot, a, where=~np.isnan(a))
        return pa.Table.from_batches([tile_batch([(j * across + i, box[0], box[1], out)])])

    return run


def retile(t: DataFrame, w: int, h: int) -> DataFrame:
    """Tiles of w x h numbered row by row (smaller at the edges); where tiles overlap, the highest rid with data wins. Each block travels once, in pieces."""
    g = grid_of(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rid, tx, ty, n, m), a in zip(corners(batch), blocks(batch)):
                rows, ti, tj = [], [], []
                for i, j, (c, r, pw, ph) in cut((tx, ty, n, m), w, h):
                    rows.append((rid, c, r, a[:, r - ty:r - ty + ph, c - tx:c - tx + pw]))
                    ti.append(i)
                    tj.append(j)
                yield tile_batch(rows, {"ti": ti, "tj": tj}).select(["ti", "tj", *NAMES])

    pieces = t.select(*NAMES).mapInArrow(run, PIECES)
    return stamp(pieces.groupBy("ti", "tj").applyInArrow(_merge_pieces(g, w, h), TILES), g, True)


def mosaic(t: DataFrame, overlaps: bool | None = None, tile: int = 256) -> DataFrame:
    """One value per pixel. Tiles that do not overlap stay as they are, without a shuffle; ``overlaps`` skips the check."""
    if overlaps is None:
        overlaps = not is_flat(t) and has_overlap(t)
    return retile(t, tile, tile) if overlaps else t


def whole_tiles(t: DataFrame) -> DataFrame:
    """One row per rid again, the rectangle of all its blocks."""
    def run(table: pa.Table) -> pa.Table:
        each = list(zip(corners(table), blocks(table)))
        c0, r0 = min(k[1] for k, _ in each), min(k[2] for k, _ in each)
        out = np.full((max(len(a) for _, a in each), max(k[2] + k[4] for k, _ in each) - r0, max(k[1] + k[3] for k, _ in each) - c0), np.nan)
        for (_, c, r, n, m), a in each:
            out[:len(a), r - r0:r - r0 + m, c - c0:c - c0 + n] = a
        return pa.Table.from_batches([tile_batch([(each[0][0][0], c0, r0, out)])])

    return _as(t.select(*NAMES).groupBy("rid").applyInArrow(run, TILES), t)


# ---------------------------------------------------------------- neighbourhoods

def _frame(tx: int, ty: int, n: int, m: int, d: int) -> list[Box]:
    """The border of a box, d pixels wide, as rectangles that do not overlap."""
    top, left = min(d, m), min(d, n)
    low, right = max(top, m - d), max(left, n - d)
    out = [(tx, ty, n, top), (tx, ty + low, n, m - low), (tx, ty + top, left, low - top), (tx + right, ty + top, n - right, low - top)]
    return [b for b in out if b[2] > 0 and b[3] > 0]


def neighbourhood(t: DataFrame, radius: int, fn: Callable[[np.ndarray], np.ndarray], band: int = 1) -> DataFrame:
    """One band of ``fn`` over the (2 radius + 1) square window of every pixel; fn maps an array to one smaller by radius on every side, NaN in and out.

    A tile's inside needs no other tile. Its border needs strips of 2 radius pixels of this tile and of radius pixels of those around it; they meet in
    cells of CELL x CELL pixels, whichever way tiles lie. So the shuffle carries 8 radius pixels per pixel of a tile's side, not the tile."""
    one = t.select("rid", "tx", "ty", "width", "height", F.array(F.get("bands", F.lit(band - 1))).alias("bands"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rid, tx + radius, ty + radius, fn(a[0])[None]) for (rid, tx, ty, n, m), a in zip(corners(batch), blocks(batch)) if n > 2 * radius and m > 2 * radius]
            if rows:
                yield tile_batch(rows)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ti, tj, ask = [], [], [], []
            for (rid, tx, ty, n, m), a in zip(corners(batch), blocks(batch)):
                for c, r, w, h in _frame(tx, ty, n, m, 2 * radius):
                    for j in range((r - radius) // CELL, (r + h - 1 + radius) // CELL + 1):
                        for i in range((c - radius) // CELL, (c + w - 1 + radius) // CELL + 1):
                            p, q = max(c, i * CELL - radius), max(r, j * CELL - radius)
                            u, v = min(c + w, (i + 1) * CELL + radius), min(r + h, (j + 1) * CELL + radius)
                            rows.append((rid, p, q, a[:1, q - ty:v - ty, p - tx:u - tx]))
                            ti.append(i), tj.append(j), ask.append(0)
                for box in _frame(tx, ty, n, m, radius):
                    for i, j, (p, q, w, h) in cut(box, CELL, CELL):
                        rows.append((rid, p, q, np.empty((0, h, w))))
                        ti.append(i), tj.append(j), ask.append(1)
            if rows:
                yield tile_batch(rows, {"ti": ti, "tj": tj, "ask": ask})

    def seam(table: pa.Table) -> pa.Table:
        c0, r0 = table.column("ti")[0].as_py() * CELL - radius, table.column("tj")[0].as_py() * CELL - radius
        window = np.full((CELL + 2 * radius, CELL + 2 * radius), np.nan)
        ask, keys = table.column("ask").to_pylist(), corners(table)
        for k, a, q in zip(keys, blocks(table), ask):
            if not q:
                window[k[2] - r0:k[2] - r0 + k[4], k[1] - c0:k[1] - c0 + k[3]] = a[0]
        out = []
        for (rid, c, r, n, m), q in zip(keys, ask):
            if q:
                out.append((rid, c, r, fn(window[r - r0 - radius:r - r0 + m + radius, c - c0 - radius:c - c0 + n + radius])[None]))
        return pa.Table.from_batches([tile_batch(out)])

    seams = one.mapInArrow(strips, TILES + ", ti int, tj int, ask int").groupBy("ti", "tj").applyInArrow(seam, TILES)
    return _as(one.mapInArrow(inside, TILES).unionByName(seams), t)


def nearest_inside(v: np.ndarray, c: np.ndarray, r: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest value with data of the places (c, r) of an array, and its squared distance (infinite without any), looked for in the rows up to ``reach``
    above and below; ties go to the upper, then the left place."""
    cols = np.arange(v.shape[1])
    has = ~np.isnan(v)
    before = np.maximum.accumulate(np.where(has, cols, -1), axis=1)                                             # nearest column with data to the left, or here
    after = np.minimum.accumulate(np.where(has, cols, 1 << 30)[:, ::-1], axis=1)[:, ::-1]
    left = np.where(before < 0, 1 << 30, cols - before)
    near = np.where(left <= after - cols, before, after)
    off = np.where(has.any(axis=1)[:, None], np.minimum(left, after - cols).astype(float), np.inf)
    best, value = np.full(len(c), np.inf), np.full(len(c), np.nan)
    for step in range(-reach, reach + 1):
        at = np.clip(r + step, 0, len(v) - 1)
        d = np.where((r + step >= 0) & (r + step < len(v)), off[at, c] ** 2 + step ** 2, np.inf)
        less = np.flatnonzero(d < best)
        best[less], value[less] = d[less], v[at[less], near[at[less], c[less]]]
    return value, best


def nearest(t: DataFrame, places: DataFrame, band: int = 1) -> DataFrame:
    """(col, row, nearest, sure) of places (col, row): the nearest pixel with data that is up to the reach of ``NEAR`` away; ``sure`` is false where there is
    none. Ties go to the upper, then the left pixel.

    A cell's places and the blocks of the tiles around it meet in one task, so a band is sent about twice, as blocks, however wide its gaps are."""
    cell, reach = NEAR
    one = t.select("rid", "tx", "ty", "width", "height", F.array(F.get("bands", F.lit(band - 1))).alias("bands"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rid, tx, ty, n, m), a in zip(corners(batch), blocks(batch)):
                rows, ti, tj = [], [], []
                for j in range((ty - reach) // cell, (ty + m - 1 + reach) // cell + 1):
                    for i in range((tx - reach) // cell, (tx + n - 1 + reach) // cell + 1):
                        p, q = max(tx, i * cell - reach), max(ty, j * cell - reach)
                        u, v = min(tx + n, (i + 1) * cell + reach), min(ty + m, (j + 1) * cell + reach)
                        piece = a[:1, q - ty:v - ty, p - tx:u - tx]
                        if not np.isnan(piece).all():
                            rows.append((rid, p, q, piece))
                            ti.append(i), tj.append(j)
                if rows:
                    yield tile_batch(rows, {"ti": ti, "tj": tj})

    def meet(data: pa.Table, asked: pa.Table) -> pa.Table:
        col, row = (asked.column(k).to_numpy() for k in ("col", "row"))
        value, far = np.full(len(col), np.nan), np.full(len(col), np.inf)
        if len(col) and data.num_rows:
            c0, r0 = asked.column("ti")[0].as_py() * cell - reach, asked.column("tj")[0].as_py() * cell - reach
            window = np.full((cell + 2 * reach, cell + 2 * reach), np.nan)
            for (_, c, r, n, m), a in sorted(zip(corners(data), blocks(data)), key=lambda x: x[0]):
                np.copyto(window[r - r0:r - r0 + m, c - c0:c - c0 + n], a[0], where=~np.isnan(a[0]))
            value, far = nearest_inside(window, col - c0, row - r0, reach)
        sure = far < (reach + 1) ** 2   # what lies outside of the window is farther away
        return pa.table({"col": pa.array(col, pa.int32()), "row": pa.array(row, pa.int32()), "nearest": pa.array(value, mask=~sure), "sure": pa.array(sure)})

    asked = places.select("col", "row", *[F.floor(F.col(k) / cell).cast("int").alias(n) for k, n in (("col", "ti"), ("row", "tj"))])
    data = one.mapInArrow(around, TILES + ", ti int, tj int")
    return data.groupBy("ti", "tj").cogroup(asked.groupBy("ti", "tj")).applyInArrow(meet, "col int, row int, nearest double, sure boolean")


def _shifts(v: np.ndarray, radius: int) -> Iterator[tuple[int, int, np.ndarray]]:
    h, w = v.shape[0] - 2 * radius, v.shape[1] - 2 * radius
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            yield dx - radius, dy - radius, v[dy:dy + h, dx:dx + w]


def focal_function(kind: str, radius: int) -> Callable[[np.ndarray], np.ndarray]:
    """Statistic of the values with data in the window; counts are 0 where there are none, all else nodata."""
    def run(v: np.ndarray) -> np.ndarray:
        size = (v.shape[0] - 2 * radius, v.shape[1] - 2 * radius)
        if kind == "distinct":
            s = np.sort(np.stack([x for _, _, x in _shifts(v, radius)]), axis=0)      # NaN last
            return (~np.isnan(s[0])).astype(float) + ((s[1:] != s[:-1]) & ~np.isnan(s[1:])).sum(axis=0)
        if kind == "invdist":
            top, low = np.zeros(size), np.zeros(size)
            for dx, dy, x in _shifts(v, radius):
                if dx or dy:
                    d, has = math.hypot(dx, dy), ~np.isnan(x)
                    top += np.where(has, x / d, 0)
                    low += has / d
            own = v[radius:radius + size[0], radius:radius + size[1]]
            return np.where(np.isnan(own), top / np.where(low > 0, low, np.nan), own)
        n, total = np.zeros(size), np.zeros(size)
        lo, hi = np.full(size, np.inf), np.full(size, -np.inf)
        for _, _, x in _shifts(v, radius):
            has = ~np.isnan(x)
            n += has
            total += np.where(has, x, 0)
            lo, hi = np.fmin(lo, x), np.fmax(hi, x)
        some = np.where(n > 0, n, np.nan)
        if kind == "stddev":     # from differences to the mean, so large values don't cancel
            mean, q = total / some, np.zeros(size)
            for _, _, x in _shifts(v, radius):
                q += np.where(np.isnan(x), 0, x - mean) ** 2
            return np.sqrt(q / some)
        return {"count": n, "sum": np.where(n > 0, total, np.nan), "mean": total / some, "min": np.where(n > 0, lo, np.nan), "max": np.where(n > 0, hi, np.nan), "range": np.where(n > 0, hi - lo, np.nan)}[kind]

    return run


def focal(t: DataFrame, kind: str, radius: int = 1, band: int = 1) -> DataFrame:
    return neighbourhood(t, radius, focal_function(kind, radius), band)


def rim(t: DataFrame, band: int = 1) -> DataFrame:
    """Only the pixels with data that have a side neighbour without (the outside of the raster counts as without); all else is nodata."""
    def run(v: np.ndarray) -> np.ndarray:
        own = v[1:-1, 1:-1]
        open_ = np.isnan(v[:-2, 1:-1]) | np.isnan(v[2:, 1:-1]) | np.isnan(v[1:-1, :-2]) | np.isnan(v[1:-1, 2:])
        return np.where(open_, own, np.nan)

    return neighbourhood(t, 1, run, band)


def terrain_function(kind: str, sx: float, sy: float, azimuth: float, altitude: float, z_factor: float) -> Callable[[np.ndarray], np.ndarray]:
    def run(v: np.ndarray) -> np.ndarray:
        z = {(dx, dy): x for dx, dy, x in _shifts(v, 1)}
        c = z[0, 0]
        around = [x for k, x in z.items() if k != (0, 0)]
        if kind == "roughness":
            every = np.stack(list(z.values()))
            return every.max(axis=0) - every.min(axis=0)
        if kind == "tpi":
            return c - sum(around) / 8
        if kind == "tri":
            return sum(np.abs(x - c) for x in around) / 8
        gx = ((z[1, -1] + 2 * z[1, 0] + z[1, 1]) - (z[-1, -1] + 2 * z[-1, 0] + z[-1, 1])) / (8 * abs(sx)) * z_factor
        gy = ((z[-1, 1] + 2 * z[0, 1] + z[1, 1]) - (z[-1, -1] + 2 * z[0, -1] + z[1, -1])) / (8 * abs(sy)) * z_factor      # downwards
        whole = ~np.isnan(c + sum(around))
        steep = np.arctan(np.sqrt(gx * gx + gy * gy))
        if kind == "slope":
            return np.where(whole, np.degrees(steep), np.nan)
        aspect = np.degrees(np.arctan2(-gx, gy))
        aspect = np.where((gx == 0) & (gy == 0), np.nan, np.where(aspect < 0, aspect + 360, aspect))
        if kind == "aspect":
            return np.where(whole, aspect, np.nan)
        zenith, azi = math.radians(90 - altitude), math.radians(azimuth)
        shade = 255 * (math.cos(zenith) * np.cos(steep) + math.sin(zenith) * np.sin(steep) * np.cos(azi - np.radians(np.nan_to_num(aspect))))
        return np.where(whole, np.maximum(shade, 0), np.nan)

    return run


def terrain(t: DataFrame, kind: str, band: int = 1, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> DataFrame:
    g = grid_of(t)
    return neighbourhood(t, 1, terrain_function(kind, g.sx, g.sy, azimuth, altitude, z_factor), band)


# ---------------------------------------------------------------- resampling

def _cubic(x, a=-0.5):
    return np.where(x <= 1, (a + 2) * x ** 3 - (a + 3) * x ** 2 + 1, np.where(x < 2, a * x ** 3 - 5 * a * x ** 2 + 8 * a * x - 4 * a, 0))


def _spline(x):
    return np.where(x <= 1, (3 * x ** 3 - 6 * x ** 2 + 4) / 6, np.where(x < 2, (2 - x) ** 3 / 6, 0))


# weight of a source pixel at a distance (in pixels, of the target where that is coarser), and how far it reaches
KERNELS = {"Bilinear": (lambda x: np.maximum(0, 1 - x), 1), "Cubic": (_cubic, 2), "CubicSpline": (_spline, 2), "Lanczos": (lambda x: np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0), 3)}


def _axis(first: int, n: int, ratio: float, size: int, source: int, algorithm: str) -> tuple[int, np.ndarray]:
    """The first target pixel that source pixels first .. first + n reach, and the weights (targets x sources)."""
    if algorithm == "NearestNeighbor":
        lo, hi = max(0, min(size - 1, math.floor(first / ratio - 0.5) - 1)), min(size - 1, math.ceil((first + n) / ratio) + 1)
        at = np.minimum(np.floor((np.arange(lo, hi + 1) + 0.5) * ratio), source - 1)
        own = np.flatnonzero((at >= first) & (at < first + n))
        w = np.zeros((len(own), n))
        w[np.arange(len(own)), (at[own] - first).astype(int)] = 1
        return lo + int(own[0]) if len(own) else 0, w
    fn, radius = KERNELS[algorithm]
    wide = max(1.0, ratio)
    lo = max(0, math.ceil((first + 0.5 - radius * wide) / ratio - 0.5))
    hi = min(size - 1, math.floor((first + n - 0.5 + radius * wide) / ratio - 0.5))
    x = np.abs((np.arange(lo, hi + 1)[:, None] + 0.5) * ratio - (np.arange(first, first + n) + 0.5)[None, :]) / wide
    return lo, fn(x)


def resampled(t: DataFrame, targets: dict[int, object], algorithm: str, tile: int) -> DataFrame:
    """Tiles with ``level``, one raster per target grid. Each tile is read once and sends, per target tile it reaches, the weighted sums of values and of
    weights over its own pixels; a target tile divides the sums of all. Nearest neighbours are weights of one."""
    g = grid_of(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rid, tx, ty, n, m), a in zip(corners(batch), blocks(batch)):
                has = ~np.isnan(a)
                v = np.where(has, a, 0)
                for level, o in targets.items():
                    rx, ry = abs(o.sx / g.sx), abs(o.sy / g.sy)
                    c0, wc = _axis(tx, n, rx, o.width, g.width, algorithm)
                    r0, wr = _axis(ty, m, ry, o.height, g.height, algorithm)
                    if not wc.size or not wr.size:
                        continue
                    both = np.concatenate([wr @ v @ wc.T, wr @ has.astype(float) @ wc.T])
                    rows, ti, tj = [], [], []
                    for i, j, (c, r, w, h) in cut((c0, r0, wc.shape[0], wr.shape[0]), tile, tile):
                        rows.append((rid, c, r, both[:, r - r0:r - r0 + h, c - c0:c - c0 + w]))
                        ti.append(i), tj.append(j)
                    yield tile_batch(rows, {"level": [level] * len(rows), "ti": ti, "tj": tj})

    def join(table: pa.Table) -> pa.Table:
        level, i, j = (table.column(c)[0].as_py() for c in ("level", "ti", "tj"))
        o = targets[level]
        box = (i * tile, j * tile, min(tile, o.width - i * tile), min(tile, o.height - j * tile))
        each = sorted(zip(corners(table), blocks(table)), key=lambda x: x[0])       # sums in one order, whatever came first
        out = np.zeros((max(len(a) for _, a in each), box[3], box[2]))
        for (_, c, r, n, m), a in each:
            out[:len(a), r - box[1]:r - box[1] + m, c - box[0]:c - box[0] + n] += a
        top, low = np.split(out, 2)
        value = top / np.where(np.abs(low) > 1e-12, low, np.nan)
        return pa.Table.from_batches([tile_batch([(j * -(-o.width // tile) + i, box[0], box[1], value)], {"level": [level]})])

    schema = TILES + ", level int"
    return t.select(*NAMES).mapInArrow(run, schema + ", ti int, tj int").groupBy("level", "ti", "tj").applyInArrow(join, schema)


# ---------------------------------------------------------------- bands

def algebra(t: DataFrame, expression: str, bands: tuple[int, ...]) -> DataFrame:
    """One band from an SQL expression over b1, b2, ...; a projection of each tile row, without Python or a shuffle."""
    import re
    wide = t.select("rid", "tx", "ty", "width", "height", *[F.get("bands", F.lit(b - 1)).alias(f"b{b}") for b in bands])
    each = re.sub(r"\b(b\d+)\b", r"_z.\1", expression)
    made = F.expr(f"transform(arrays_zip({', '.join(f'b{b}' for b in bands)}), _z -> CAST({each} AS DOUBLE))")
    return _as(wide.select("rid", "tx", "ty", "width", "height", F.array(made).alias("bands")), t)


def map_band(t: DataFrame, band: int, fn: Callable[[Column], Column]) -> DataFrame:
    """One band changed value by value, the others as they are."""
    return _as(t.withColumn("bands", F.transform("bands", lambda b, i: F.when(i == band - 1, F.transform(b, fn)).otherwise(b))), t)


def drop_band(t: DataFrame, band: int) -> DataFrame:
    return _as(t.withColumn("bands", F.filter("bands", lambda b, i: i != band - 1)), t)


def band_values(t: DataFrame, band: int) -> DataFrame:
    """(value) of one band, a row per pixel with data."""
    return t.select(F.explode(F.get("bands", F.lit(band - 1))).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


# ---------------------------------------------------------------- polygons and tiles

def covered(rings: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which points of a lattice (ys x xs, both rising) lie in the polygon of these rings or on its border."""
    flip = np.zeros((len(ys), len(xs) + 1), bool)
    on = np.zeros((len(ys), len(xs)), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1].tolist(), ring[1:].tolist()):
            if y1 == y2:
                r = np.searchsorted(ys, y1)
                if r < len(ys) and ys[r] == y1:
                    on[r, np.searchsorted(xs, min(x1, x2)):np.searchsorted(xs, max(x1, x2), "right")] = True
                continue
            if y1 > y2:
                x1, y1, x2, y2 = x2, y2, x1, y1
            a, b = np.searchsorted(ys, y1), np.searchsorted(ys, y2, "right")
            x = x1 + (ys[a:b] - y1) * ((x2 - x1) / (y2 - y1))
            at = np.searchsorted(xs, x)
            hit = (at < len(xs)) & (xs[np.minimum(at, len(xs) - 1)] == x)
            on[np.arange(a, b)[hit], at[hit]] = True
            below = ys[a:b] < y2           # each edge owns its lower end
            flip[np.arange(a, b)[below], at[below]] ^= True
    return np.logical_xor.accumulate(flip, axis=1)[:, :-1] | on


def inside(geom, box: Box, g) -> np.ndarray:
    """Which pixel centres of a box a polygonal geometry covers."""
    c, r, n, m = box
    xs, ys = g.ulx + (np.arange(c, c + n) + 0.5) * g.sx, g.uly + (np.arange(r, r + m) + 0.5) * g.sy
    fx, fy = g.sx < 0, g.sy < 0
    out = np.zeros((m, n), bool)
    for part in geom[1]:
        out |= covered(part, xs[::-1] if fx else xs, ys[::-1] if fy else ys)
    return out[::-1 if fy else 1, ::-1 if fx else 1]


ZONAL = "count long, sum double, mean double, m2 double, min double, max double"


def zonal_parts(t: DataFrame, zones: DataFrame, zone_id: str, band: int) -> DataFrame:
    """Per tile and zone: the zone's id, count, sum, mean, squared differences from it, min and max of the pixels whose centre the zone covers."""
    from ..plans.grid import candidate_pairs
    g = grid_of(t)
    one = with_box(stamp(t.select("rid", "tx", "ty", "width", "height", F.array(F.get("bands", F.lit(band - 1))).alias("bands")), g))
    pairs, _ = candidate_pairs(one, zones.select(zone_id, "geom", *(["bbox"] if "bbox" in zones.columns else [])))
    pairs = pairs.select(F.col("b_" + zone_id).alias("zone"), F.col("b_geom").alias("shape"), *[F.col("a_" + c).alias(c) for c in NAMES])
    names = ["zone", "count", "sum", "mean", "m2", "min", "max"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for k, (key, a, shape) in enumerate(zip(corners(batch), blocks(batch), decode(batch.column("shape")))):
                v = a[0][inside(shape, key[1:], g)]
                v = v[~np.isnan(v)]
                if len(v):
                    keep.append(k)
                    out.append((len(v), v.sum(), v.mean(), ((v - v.mean()) ** 2).sum(), v.min(), v.max()))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("zone").take(pa.array(keep, pa.int64())), pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]], names)

    return pairs.mapInArrow(run, f"zone {zones.schema[zone_id].dataType.simpleString()}, {ZONAL}")


def zonal_stats(t: DataFrame, zones: DataFrame, zone_id: str, band: int = 1) -> DataFrame:
    """Statistics of the pixels whose centre lies in each zone (border included). What is shuffled is a row per tile and zone; deviations are merged from
    those of the parts, so nothing cancels for large values."""
    from .aggregate import save_step
    parts = save_step(zonal_parts(t, zones, zone_id, band), "zonal")
    whole = parts.groupBy(F.col("zone").alias("_z")).agg((F.sum("sum") / F.sum("count")).alias("_mean"))
    d = F.col("mean") - F.col("_mean")
    both = parts.join(whole, F.col("zone").eqNullSafe(F.col("_z")))
    return both.groupBy(F.col("zone").alias(zone_id)).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.max("_mean").alias("mean"), F.sqrt(F.sum(F.col("m2") + F.col("count") * d * d) / F.sum("count")).alias("stddev"), F.min("min").alias("min"), F.max("max").alias("max"))


def clip(t: DataFrame, cover: DataFrame) -> DataFrame:
    """Tiles that have a cover (rid, geom), with nodata outside of it."""
    g = grid_of(t)
    both = t.select(*NAMES).join(cover.select(F.col("rid").alias("_rid"), F.col("geom").alias("cover")), F.col("rid") == F.col("_rid")).drop("_rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k[0], k[1], k[2], np.where(inside(shape, k[1:], g), a, np.nan)) for k, a, shape in zip(corners(batch), blocks(batch), decode(batch.column("cover"))) if shape is not None]
            if rows:
                yield tile_batch(rows)

    return _as(both.mapInArrow(run, TILES), t)


def burn(layer: DataFrame, grid, value: str, order: str, tile: int) -> DataFrame:
    """Tiles from polygons: pixels whose centre is covered take ``value``; the highest ``order`` (a number) wins, of equal orders the highest value.

    Rows come by target tile and task: each task paints its own rows of a tile into one block of values and orders, and a tile merges the blocks of the
    tasks, so a tile under most of the features is not one task's work. Tiles without a feature have no row."""
    b = F.col("bbox")
    ca, ra = grid.to_pixel(b["xmin"], b["ymin"])
    cb, rb = grid.to_pixel(b["xmax"], b["ymax"])
    span = lambda p, q, n: (F.greatest(F.lit(0).cast("long"), F.floor(F.least(p, q))), F.least(F.lit(n - 1).cast("long"), F.floor(F.greatest(p, q))))
    (c0, c1), (r0, r1) = span(ca, cb, grid.width), span(ra, rb, grid.height)
    df = layer.where(b.isNotNull()).select(F.col(value).cast("double").alias("value"), F.col(order).cast("double").alias("o"), "geom", c0.alias("c0"), c1.alias("c1"), r0.alias("r0"), r1.alias("r1")).where("c0 <= c1 AND r0 <= r1")
    df = df.withColumn("ti", F.explode(F.expr(f"sequence(c0 div {tile}, c1 div {tile})"))).withColumn("tj", F.explode(F.expr(f"sequence(r0 div {tile}, r1 div {tile})")))
    n = int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(F.col("ti").cast("int").alias("ti"), F.col("tj").cast("int").alias("tj"), "value", "o", "geom").repartition(n).sortWithinPartitions("ti", "tj")
    across = -(-grid.width // tile)

    def box_of(i, j):
        return i * tile, j * tile, min(tile, grid.width - i * tile), min(tile, grid.height - j * tile)

    def laid(block, values, orders, where):
        old, was = block
        wins = where & (np.isnan(was) | (orders > was) | ((orders == was) & (values > old)))
        np.copyto(old, values, where=wins)
        np.copyto(was, orders, where=wins)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            for i, j, v, o, shape in zip(*(batch.column(c).to_pylist() for c in ("ti", "tj", "value", "o")), decode(batch.column("geom"))):
                if key != (i, j):
                    if key is not None:
                        yield tile_batch([(0, key[0] * tile, key[1] * tile, block)], {"ti": [key[0]], "tj": [key[1]]})
                    key, block = (i, j), np.full((2, *box_of(i, j)[:1:-1]), np.nan)
                if shape is not None and v is not None and o is not None:
                    laid(block, v, o, inside(shape, box_of(i, j), grid))
        if key is not None:
            yield tile_batch([(0, key[0] * tile, key[1] * tile, block)], {"ti": [key[0]], "tj": [key[1]]})

    def merge(table: pa.Table) -> pa.Table:
        i, j = table.column("ti")[0].as_py(), table.column("tj")[0].as_py()
        out = np.full((2, *box_of(i, j)[:1:-1]), np.nan)
        for a in blocks(table):
            laid(out, a[0], a[1], ~np.isnan(a[1]))
        return pa.Table.from_batches([tile_batch([(j * across + i, i * tile, j * tile, out[:1])])])

    return stamp(df.mapInArrow(paint, TILES + ", ti int, tj int").groupBy("ti", "tj").applyInArrow(merge, TILES), grid, True)
