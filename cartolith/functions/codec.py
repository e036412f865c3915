"""Arrow columns of geometry structs <-> numpy coordinate arrays, and WKB."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VERTEX_T = pa.struct([("x", pa.float64()), ("y", pa.float64())])
GEOM_T = pa.struct([("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(VERTEX_T))))])

Geom = tuple  # (gtype, parts) with parts: list[list[ndarray (n, 2)]]


def decode(arr) -> list[Geom | None]:
    """Geometries of one Arrow batch; vertices are views on the flat buffers."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    gtype, parts = arr.flatten()
    nulls = np.asarray(arr.is_null())
    po = parts.offsets.to_numpy()
    ro = parts.values.offsets.to_numpy()
    vo = parts.values.values.offsets.to_numpy()
    xs, ys = parts.values.values.values.flatten()
    xy = np.column_stack([xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False)])
    out = []
    for i, name in enumerate(gtype.to_pylist()):
        if nulls[i] or name is None:
            out.append(None)
            continue
        out.append((name, [[xy[vo[r]:vo[r + 1]] for r in range(ro[p], ro[p + 1])] for p in range(po[i], po[i + 1])]))
    return out


def flat(arr) -> tuple:
    """Offsets of parts, rings and vertices, and the vertices of one Arrow batch with their coordinates (NULL as NaN)."""
    parts = arr.flatten()[1]
    lists = parts, parts.values, parts.values.values
    v = lists[2].values
    x, y = (c.to_numpy(zero_copy_only=False) for c in v.flatten())
    return *(a.offsets.to_numpy() if len(a) else np.zeros(1, int) for a in lists), v, x, y   # no list, perhaps no buffer of offsets


def points_and_segments(arr) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch that are one point, or a line of two different vertices; their coordinates (x1, y1, x2, y2), and which of them are NULL."""
    gtype, parts = arr.flatten()
    po, ro, vo, v, x, y = flat(arr)
    at = vo[ro[po]]
    has = {k: np.asarray(pc.fill_null(pc.equal(gtype, k), False)) for k in ("POINT", "LINESTRING")}
    size, whole = np.diff(at), not (parts.values.null_count or parts.values.values.null_count)
    rows = np.flatnonzero(has["POINT"] & (np.diff(po) == 1) & (size > 0) & whole)
    i, no = at[rows], np.column_stack([np.asarray(c.is_null()) for c in v.flatten()])
    out = {"points": (rows, np.column_stack([x[i], y[i]]), no[i])}
    rows = np.flatnonzero(has["LINESTRING"] & (size == 2) & whole)
    i = at[rows]
    same = [((c[i] == c[i + 1]) | (np.isnan(c[i]) & np.isnan(c[i + 1]))) & (no[i, k] == no[i + 1, k]) for k, c in enumerate((x, y))]
    gone = np.asarray(v.is_null())
    keep = ~(same[0] & same[1]) & ~gone[i] & ~gone[i + 1]
    rows, i = rows[keep], i[keep]
    return out | {"segments": (rows, np.column_stack([x[i], y[i], x[i + 1], y[i + 1]]), np.column_stack([no[i], no[i + 1]]))}


def boxes_of_rings(arr, rows: np.ndarray) -> np.ndarray:
    """(xmin, ymin, xmax, ymax) of the first five vertices of the rows named."""
    po, ro, vo, _, x, y = flat(arr)
    i = vo[ro[po]][rows][:, None] + np.arange(5)
    return np.column_stack([x[i].min(axis=1), y[i].min(axis=1), x[i].max(axis=1), y[i].max(axis=1)]) if len(rows) else np.empty((0, 4))


def one_ring_polygons(x: np.ndarray, y: np.ndarray, no_x: np.ndarray, no_y: np.ndarray) -> pa.Array:
    """Polygons of one ring each from the rows of two matrices; a coordinate is NULL in the rows marked."""
    k, m = x.shape
    v = pa.StructArray.from_arrays([pa.array(c.ravel(), mask=np.repeat(no, m) if no.any() else None) for c, no in ((x, no_x), (y, no_y))], fields=list(VERTEX_T))
    each = pa.array(np.arange(k + 1), pa.int32())
    rings = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * m, pa.int32()), v)
    parts = pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(each, rings))
    return pa.StructArray.from_arrays([pa.array(["POLYGON"] * k, pa.string()), parts], fields=list(GEOM_T))


def encode(geoms: list[Geom | None]) -> pa.Array:
    names, po, ro, vo, coords = [], [0], [0], [0], []
    for g in geoms:
        names.append(None if g is None else g[0])
        for part in () if g is None else g[1]:
            for ring in part:
                coords.append(np.asarray(ring, dtype=float).reshape(-1, 2))
                vo.append(vo[-1] + len(coords[-1]))
            ro.append(ro[-1] + len(part))
        po.append(len(ro) - 1)
    xy = np.concatenate(coords) if coords else np.empty((0, 2))
    v = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(VERTEX_T))
    rings = pa.ListArray.from_arrays(pa.array(vo, pa.int32()), v)
    lists = pa.ListArray.from_arrays(pa.array(ro, pa.int32()), rings)
    parts = pa.ListArray.from_arrays(pa.array(po, pa.int32()), lists)
    mask = pa.array([g is None for g in geoms], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), parts], fields=list(GEOM_T), mask=mask)


# ---------------------------------------------------------------- WKB

WKB_CODE = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6}
WKB_NAME = {v: k for k, v in WKB_CODE.items()}


def to_wkb(g: Geom | None) -> bytes | None:
    """Little-endian WKB."""
    if g is None:
        return None

    def pts(r):
        return np.ascontiguousarray(r, dtype="<f8").tobytes()

    def one(name, part):
        head = struct.pack("<BI", 1, WKB_CODE[name])
        if name == "POINT":
            return head + pts(part[0])
        if name == "LINESTRING":
            return head + struct.pack("<I", len(part[0])) + pts(part[0])
        return head + struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(r)) + pts(r) for r in part)

    name, parts = g
    if name.startswith("MULTI"):
        return struct.pack("<BII", 1, WKB_CODE[name], len(parts)) + b"".join(one(name[5:], p) for p in parts)
    if not parts:
        return struct.pack("<BI", 1, WKB_CODE[name]) + (struct.pack("<dd", np.nan, np.nan) if name == "POINT" else struct.pack("<I", 0))
    return one(name, parts[0])


def from_wkb(data: bytes | None) -> Geom | None:
    """WKB or EWKB with XY coordinates; curves and Z/M raise."""
    if data is None:
        return None
    data = bytes(data)

    def read(pos):
        e = "<" if data[pos] else ">"
        code = struct.unpack_from(e + "I", data, pos + 1)[0]
        pos += 5
        if code & 0x20000000:  # EWKB: SRID follows
            code &= ~0x20000000
            pos += 4
        if code not in WKB_NAME:
            raise ValueError(f"unsupported WKB geometry code {code}")
        name = WKB_NAME[code]

        def pts(n, at):
            return np.frombuffer(data, e + "f8", 2 * n, at).reshape(n, 2).astype(float), at + 16 * n

        if name == "POINT":
            xy, pos = pts(1, pos)
            return (name, [] if np.isnan(xy).all() else [[xy]]), pos
        n = struct.unpack_from(e + "I", data, pos)[0]
        pos += 4
        if name == "LINESTRING":
            xy, pos = pts(n, pos)
            return (name, [[xy]] if n else []), pos
        if name == "POLYGON":
            rings = []
            for _ in range(n):
                k = struct.unpack_from(e + "I", data, pos)[0]
                xy, pos = pts(k, pos + 4)
                rings.append(xy)
            return (name, [rings] if rings else []), pos
        parts = []
        for _ in range(n):
            g, pos = read(pos)
            parts += g[1]
        return (name, parts), pos

    return read(0)[0]
