"""Numpy helpers for the exact part of overlay, relate, buffer and repair.

One idea serves them all: cut the edges of the inputs at every crossing
(``Arrangement``), then label each node, edge and side of an edge with its
location in either input.  Overlay keeps the edges whose two sides differ in
the result; relate reads the dimension of every location pair.

An arrangement holds all pairs of an Arrow batch at once, each as a group of its
own, so the array work is shared by thousands of small geometries.
Geometries are ``(gtype, parts)`` pairs as made by ``codec.decode``.
"""

from __future__ import annotations

import numpy as np

REL_EPS = 1e-10
INSIDE, BORDER, OUTSIDE = 0, 1, 2
POLY, LINE, POINT = 2, 1, 0
QUAD_SEGS = 8  # fixed value: segments per quarter circle of the default round buffer
BLOCK = 1_000_000  # candidate pairs looked at together


def dim(g) -> int:
    return POLY if g[0].endswith("POLYGON") else LINE if g[0].endswith("LINESTRING") else POINT


def cross(a, b):
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def ring_area(r) -> float:
    d = r - r[0]
    return float(cross(d[:-1], d[1:]).sum()) / 2


def polygon_rings(g):
    """Rings with shells counter-clockwise and holes clockwise."""
    out = []
    for part in g[1]:
        for i, r in enumerate(part):
            if len(r) and (r[0] != r[-1]).any():
                r = np.vstack([r, r[:1]])
            if len(r) > 3:
                out.append(r if (ring_area(r) >= 0) == (i == 0) else r[::-1])
    return out


def _chains(g):
    if dim(g) == POLY:
        return polygon_rings(g)
    return [r for part in g[1] for r in part]


def _expand(first, count, block=BLOCK):
    """Blocks of (row, position) for ranges [first, first + count) per row."""
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + block, side="right")) - 1)
        row = np.repeat(np.arange(lo, hi), count[lo:hi])
        pos = np.arange(len(row)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi]) + np.repeat(first[lo:hi], count[lo:hi])
        yield row, pos
        lo = hi


def _same_place(keys):
    """Group equal rows: (group number of every row, first row of every group)."""
    order = np.lexsort(keys.T[::-1])
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    ids = np.empty(len(k), int)
    ids[order] = np.cumsum(new) - 1
    return ids, order[new]


class Arrangement:
    """Noded edges of one or two inputs with their windings, for many groups.

    Every source is a list with one list of geometries per group."""

    def __init__(self, *sources):
        self.groups, k = len(sources[0]), len(sources)
        self.dims = np.array([[max((dim(g) for g in geoms), default=POINT) for geoms in s] for s in sources]).reshape(k, self.groups).T
        chains, meta = [], []   # meta: source, group, dimension, is hole
        for s, source in enumerate(sources):
            for i, geoms in enumerate(source):
                for g in geoms:
                    d = dim(g)
                    for part in g[1]:
                        for j, r in enumerate(part):
                            if len(r):
                                chains.append(r); meta.append((s, i, d, j > 0))
        xy = np.concatenate(chains) if chains else np.empty((0, 2))
        meta = np.array(meta, int).reshape(-1, 4)
        size = np.array([len(c) for c in chains], int)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(int) if chains else np.empty(0, int)
        of = np.repeat(np.arange(len(chains)), size)
        self._frame(xy, meta[of, 1] if len(of) else np.empty(0, int))

        last = start + size - 1
        lone = (meta[:, 2] == POINT) | (size == 1)
        follow = np.ones(len(xy), bool)
        follow[last] = False
        follow &= ~lone[of]
        p = np.flatnonzero(follow)
        seg_chain, p0, p1 = of[p], xy[p], xy[p + 1]
        open_ring = np.flatnonzero((meta[:, 2] == POLY) & ~lone & (xy[start] != xy[last]).any(axis=1)) if len(chains) else []
        if len(open_ring):
            seg_chain = np.concatenate([seg_chain, open_ring])
            p0, p1 = np.concatenate([p0, xy[last[open_ring]]]), np.concatenate([p1, xy[start[open_ring]]])
        # shells counter-clockwise, holes clockwise
        rel = xy[start][seg_chain] if len(chains) else p0
        area = np.bincount(seg_chain, weights=cross(p0 - rel, p1 - rel), minlength=len(chains))
        turn = ((meta[:, 2] == POLY) & ((area >= 0) == (meta[:, 3] == 1)))[seg_chain]
        p0, p1 = np.where(turn[:, None], p1, p0), np.where(turn[:, None], p0, p1)
        keep = (p0 != p1).any(axis=1)
        seg_chain, p0, p1 = seg_chain[keep], p0[keep], p1[keep]
        src, grp = meta[seg_chain, 0], meta[seg_chain, 1]
        loose = np.flatnonzero(lone[of])
        loose_xy, loose_src, loose_grp = xy[loose], meta[of[loose], 0], meta[of[loose], 1]
        tips = np.flatnonzero((meta[:, 2] == LINE) & ~lone & (xy[start] != xy[last]).any(axis=1)) if len(chains) else np.empty(0, int)
        end_xy = np.concatenate([xy[start[tips]], xy[last[tips]]]) if len(tips) else np.empty((0, 2))
        end_src, end_grp = np.tile(meta[tips, 0], 2), np.tile(meta[tips, 1], 2)

        self.crossings = np.zeros(self.groups, int)
        seg, t, cut = self._cut(p0, p1, grp, loose_xy, loose_grp)
        all_xy = np.concatenate([cut, loose_xy, end_xy])
        all_grp = np.concatenate([grp[seg], loose_grp, end_grp])
        cell = np.round((all_xy - self.origin[all_grp]) / self.eps[all_grp, None])
        ids, first = _same_place(np.column_stack([all_grp, cell]))
        self.xy, self.node_grp = all_xy[first], all_grp[first]
        n = max(len(self.xy), 1)
        chain_ids, loose_ids, end_ids = np.split(ids, [len(cut), len(cut) + len(loose_xy)])

        order = np.lexsort((t, seg))
        node, seg = chain_ids[order], seg[order]
        step = (seg[1:] == seg[:-1]) & (node[1:] != node[:-1])
        a, b, e_src = node[:-1][step], node[1:][step], src[seg[:-1][step]]
        key, edge = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_inverse=True)
        self.edges = np.column_stack([key // n, key % n]).astype(int)
        self.edge_grp = self.node_grp[self.edges[:, 0]] if len(key) else np.empty(0, int)
        m = len(key)
        self.n = np.bincount(edge * k + e_src, minlength=m * k).reshape(m, k).astype(float)
        self.w = np.bincount(edge * k + e_src, weights=np.where(a < b, 1.0, -1.0), minlength=m * k).reshape(m, k)
        self.point = np.zeros((len(self.xy), k), bool); self.point[loose_ids, loose_src] = True
        self.line_end = np.bincount(end_ids * k + end_src, minlength=len(self.xy) * k).reshape(-1, k) % 2 == 1
        self._sides()

    def _frame(self, xy, grp):
        """Origin, size and tolerance of every group."""
        lo, hi = np.full((self.groups, 2), np.inf), np.full((self.groups, 2), -np.inf)
        np.minimum.at(lo, grp, xy); np.maximum.at(hi, grp, xy)
        none = ~np.isfinite(lo[:, 0])
        lo[none], hi[none] = 0.0, 1.0
        self.origin = lo
        self.span = np.maximum((hi - lo).max(axis=1), 1e-300)
        self.eps = np.maximum(np.maximum(self.span, np.maximum(np.abs(lo), np.abs(hi)).max(axis=1) * 1e-4), 1e-290) * REL_EPS

    def _key(self, x, grp):
        """Sort key: the group first, then the place of x in it."""
        return grp * 4.0 + (x - self.origin[grp, 0]) / self.span[grp]

    def _cut(self, p0, p1, grp, loose, loose_grp):
        m = len(p0)
        seg, t, xy = [np.arange(m), np.arange(m)], [np.zeros(m), np.ones(m)], [p0, p1]
        d = p1 - p0
        size = np.hypot(d[:, 0], d[:, 1])
        lo, hi = np.minimum(p0, p1), np.maximum(p0, p1)
        eps = self.eps[grp]

        def on_segment(i, pts):
            """Position along segment i when the point lies on its open part."""
            q = pts - p0[i]
            along = (q * d[i]).sum(axis=1) / size[i]
            away = np.abs(cross(d[i], q)) / size[i]
            return along / size[i], (away <= eps[i]) & (along > eps[i]) & (along < size[i] - eps[i])

        left, right = self._key(lo[:, 0], grp), self._key(hi[:, 0], grp) + 1e-9
        order = np.argsort(left, kind="stable")
        end = np.searchsorted(left[order], right[order], side="right")
        begin = np.arange(1, m + 1)
        for row, pos in _expand(begin, np.maximum(end - begin, 0)):
            i, j = order[row], order[pos]
            ok = (lo[i, 1] <= hi[j, 1] + eps[i]) & (lo[j, 1] <= hi[i, 1] + eps[i]) & (lo[j, 0] <= hi[i, 0] + eps[i])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            on, ends = np.concatenate([i, i, j, j]), np.concatenate([p0[j], p1[j], p0[i], p1[i]])
            at, hit = on_segment(on, ends)
            seg.append(on[hit]); t.append(at[hit]); xy.append(ends[hit])
            touched = hit.reshape(4, -1).any(axis=0)
            q, den = p0[j] - p0[i], cross(d[i], d[j])
            ok = ~touched & (np.abs(den) > 1e-14 * size[i] * size[j])
            den = np.where(ok, den, 1.0)
            u, v = cross(q, d[j]) / den, cross(q, d[i]) / den
            ok &= (u * size[i] > eps[i]) & ((1 - u) * size[i] > eps[i]) & (v * size[j] > eps[i]) & ((1 - v) * size[j] > eps[i])
            x = p0[i][ok] + u[ok, None] * d[i][ok]
            seg += [i[ok], j[ok]]; t += [u[ok], v[ok]]; xy += [x, x]
            self.crossings += np.bincount(grp[i[ok | touched]], minlength=self.groups)
        if len(loose) and m:
            by = np.argsort(grp, kind="stable")
            first = np.searchsorted(grp[by], loose_grp, side="left")
            for row, pos in _expand(first, np.searchsorted(grp[by], loose_grp, side="right") - first):
                i = by[pos]
                at, hit = on_segment(i, loose[row])
                seg.append(i[hit]); t.append(at[hit]); xy.append(loose[row][hit])
        return np.concatenate(seg), np.concatenate(t), np.concatenate(xy)

    def _above(self, pts, grp, a, b, c, c_grp, own=None):
        """Winding just above points: minus the weights of the edges above them (a is left of b)."""
        out = np.zeros((len(pts), c.shape[1]))
        if not len(pts) or not len(a):
            return out
        far = self._key(b[:, 0], c_grp)
        order = np.argsort(far, kind="stable")
        far = far[order]
        wide = np.zeros(self.groups)
        np.maximum.at(wide, c_grp, (b[:, 0] - a[:, 0]) / self.span[c_grp])
        at = self._key(pts[:, 0], grp)
        # an edge over x ends right of x, and not farther than the widest edge of the group reaches
        first = np.searchsorted(far, at - 1e-9, side="left")
        count = np.searchsorted(far, at + wide[grp] + 1e-9, side="right") - first
        slope = (b[:, 1] - a[:, 1]) / np.where(b[:, 0] > a[:, 0], b[:, 0] - a[:, 0], 1.0)
        for row, pos in _expand(first, np.maximum(count, 0)):
            e = order[pos]
            x = pts[row, 0]
            ok = (a[e, 0] <= x) & (x < b[e, 0]) & (c_grp[e] == grp[row])
            row, e, x = row[ok], e[ok], x[ok]
            ok = a[e, 1] + (x - a[e, 0]) * slope[e] > pts[row, 1]
            if own is not None:
                ok &= own[row] != e
            for s in range(c.shape[1]):
                out[:, s] -= np.bincount(row[ok], weights=c[e[ok], s], minlength=len(pts))
        return out

    def _sides(self):
        """Winding of every input on the left and right of each edge (low to high node)."""
        self.left, self.right = np.zeros(self.w.shape), np.zeros(self.w.shape)
        w = self.w * (self.dims[self.edge_grp] == POLY)
        used = np.flatnonzero((w != 0).any(axis=1))
        if not len(used):
            return
        a, b = self.xy[self.edges[:, 0]], self.xy[self.edges[:, 1]]
        steep = np.abs(b[:, 1] - a[:, 1]) > np.abs(b[:, 0] - a[:, 0])
        place = np.full(len(a), -1); place[used] = np.arange(len(used))
        keep_frame = self.origin, self.span
        for turned in (False, True):   # steep edges are looked at with the plane turned by a quarter
            pick = np.flatnonzero(steep == turned)
            if not len(pick):
                continue
            p, q = ((np.column_stack([v[:, 1], -v[:, 0]]) for v in (a, b)) if turned else (a, b))
            self.origin = np.column_stack([keep_frame[0][:, 1], -keep_frame[0][:, 0]]) if turned else keep_frame[0]
            swap = q[:, 0] < p[:, 0]
            s, e = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
            c = w * np.where(swap, -1.0, 1.0)[:, None]
            above = self._above((p[pick] + q[pick]) / 2, self.edge_grp[pick], s[used], e[used], c[used], self.edge_grp[used], place[pick])
            below = above - c[pick]
            flip = swap[pick][:, None]
            self.left[pick], self.right[pick] = np.where(flip, below, above), np.where(flip, above, below)
        self.origin, self.span = keep_frame

    def edge_location(self, s):
        l, r = self.left[:, s] > 0, self.right[:, s] > 0
        poly = np.where(l & r, INSIDE, np.where(l | r, BORDER, OUTSIDE))
        return np.where(self.dims[self.edge_grp, s] == POLY, poly, np.where(self.n[:, s] > 0, INSIDE, OUTSIDE))

    def node_location(self, s):
        d = self.dims[self.node_grp, s]
        loc = np.full(len(self.xy), OUTSIDE)
        e = self.edge_location(s)
        for where in (INSIDE, BORDER):
            loc[self.edges[e == where].reshape(-1)] = where
        loc[(d == LINE) & self.line_end[:, s]] = BORDER
        loc[d == POINT] = OUTSIDE
        loc[(d == POINT) & self.point[:, s]] = INSIDE
        alone = d == POLY
        alone[self.edges.reshape(-1)] = False
        if alone.any() and len(self.edges):
            a, b = self.xy[self.edges[:, 0]], self.xy[self.edges[:, 1]]
            swap = b[:, 0] < a[:, 0]
            lo, hi = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
            c = self.w[:, [s]] * np.where(swap, -1.0, 1.0)[:, None]
            w = self._above(self.xy[alone], self.node_grp[alone], lo, hi, c, self.edge_grp)
            loc[alone] = np.where(w[:, 0] > 0, INSIDE, OUTSIDE)
        return loc

    # -- results: parts per group

    def _per_group(self, rows, grp):
        order = np.argsort(grp[rows], kind="stable")
        rows = rows[order]
        g, first = np.unique(grp[rows], return_index=True)
        return zip(g.tolist(), np.split(rows, first[1:])) if len(rows) else ()

    def polygons(self, in_left, in_right):
        """Polygon parts whose inside is left of the kept edges."""
        back = in_right & ~in_left
        rows = np.flatnonzero(in_left != in_right)
        out = {}
        for g, e in self._per_group(rows, self.edge_grp):
            turn = back[e]
            pair = self.edges[e]
            start, stop = np.where(turn, pair[:, 1], pair[:, 0]), np.where(turn, pair[:, 0], pair[:, 1])
            parts = build_polygons(self.xy, start, stop, self.eps[g])
            if parts:
                out[g] = parts
        return out

    def lines(self, keep):
        """Merge kept edges into chains that end where the degree is not two."""
        return {g: _merge_edges(self.xy, self.edges[e]) for g, e in self._per_group(np.flatnonzero(keep), self.edge_grp)}

    def points(self, keep):
        return {g: [[p[None]] for p in self.xy[i]] for g, i in self._per_group(np.flatnonzero(keep), self.node_grp)}


def _merge_edges(xy, e):
    near: dict[int, list[int]] = {}
    for k, (a, b) in enumerate(e.tolist()):
        near.setdefault(a, []).append(k); near.setdefault(b, []).append(k)
    used = np.zeros(len(e), bool)

    def walk(node, k):
        chain = [node]
        while k is not None:
            used[k] = True
            node = int(e[k][0] + e[k][1]) - node
            chain.append(node)
            nxt = [i for i in near[node] if not used[i]]
            k = nxt[0] if len(near[node]) == 2 and nxt else None
        return [xy[chain]]

    out = [walk(n, k) for n in sorted(near) if len(near[n]) != 2 for k in near[n] if not used[k]]
    return out + [walk(int(e[k][0]), k) for k in range(len(e)) if not used[k]]


def trace_rings(xy, start, stop, eps):
    """Simple rings from directed edges (inside on the left): shells and holes, as (area, ring)."""
    out: dict[int, list[int]] = {}
    for k, a in enumerate(start.tolist()):
        out.setdefault(a, []).append(k)
    used = np.zeros(len(start), bool)
    rings = []
    for k0 in range(len(start)):
        if used[k0]:
            continue
        path, seen, k = [int(start[k0])], {int(start[k0]): 0}, k0
        while k is not None:
            used[k] = True
            node = int(stop[k])
            if node in seen:  # a loop is complete: cut it off
                at = seen[node]
                rings.append(path[at:] + [node])
                for x in path[at + 1:]:
                    del seen[x]
                path = path[:at + 1]
            else:
                seen[node] = len(path)
                path.append(node)
            free = [i for i in out.get(node, ()) if not used[i]]
            if len(free) > 1:
                back = xy[start[k]] - xy[node]
                phi = np.arctan2(back[1], back[0])
                go = xy[stop[free]] - xy[node]
                free = [free[int(np.argmin((phi - np.arctan2(go[:, 1], go[:, 0]) - 1e-12) % (2 * np.pi)))]]
            k = free[0] if free and len(path) > 0 and not (len(path) == 1 and not free) else None
    shells, holes = [], []
    for r in rings:
        c = straighten(xy[r], eps)
        area = ring_area(c) if len(c) > 3 else 0.0
        if abs(area) > eps * np.abs(np.diff(c, axis=0)).sum():
            (shells if area > 0 else holes).append((abs(area), c))
    return shells, holes


def build_polygons(xy, start, stop, eps):
    """Simple rings from directed edges (inside on the left), then holes into shells."""
    shells, holes = trace_rings(xy, start, stop, eps)
    shells.sort(key=lambda s: (s[1][:, 0].min(), s[1][:, 1].min(), s[0]))
    parts = [[c] for _, c in shells]
    for _, hole in holes:
        p = (hole[0] + hole[1]) / 2
        inside = [i for i, (_, c) in enumerate(shells) if len(shells) == 1 or in_ring(c, p)]
        if inside:
            parts[min(inside, key=lambda i: shells[i][0])].append(hole)
    return parts


def straighten(ring, eps):
    """Drop ring vertices that lie on the straight line of their neighbours."""
    body = ring[:-1]
    a, b = body - np.roll(body, 1, axis=0), np.roll(body, -1, axis=0) - body
    flat = np.abs(cross(a, b)) <= eps * np.maximum(np.hypot(*a.T), np.hypot(*b.T)) * 0.01
    body = body[~flat]
    return np.vstack([body, body[:1]]) if len(body) > 2 else ring


def in_ring(ring, p) -> bool:
    a, b = ring[:-1], ring[1:]
    up = (a[:, 1] <= p[1]) & (b[:, 1] > p[1])
    down = (a[:, 1] > p[1]) & (b[:, 1] <= p[1])
    side = cross(b - a, p - a)
    return bool(((up & (side > 0)).sum() - (down & (side < 0)).sum()) != 0)


def _typed(d, parts):
    name = ("POINT", "LINESTRING", "POLYGON")[d]
    return (name if len(parts) <= 1 else "MULTI" + name, parts)


def overlay_many(a, b, op):
    """intersection, difference, union or symdifference of pairs of geometries (None stays None).

    An intersection has the highest dimension at which the inputs meet."""
    out, todo = [None] * len(a), []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        dx, dy = dim(x), dim(y)
        if op in ("union", "symdifference") and dx != dy and x[1] and y[1]:
            raise ValueError(f"{op} needs geometries of one dimension")
        if not x[1] or not y[1]:
            out[i] = _typed(min(dx, dy), []) if op == "intersection" else x if op == "difference" or not y[1] else y
        elif op == "difference" and dx > dy:
            out[i] = x
        else:
            todo.append(i)
    if not todo:
        return out
    m = Arrangement([[a[i]] for i in todo], [[b[i]] for i in todo])
    low = m.dims.min(axis=1)
    l, r = m.left > 0, m.right > 0
    rule = {"intersection": lambda p, q: p & q, "difference": lambda p, q: p & ~q, "union": lambda p, q: p | q, "symdifference": lambda p, q: p != q}[op]
    # a line can be cut by a polygon, so the output dimension is that of the first input for a difference
    level = m.dims[:, 0] if op == "difference" else low
    poly = level[m.edge_grp] == POLY
    found = {POLY: m.polygons(rule(l[:, 0], l[:, 1]) & poly, rule(r[:, 0], r[:, 1]) & poly)}
    open_ = np.ones(m.groups, bool)
    open_[list(found[POLY])] = False
    if op != "intersection":
        open_ &= level < POLY
    if open_.any():
        edge = [m.edge_location(s) != OUTSIDE for s in (0, 1)]
        found[LINE] = m.lines(rule(*edge) & open_[m.edge_grp] & (level[m.edge_grp] >= LINE))
        open_[list(found[LINE])] = False
        if op != "intersection":
            open_ &= level < LINE
        if open_.any():
            node = [m.node_location(s) != OUTSIDE for s in (0, 1)]
            found[POINT] = m.points(rule(*node) & open_[m.node_grp])
    for k, i in enumerate(todo):
        out[i] = next((_typed(d, found[d][k]) for d in (POLY, LINE, POINT) if k in found.get(d, ())), _typed(int(level[k]), []))
    return out


def overlay(a, b, op):
    return overlay_many([a], [b], op)[0]


def union_many(groups):
    """Union of each list of geometries; every list must be of one dimension."""
    groups = [[g for g in geoms if g is not None and g[1]] for geoms in groups]
    for geoms in groups:
        if len({dim(g) for g in geoms}) > 1:
            raise ValueError("union needs geometries of one dimension; split the layer by type first")
    m = Arrangement(groups)
    d = m.dims[:, 0]
    e, n = d[m.edge_grp], d[m.node_grp]
    found = {POLY: m.polygons((m.left[:, 0] > 0) & (e == POLY), (m.right[:, 0] > 0) & (e == POLY)),
             LINE: m.lines((m.n[:, 0] > 0) & (e == LINE)), POINT: m.points(m.point[:, 0] & (n == POINT))}
    return [_typed(int(d[k]), found[int(d[k])].get(k, [])) if geoms else ("POLYGON", []) for k, geoms in enumerate(groups)]


def union_all(geoms):
    return union_many([geoms])[0]


def union_one(g):
    """Union of the parts of one geometry; one part needs no work."""
    return g if len(g[1]) == 1 and dim(g) != LINE else union_all([g])


def make_valid_many(geoms):
    """Even-odd repair: an area covered an odd number of times is inside."""
    out, todo = list(geoms), [i for i, g in enumerate(geoms) if g is not None and g[1] and dim(g) == POLY]
    if todo:
        m = Arrangement([[geoms[i]] for i in todo])
        parts = m.polygons(m.left[:, 0] % 2 == 1, m.right[:, 0] % 2 == 1)
        for k, i in enumerate(todo):
            out[i] = _typed(POLY, parts.get(k, []))
    return out


def make_valid(g):
    return make_valid_many([g])[0]


def valid_reason_many(geoms):
    out, todo = [None] * len(geoms), []
    for i, g in enumerate(geoms):
        if g is None:
            continue
        rings = [r for p in g[1] for r in p]
        d = dim(g)
        if not all(np.isfinite(r).all() for r in rings):
            out[i] = "Invalid Coordinate"
        elif d == LINE and any((r == r[0]).all() for r in rings):
            out[i] = "Too few points in geometry component"
        elif d < POLY or not rings:
            out[i] = "Valid Geometry"
        elif any(len(r) < 4 for r in rings):
            out[i] = "Too few points in geometry component"
        elif any((r[0] != r[-1]).any() for r in rings):
            out[i] = "Ring not closed"
        else:
            todo.append(i)
    if not todo:
        return out
    m = Arrangement([[geoms[i]] for i in todo])
    many = np.bincount(m.edge_grp, weights=(m.n[:, 0] > 1), minlength=m.groups) > 0
    w_lo, w_hi = np.zeros(m.groups), np.zeros(m.groups)
    for w in (m.left[:, 0], m.right[:, 0]):
        np.minimum.at(w_lo, m.edge_grp, w); np.maximum.at(w_hi, m.edge_grp, w)
    for k, i in enumerate(todo):
        if many[k] or m.crossings[k]:
            out[i] = "Self-intersection"
        elif any(len(np.unique(r[:-1], axis=0)) < len(r) - 1 - int((r[1:] == r[:-1]).all(axis=1).sum()) for p in geoms[i][1] for r in p):
            out[i] = "Ring Self-intersection"
        else:
            out[i] = "Hole lies outside shell" if w_lo[k] < 0 else "Nested shells" if w_hi[k] > 1 else "Valid Geometry"
    return out


def valid_reason(g) -> str:
    return valid_reason_many([g])[0]


def relate_many(a, b):
    """DE-9IM matrices as nine characters each."""
    out, todo = [None] * len(a), []
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            continue
        if x[1] and y[1]:
            todo.append(i)
            continue
        grid = np.full((3, 3), -1)
        grid[OUTSIDE, OUTSIDE] = 2
        for g, at in ((x, (slice(None), OUTSIDE)), (y, (OUTSIDE, slice(None)))):
            if g[1]:
                grid[at] = (dim(g), {POLY: 1, LINE: 0, POINT: -1}[dim(g)], 2)
        out[i] = _matrix(grid)
    if todo:
        m = Arrangement([[a[i]] for i in todo], [[b[i]] for i in todo])
        grid = np.full((m.groups, 3, 3), -1)
        grid[:, OUTSIDE, OUTSIDE] = 2
        np.maximum.at(grid, (m.node_grp, m.node_location(0), m.node_location(1)), 0)
        np.maximum.at(grid, (m.edge_grp, m.edge_location(0), m.edge_location(1)), 1)
        poly = m.dims[m.edge_grp] == POLY
        for w in (m.left, m.right):
            np.maximum.at(grid, (m.edge_grp, *(np.where((w[:, s] > 0) & poly[:, s], INSIDE, OUTSIDE) for s in (0, 1))), 2)
        for k, i in enumerate(todo):
            out[i] = _matrix(grid[k])
    return out


def _matrix(grid) -> str:
    return "".join("F" if v < 0 else str(v) for v in grid.reshape(-1).tolist())


def relate(a, b) -> str:
    return relate_many([a], [b])[0]


# ---------------------------------------------------------------- buffer

def _capsule(p, q, d):
    """Counter-clockwise outline of all points within d of a segment."""
    base = np.arctan2(q[1] - p[1], q[0] - p[0])
    half = np.pi * np.arange(2 * QUAD_SEGS + 1) / (2 * QUAD_SEGS)
    at_q, at_p = base - np.pi / 2 + half, base + np.pi / 2 + half
    pts = np.vstack([q + d * np.column_stack([np.cos(at_q), np.sin(at_q)]), p + d * np.column_stack([np.cos(at_p), np.sin(at_p)])])
    return np.vstack([pts, pts[:1]])


def capsules(ends, d):
    """Rings of ``_capsule`` for many segments (x1, y1, x2, y2): x and y, a row per segment."""
    x1, y1, x2, y2 = (c[:, None] for c in ends.T)
    base, d = np.arctan2(y2 - y1, x2 - x1), np.asarray(d)[:, None]
    half = np.arange(2 * QUAD_SEGS + 1) * (np.pi / 2 / QUAD_SEGS)
    at_q, at_p = base - np.pi / 2 + half, base + np.pi / 2 + half
    x = np.hstack([x2 + d * np.cos(at_q), x1 + d * np.cos(at_p)])
    y = np.hstack([y2 + d * np.sin(at_q), y1 + d * np.sin(at_p)])
    return np.hstack([x, x[:, :1]]), np.hstack([y, y[:, :1]])


def circles(xy, d):
    """Rings of ``circle`` for many points: x and y, a row per point."""
    t, d = np.arange(4 * QUAD_SEGS) * (2 * np.pi / (4 * QUAD_SEGS)), np.asarray(d)[:, None]
    x, y = xy[:, :1] + d * np.cos(t), xy[:, 1:] + d * np.sin(t)
    return np.hstack([x, x[:, :1]]), np.hstack([y, y[:, :1]])


def round_boxes(box, d):
    """Round-cornered buffer rings of many rectangles (xmin, ymin, xmax, ymax): x and y, a row per rectangle."""
    q, i = (c.ravel() for c in np.mgrid[:4, :QUAD_SEGS + 1])
    t, d = (q * QUAD_SEGS + i) * (np.pi / 2 / QUAD_SEGS), np.asarray(d)[:, None]
    x, y = box[:, np.where((q == 0) | (q == 3), 2, 0)] + d * np.cos(t), box[:, np.where(q < 2, 3, 1)] + d * np.sin(t)
    return np.hstack([x, x[:, :1]]), np.hstack([y, y[:, :1]])


def areas(po, ro, vo, x, y):
    """Areas of all polygons of a batch from the offsets of their parts, rings and vertices; each term is added in turn, as ``native.area`` does."""
    ring = np.repeat(np.arange(len(vo) - 1), np.diff(vo))
    first = vo[:-1][ring]
    x, y = x[vo[0]:vo[-1]] - x[first], y[vo[0]:vo[-1]] - y[first]
    px, py = (np.concatenate([[0.0], c[:-1]])[:len(c)] for c in (x, y))
    start = first == np.arange(vo[0], vo[-1])
    px[start], py[start] = 0.0, 0.0
    one = np.abs(np.bincount(np.repeat(ring, 2), np.column_stack([px * y, -(x * py)]).ravel(), len(vo) - 1) / 2)
    part = np.repeat(np.arange(len(ro) - 1), np.diff(ro))
    own = np.arange(ro[0], ro[-1])
    shell = own == ro[:-1][part]
    one = np.bincount(part, np.where(shell, one[own], -one[own]), len(ro) - 1)
    row = np.repeat(np.arange(len(po) - 1), np.diff(po))
    return np.bincount(row, one[po[0]:po[-1]], len(po) - 1)


def circle(p, d):
    t = 2 * np.pi * np.arange(4 * QUAD_SEGS) / (4 * QUAD_SEGS)
    pts = p + d * np.column_stack([np.cos(t), np.sin(t)])
    return np.vstack([pts, pts[:1]])


def _convex(ring) -> bool:
    e = np.diff(ring, axis=0)
    return bool((cross(e, np.roll(e, -1, axis=0)) >= 0).all()) and abs(np.arctan2(cross(e, np.roll(e, -1, axis=0)), (e * np.roll(e, -1, axis=0)).sum(axis=1)).sum() - 2 * np.pi) < 1e-6


def _convex_buffer(ring, d):
    """Offset of a convex counter-clockwise ring with round corners."""
    e = np.diff(ring, axis=0)
    normal = np.arctan2(e[:, 1], e[:, 0]) - np.pi / 2
    out = []
    for i in range(len(e)):
        v, t0 = ring[i], normal[i - 1]
        turn = (normal[i] - t0) % (2 * np.pi)
        steps = max(1, int(np.ceil(turn / (np.pi / 2 / QUAD_SEGS) - 1e-9)))
        t = t0 + turn * np.arange(steps + 1) / steps
        out.append(v + d * np.column_stack([np.cos(t), np.sin(t)]))
    pts = np.vstack(out)
    return np.vstack([pts, pts[:1]])


def buffer_many(geoms, dists):
    """Round buffers; a negative distance shrinks polygons."""
    out, unions, cuts = [None] * len(geoms), {}, {}
    for i, (g, d) in enumerate(zip(geoms, dists)):
        if g is None or d is None:
            continue
        if not g[1] or (d <= 0 and dim(g) != POLY):
            out[i] = ("POLYGON", [])
        elif d == 0:
            unions[i] = [g]
        elif dim(g) == POINT:
            unions[i] = [("POLYGON", [[circle(p, d)]]) for part in g[1] for r in part for p in r]
        else:
            chains = _chains(g)
            if d > 0 and dim(g) == POLY and len(chains) == 1 and _convex(chains[0]):
                out[i] = ("POLYGON", [[_convex_buffer(chains[0], d)]])
                continue
            rim = [("POLYGON", [[_capsule(p, q, abs(d))]]) for c in chains for p, q in zip(c[:-1], c[1:]) if (p != q).any()]
            rim += [("POLYGON", [[circle(c[0], abs(d))]]) for c in chains if (c == c[0]).all()]
            unions[i] = rim + ([g] if d > 0 and dim(g) == POLY else [])
            if d < 0:
                cuts[i] = g
    for i, u in zip(unions, union_many(list(unions.values())) if unions else ()):
        out[i] = u
    if cuts:
        for i, u in zip(cuts, overlay_many(list(cuts.values()), [out[i] for i in cuts], "difference")):
            out[i] = u
    return out


def buffer(g, d):
    return buffer_many([g], [d])[0]


def grow_and_shrink_many(geoms, dists):
    return buffer_many(buffer_many(geoms, dists), [None if d is None else -d for d in dists])


# ---------------------------------------------------------------- shapes

def convex_hull_xy(pts):
    """Monotone chain: hull vertices, counter-clockwise and not closed."""
    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return p

    def half(seq):
        h = []
        for q in seq:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(q)
        return h[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def hull(pts):
    h = convex_hull_xy(pts)
    if len(h) > 2:
        return ("POLYGON", [[np.vstack([h, h[:1]])]])
    return ("LINESTRING", [[h]]) if len(h) == 2 else ("POINT", [[h]]) if len(h) else ("POLYGON", [])


def simplify_chain(xy, tol):
    """Douglas-Peucker with an explicit stack."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d = xy[j] - xy[i]
        q = xy[i + 1:j] - xy[i]
        n = (d * d).sum()
        u = np.clip((q @ d) / n, 0, 1) if n > 0 else np.zeros(len(q))
        off = np.hypot(*(q - u[:, None] * d).T)
        k = int(np.argmax(off))
        if off[k] > tol:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return xy[keep]


def simplify(g, tol, preserve=False):
    """Simplified geometry; ``preserve`` keeps rings that would collapse and falls back when invalid."""
    if dim(g) == POINT:
        return g
    out = []
    for part in g[1]:
        rings = []
        for k, r in enumerate(part):
            s = simplify_chain(r, tol)
            if dim(g) == POLY and len(s) < 4:
                if not preserve:
                    if k == 0:
                        break
                    continue
                s = r
            rings.append(s)
        if rings:
            out.append(rings)
    res = (g[0], out)
    if preserve and dim(g) == POLY and valid_reason(res) != "Valid Geometry":
        return simplify(g, tol / 2, True) if tol > 1e-12 else g
    return res


def _point_segments(pts, a, b):
    """Closest approach of points to segments: distance matrix and positions."""
    d = b - a
    n = np.maximum((d * d).sum(axis=1), 1e-300)
    u = np.clip(((pts[:, None] - a[None]) * d[None]).sum(axis=2) / n, 0, 1)
    foot = a[None] + u[..., None] * d[None]
    return np.hypot(pts[:, None, 0] - foot[..., 0], pts[:, None, 1] - foot[..., 1]), foot


def _segments(g):
    chains = _chains(g)
    a = [c[:-1] if len(c) > 1 else c for c in chains]
    b = [c[1:] if len(c) > 1 else c for c in chains]
    return np.concatenate(a), np.concatenate(b)


def shortest_line(a, b):
    """(distance, point on a, point on b)."""
    if dim(a) + dim(b) > 0:
        both = overlay(a, b, "intersection")
        if both[1]:
            p = both[1][0][0][0]
            return 0.0, p, p
    best = (np.inf, None, None)
    for g, h, swap in ((a, b, False), (b, a, True)):
        pts = np.concatenate(_chains(g))
        s, e = _segments(h)
        step = max(1, 1_000_000 // len(s))
        for i in range(0, len(pts), step):
            dist, foot = _point_segments(pts[i:i + step], s, e)
            k = np.unravel_index(np.argmin(dist), dist.shape)
            if dist[k] < best[0]:
                p, q = pts[i + k[0]], foot[k]
                best = (float(dist[k]), q, p) if swap else (float(dist[k]), p, q)
    return best


def max_distance(a, b) -> float:
    p, q = convex_hull_xy(np.concatenate(_chains(a))), convex_hull_xy(np.concatenate(_chains(b)))
    return float(np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1]).max())


def hausdorff(a, b) -> float:
    """Discrete Hausdorff distance: vertices against the other geometry."""
    out = 0.0
    for g, h in ((a, b), (b, a)):
        s, e = _segments(h)
        for p in np.concatenate(_chains(g)):
            out = max(out, float(_point_segments(p[None], s, e)[0].min()))
    return out


def point_on_surface(g):
    """A point inside: middle of the widest stretch of a scan line near the middle."""
    if not g[1]:
        return None
    if dim(g) != POLY:
        c = _chains(g)[0]
        return c[len(c) // 2]
    rings = polygon_rings(g)
    ys = np.unique(np.concatenate(rings)[:, 1])
    mid = (ys[0] + ys[-1]) / 2
    k = int(np.clip(np.searchsorted(ys, mid), 1, len(ys) - 1)) if len(ys) > 1 else 0
    y = (ys[k - 1] + ys[k]) / 2 if len(ys) > 1 else mid
    a, b = _segments(g)
    cut = (a[:, 1] <= y) != (b[:, 1] <= y)
    xs = np.sort(a[cut, 0] + (y - a[cut, 1]) / (b[cut, 1] - a[cut, 1]) * (b[cut, 0] - a[cut, 0]))
    if len(xs) < 2:
        return rings[0][0]
    width = xs[1::2] - xs[:-1:2]
    w = int(np.argmax(width))
    return np.array([(xs[2 * w] + xs[2 * w + 1]) / 2, y])


# ---------------------------------------------------------------- circles

def _through(p):
    """Smallest circle with one, two or three points on it: (x, y, radius)."""
    a = p[0]
    if len(p) == 1:
        return a[0], a[1], 0.0
    if len(p) == 3:
        b, c = p[1] - a, p[2] - a
        d = 2 * cross(b, c)
        if d != 0:
            u = np.array([c[1] * (b @ b) - b[1] * (c @ c), b[0] * (c @ c) - c[0] * (b @ b)]) / d
            return a[0] + u[0], a[1] + u[1], float(np.hypot(*u))
        p = max(((p[0], p[1]), (p[0], p[2]), (p[1], p[2])), key=lambda e: np.hypot(*(e[1] - e[0])))   # on one line
    m = (p[0] + p[1]) / 2
    return m[0], m[1], float(np.hypot(*(p[1] - p[0]))) / 2


def smallest_circle(xy):
    """(x, y, radius) of the smallest circle around points: incremental, in a fixed random order."""
    xy = np.unique(np.asarray(xy, float).reshape(-1, 2), axis=0)
    if not len(xy):
        return None
    xy = xy[np.random.default_rng(7).permutation(len(xy))]

    def around(pts, on):
        c = _through(on or [pts[0]])
        while len(on) < 3:
            out = np.hypot(pts[:, 0] - c[0], pts[:, 1] - c[1]) > c[2] * (1 + 1e-12) + 1e-300
            if not out.any():
                break
            k = int(np.argmax(out))
            inner = around(pts[:k], [*on, pts[k]])
            if inner == c:
                break
            c = inner
        return c

    return tuple(float(v) for v in around(xy, []))
