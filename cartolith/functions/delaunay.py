"""Delaunay triangles of one set of points, by divide and conquer (Guibas and Stolfi 1985) with exact signs.

Signs come from floats where their error bound allows, else from exact fractions. Four points on one circle are told apart as if point i, counted in the
order of x and y, were lifted by an infinitely small amount that falls with i; so the triangles of a set are unique, and a triangle of a set is one of
every subset that holds its corners.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

TURN_ERROR, CIRCLE_ERROR = 3.4e-16, 1.12e-15   # of float determinants, against the sum of the sizes of their terms (Shewchuk 1997)


def turn(a, b, c) -> int:
    """1 if a, b, c turn left, -1 right, 0 straight."""
    l, r = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = l - r
    if abs(d) > TURN_ERROR * (abs(l) + abs(r)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (*a, *b, *c))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def in_circle(a, b, c, d) -> int:
    """1 if d lies inside the circle through a, b, c for a left turn (-1 for a right turn), never 0 for three points that turn."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    az, bz, cz = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    p, q, r = bx * cy - by * cx, cx * ay - cy * ax, ax * by - ay * bx
    s = az * p + bz * q + cz * r
    size = az * (abs(bx * cy) + abs(by * cx)) + bz * (abs(cx * ay) + abs(cy * ax)) + cz * (abs(ax * by) + abs(ay * bx))
    if abs(s) > CIRCLE_ERROR * size:
        return 1 if s > 0 else -1
    dx, dy = Fraction(d[0]), Fraction(d[1])
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(v[0]) - dx, Fraction(v[1]) - dy) for v in (a, b, c))
    s = (ax * ax + ay * ay) * (bx * cy - by * cx) + (bx * bx + by * by) * (cx * ay - cy * ax) + (cx * cx + cy * cy) * (ax * by - ay * bx)
    if s:
        return 1 if s > 0 else -1
    lifts = sorted([(a, b, c, d, 1), (b, c, a, d, 1), (c, a, b, d, 1), (d, a, b, c, -1)], key=lambda v: (v[0][0], v[0][1]))
    for _, u, v, w, sign in lifts:
        t = turn(u, v, w)
        if t:
            return sign * t
    return 0


class _Mesh:
    """Directed edges by number; e ^ 1 is the other direction. before and after are the next edges around the origin."""

    def __init__(self, points):
        self.p, self.org, self.after, self.before, self.gone = points, [], [], [], []

    def edge(self, a: int, b: int) -> int:
        e = len(self.org)
        self.org += (a, b)
        self.after += (e, e + 1)
        self.before += (e, e + 1)
        self.gone += (False, False)
        return e

    def splice(self, a: int, b: int) -> None:
        if a != b:
            self.before[self.after[a]], self.before[self.after[b]] = b, a
            self.after[a], self.after[b] = self.after[b], self.after[a]

    def connect(self, a: int, b: int) -> int:
        e = self.edge(self.org[a ^ 1], self.org[b])
        self.splice(e, self.before[a ^ 1])
        self.splice(e ^ 1, b)
        return e

    def drop(self, e: int) -> None:
        self.splice(e, self.before[e])
        self.splice(e ^ 1, self.before[e ^ 1])
        self.gone[e] = self.gone[e ^ 1] = True

    def side(self, q: int, e: int) -> int:
        return turn(self.p[self.org[e]], self.p[self.org[e ^ 1]], self.p[q])

    def few(self, lo: int, n: int) -> tuple[int, int]:
        a = self.edge(lo, lo + 1)
        if n == 2:
            return a, a ^ 1
        b = self.edge(lo + 1, lo + 2)
        self.splice(a ^ 1, b)
        t = self.side(lo + 2, a)
        if t > 0:
            self.connect(b, a)
            return a, b ^ 1
        if t < 0:
            c = self.connect(b, a)
            return c ^ 1, c
        return a, b ^ 1

    def merge(self, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        p, org, (lo, li), (ri, ro) = self.p, self.org, left, right
        while True:      # the common tangent below
            if self.side(org[ri], li) > 0:
                li = self.after[li ^ 1]
            elif self.side(org[li], ri) < 0:
                ri = self.before[ri ^ 1]
            else:
                break
        base = self.connect(li ^ 1, ri)
        if org[li] == org[lo]:
            lo = base
        if org[ri] == org[ro]:
            ro = base ^ 1
        while True:      # upwards, edge by edge
            r, l = self.after[base ^ 1], self.before[base]
            right_ok, left_ok = self.side(org[r ^ 1], base) > 0, self.side(org[l ^ 1], base) > 0
            if not (right_ok or left_ok):
                return lo, ro
            a, b = p[org[base ^ 1]], p[org[base]]
            if right_ok:
                while self.side(org[self.after[r] ^ 1], base) > 0 and in_circle(a, b, p[org[r ^ 1]], p[org[self.after[r] ^ 1]]) < 0:
                    r, old = self.after[r], r
                    self.drop(old)
            if left_ok:
                while self.side(org[self.before[l] ^ 1], base) > 0 and in_circle(a, b, p[org[l ^ 1]], p[org[self.before[l] ^ 1]]) < 0:
                    l, old = self.before[l], l
                    self.drop(old)
            if not right_ok or left_ok and in_circle(p[org[r ^ 1]], p[org[r]], p[org[l]], p[org[l ^ 1]]) < 0:
                base = self.connect(l, base ^ 1)
            else:
                base = self.connect(base ^ 1, r ^ 1)


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (numbers of corners, turning left) of distinct points; none if all lie on one line."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    n = len(order)
    if n < 3:
        return np.empty((0, 3), np.int64)
    mesh = _Mesh([(float(x), float(y)) for x, y in points[order]])

    def build(lo: int, size: int) -> tuple[int, int]:
        if size <= 3:
            return mesh.few(lo, size)
        half = (size + 1) // 2
        return mesh.merge(build(lo, half), build(lo + half, size - half))

    build(0, n)
    org, out, seen = mesh.org, [], set()
    for e in range(len(org)):
        if mesh.gone[e] or e in seen:
            continue
        f = mesh.after[e ^ 1]       # around the face of e
        g = mesh.after[f ^ 1]
        if mesh.after[g ^ 1] == e and mesh.side(org[f ^ 1], e) > 0:
            seen.update((e, f, g))
            out.append((org[e], org[f], org[g]))
    return order[np.array(out, np.int64).reshape(-1, 3)]


def circles(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii of the circles through three points each; an infinite radius where they are so flat that floats say little."""
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    flat = np.abs(d) <= 1e-9 * np.sqrt(uu * vv)
    d = np.where(flat, 1.0, d)
    x, y = (v[:, 1] * uu - u[:, 1] * vv) / d, (u[:, 0] * vv - v[:, 0] * uu) / d
    return np.column_stack([a[:, 0] + x, a[:, 1] + y]), np.where(flat, np.inf, np.hypot(x, y))
