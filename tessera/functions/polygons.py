"""Polygon arithmetic on rings of (x, y): area, clipping to a box, rasterising. Rings may be open or closed; holes are further rings."""

from __future__ import annotations

import numpy as np


def area(ring: np.ndarray) -> float:
    """Unsigned area of a simple ring."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def centroid(ring: np.ndarray) -> tuple[float, float]:
    """Centre of gravity; the mean of the points if the area is zero."""
    x, y = ring[:, 0], ring[:, 1]
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if abs(cross.sum()) < 1e-12:
        return float(x.mean()), float(y.mean())
    return float(((x + np.roll(x, -1)) * cross).sum() / (3 * cross.sum())), float(((y + np.roll(y, -1)) * cross).sum() / (3 * cross.sum()))


Ring = list[tuple[float, float]]


def half(ring: Ring, axis: int, bound: float, above: bool) -> Ring:
    """The part of a ring on one side of an axis-parallel line."""
    if not ring:
        return ring
    sign = 1.0 if above else -1.0
    out = []
    p = ring[-1]
    a = sign * (p[axis] - bound)
    for q in ring:
        b = sign * (q[axis] - bound)
        if (a > 0 > b) or (a < 0 < b):
            t = a / (a - b)
            out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        if b >= 0:
            out.append(q)
        p, a = q, b
    return out


def ring_area(ring: Ring) -> float:
    """Unsigned area of a simple ring of plain tuples: rings of tiles are too short for arrays to pay."""
    total, (px, py) = 0.0, ring[-1] if ring else (0.0, 0.0)
    for x, y in ring:
        total += px * y - x * py
        px, py = x, y
    return abs(total) / 2


def clipped_columns(ring: Ring, xs: range, size: int) -> dict[int, Ring]:
    """The part of a ring in every column of tiles: rows of one column are then cut from the column, not from the whole ring."""
    return {x: half(half(ring, 0, x, True), 0, x + size, False) for x in xs}


def clipped_rows(column: Ring, y: int, size: int) -> Ring:
    return half(half(column, 1, y, True), 1, y + size, False)


def clip(ring: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """The part of a simple ring inside a box, half-plane by half-plane. Its area is exact; disconnected parts are joined by edges of no width."""
    points = [tuple(p) for p in np.asarray(ring, float).tolist()]
    for axis, bound, above in ((0, x1, True), (0, x2, False), (1, y1, True), (1, y2, False)):
        points = half(points, axis, bound, above)
    return np.array(points, float).reshape(-1, 2)


def overlap(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> float:
    """Area inside a box of a polygon given by its exterior and its holes."""
    if not rings:
        return 0.0
    return area(clip(rings[0], *box)) - sum(area(clip(h, *box)) for h in rings[1:])


def touched(ring: np.ndarray) -> list[tuple[float, float]]:
    """The ring's points, with those of its other points that lie on an edge put into that edge."""
    points = [tuple(p) for p in np.round(ring, 9).tolist()]
    out = []
    for p, q in zip(points, points[1:] + points[:1]):
        out.append(p)
        dx, dy = q[0] - p[0], q[1] - p[1]
        length = dx * dx + dy * dy
        on = set()
        for r in points:
            along = (r[0] - p[0]) * dx + (r[1] - p[1]) * dy
            if 0 < along < length and abs((r[0] - p[0]) * dy - (r[1] - p[1]) * dx) <= 1e-9 * max(1.0, length) and r not in (p, q):
                on.add((along, r))
        out += [r for _, r in sorted(on)]
    return out


def parts(ring: np.ndarray) -> list[np.ndarray]:
    """Splits a clipped ring at the points it visits twice, so that bridged parts become rings of their own; parts without area go."""
    out, path, seen = [], [], {}

    def keep(loop: list[tuple[float, float]]) -> None:
        if area(np.array(loop, float).reshape(-1, 2)) > 1e-9:
            out.append(np.array(loop, float))

    if len(ring) < 6:  # too few points to touch itself
        return [ring] if area(ring) > 1e-9 else []
    for p in touched(ring):
        if p in seen:
            at = seen[p]
            keep(path[at:])
            for q in path[at:]:
                seen.pop(q, None)
            path = path[:at]
        seen[p] = len(path)
        path.append(p)
    keep(path)
    return out


def rasterised(rings: list[np.ndarray], width: int, height: int, value: int = 1) -> np.ndarray:
    """Even-odd fill on a pixel grid; a pixel belongs to the polygon if its centre does."""
    mask = np.zeros((height, width), np.uint8)
    for row in range(height):
        y, cuts = row + 0.5, []
        for ring in rings:
            a, b = ring, np.roll(ring, -1, axis=0)
            hit = (a[:, 1] <= y) != (b[:, 1] <= y)
            p, q = a[hit], b[hit]
            cuts += (p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])).tolist()
        cuts.sort()
        for left, right in zip(cuts[::2], cuts[1::2]):
            mask[row, max(0, int(np.ceil(left - 0.5))) : max(0, min(width, int(np.ceil(right - 0.5))))] = value
    return mask
