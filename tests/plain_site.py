"""Plain versions of regions, contours and shorelines: one image at a time, in NumPy."""

from __future__ import annotations

import numpy as np


def label_regions(mask: np.ndarray) -> np.ndarray:
    """4-connected regions of True, numbered from 1 in no special order; 0 elsewhere. Runs of each row are joined to those above."""
    labels = np.zeros(mask.shape, np.int64)
    root: list[int] = [0]

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    above: list[tuple[int, int, int]] = []
    for r in range(mask.shape[0]):
        edge = np.diff(np.concatenate(([0], mask[r].astype(np.int8), [0])))
        here = []
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            root.append(len(root))
            me = len(root) - 1
            for x, y, other in above:
                if x < b and a < y:
                    p, q = find(me), find(other)
                    root[max(p, q)] = min(p, q)
            labels[r, a:b] = me
            here.append((a, b, me))
        above = here
    flat = np.array([find(a) for a in range(len(root))])
    return flat[labels]


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    """True regions of fewer than least pixels become False."""
    labels = label_regions(mask)
    return mask & (np.bincount(labels.ravel())[labels] >= least)


def erode_cross(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=True)
    return p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]


def dilate_square(mask: np.ndarray, radius: int = 2) -> np.ndarray:
    p, k = np.pad(mask, radius, constant_values=False), 2 * radius + 1
    return np.lib.stride_tricks.sliding_window_view(p, (k, k)).any((2, 3))


def clean_classes(water: np.ndarray, least_land: int = 1000, least_water: int = 1000, erosion: bool = True, dilation: bool = True) -> np.ndarray:
    """Water mask after erosion and dilation, then without small land and then without small water regions."""
    if erosion:
        water = erode_cross(water)
    if dilation:
        water = dilate_square(water)
    return drop_small(~drop_small(~water, least_land), least_water)


def chain(segments: np.ndarray) -> list[np.ndarray]:
    """Polylines (n, 2) of directed segments (r0, c0, r1, c1): open ones from where nothing leads to them, closed ones from their smallest vertex, which they repeat; by smallest vertex."""
    after = {(a, b): (c, d) for a, b, c, d in segments}
    led = set(after.values())
    lines, used = [], set()
    for p in [*sorted(set(after) - led), *sorted(after)]:
        line = [p]
        while p in after and p not in used:
            used.add(p)
            p = after[p]
            line.append(p)
        if len(line) > 1:
            lines.append(np.array(line))
    return sorted(lines, key=lambda x: tuple(x[np.lexsort((x[:, 1], x[:, 0]))[0]]))


def contour_lines(land: np.ndarray) -> list[np.ndarray]:
    """Contours at 0.5 of a 0/1 raster, high corners apart on saddles."""
    from tidemark.operators.raster import SEGMENT_CASES

    a = land.astype(int)
    code = 8 * a[:-1, :-1] + 4 * a[:-1, 1:] + 2 * a[1:, 1:] + a[1:, :-1]
    spots = {"T": (0.0, 0.5), "R": (0.5, 1.0), "B": (1.0, 0.5), "L": (0.5, 0.0)}
    out = []
    for k, sides in SEGMENT_CASES.items():
        at = np.argwhere(code == k)
        for s in sides:
            out.append(np.hstack((at + spots[s[0]], at + spots[s[1]])))
    found = np.concatenate(out) if out else np.zeros((0, 4))
    return chain([tuple(x) for x in found.tolist()]) if len(found) else []


def buffer_polygon(inside: np.ndarray) -> np.ndarray:
    """(n, 2) vertices (r, c): each row's first inside pixel downwards, then each row's last upwards; a row of one pixel gives it once. A row's
    gaps are filled by this."""
    rows = np.flatnonzero(inside.any(1))
    first = inside[rows].argmax(1)
    last = inside.shape[1] - 1 - inside[rows][:, ::-1].argmax(1)
    back = last != first
    return np.concatenate((np.stack((rows, first), 1), np.stack((rows, last), 1)[back][::-1]))


def strictly_inside(points: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Even-odd test; points on the outline are outside."""
    a, b = polygon, np.roll(polygon, -1, 0)
    x, y = points[:, 0, None], points[:, 1, None]
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    turn = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
    on = (np.abs(turn) < 1e-9) & (x >= np.minimum(a[:, 0], b[:, 0])) & (x <= np.maximum(a[:, 0], b[:, 0])) & (y >= np.minimum(a[:, 1], b[:, 1])) & (y <= np.maximum(a[:, 1], b[:, 1]))
    return ((over & left).sum(1) % 2 == 1) & ~on.any(1)


def sections(points: np.ndarray, max_gap: float = 10.0, compat: bool = True) -> list[np.ndarray]:
    """The line cut at gaps over max_gap. compat: a lone first vertex makes one section of everything, and each section lacks its last vertex."""
    n = len(points)
    if n == 0:
        return []
    gap = np.flatnonzero(np.hypot(*np.diff(points, axis=0).T) > max_gap) if n > 1 else np.zeros(0, int)
    found, start = [], 0
    for i in gap:
        if i > start:
            found.append((start, int(i)))
        start = int(i) + 1
    if compat:
        if start == 0 or not found:
            found = [(0, n - 1)]
        elif found[-1][1] + 1 < n - 1:
            found.append((found[-1][1] + 1, n - 1))
        return [points[a:b] for a, b in found]
    if start < n - 1:
        found.append((start, n - 1))
    return [points[a : b + 1] for a, b in found]


def resample(points: np.ndarray, sigma: float | None, samples: int = 100, window: int | None = None) -> np.ndarray:
    """The line at `samples` even parameters, Gaussian weights over int(4 sigma + 0.5) neighbours, back to its number of vertices."""
    if sigma is None or len(points) < 2:
        return points
    t, s = np.linspace(0, 1, len(points)), np.linspace(0, 1, samples)
    dense = np.stack([np.interp(s, t, points[:, k]) for k in (0, 1)], 1)
    radius = int(4 * sigma + 0.5)
    if window is not None:
        k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        threes = [np.pad(dense[i - 1 : i + 2], ((radius, radius), (0, 0)), mode="symmetric") for i in range(1, samples - (window - 1), window)]
        return np.concatenate([np.stack([np.convolve(x[:, c], k / k.sum(), "valid") for c in (0, 1)], 1) for x in threes])
    if radius:
        k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
        wide = np.pad(dense, ((radius, radius), (0, 0)), mode="symmetric")
        dense = np.stack([np.convolve(wide[:, i], k / k.sum(), "valid") for i in (0, 1)], 1)
    return np.stack([np.interp(t, s, dense[:, k]) for k in (0, 1)], 1)


def smooth_contour(points: np.ndarray, sigma: float | None = 0.1, min_length: float = 30.0, max_gap: float = 10.0, compat: bool = True, window: int | None = None) -> np.ndarray | None:
    """Sections of min_length or more, smoothed, one after another; None if none is left."""
    kept = [x for x in sections(points, max_gap, compat) if len(x) > 1 and np.hypot(*np.diff(x, axis=0).T).sum() >= min_length]
    return np.concatenate([resample(x, sigma, window=window) for x in kept]) if kept else (points if len(points) == 0 else None)


def inside_buffer(shape: tuple[int, int], s) -> np.ndarray | None:
    """The buffer of the reference line on the image's grid; None without a reference point in bounds."""
    if not s.reference:
        return None
    xtr, xscale, xshear, ytr, yshear, yscale = s.georef
    det = xscale * yscale - xshear * yshear
    p = np.asarray(s.reference, float) - (xtr, ytr)
    at = np.stack(((xscale * p[:, 1] - yshear * p[:, 0]) / det, (yscale * p[:, 0] - xshear * p[:, 1]) / det), 1)
    dense = [at[:1]]
    for a, b in zip(at, at[1:], strict=False):
        n = max(1, int(np.ceil(np.hypot(*(b - a)))))
        dense.append(a + (b - a) * np.arange(1, n + 1)[:, None] / n)
    q = np.rint(np.concatenate(dense)).astype(int)
    q = q[(q[:, 0] > 0) & (q[:, 1] > 0) & (q[:, 0] < shape[0]) & (q[:, 1] < shape[1])]
    if not len(q):
        return None
    out = np.zeros(shape, bool)
    k = s.buffer_radius
    for dr in range(-k, k + 1):
        half = int(np.sqrt(k * k - dr * dr))
        for r, c in np.unique(q, axis=0):
            if 0 <= r + dr < shape[0]:
                out[r + dr, max(0, c - half) : c + half + 1] = True
    return out


def shoreline(water: np.ndarray, masked: np.ndarray, s) -> np.ndarray | None:
    """(n, 2) world vertices in order, or None, of clean classes: contours of land, mask crop, georeference, buffer, sections."""
    lines = contour_lines(~water)
    if not lines:
        return None
    p = np.concatenate(lines)
    cell = p.astype(int)
    keep = (cell >= 2).all(1)
    bad = dilate_square(masked, 2)
    keep &= ~bad[cell[:, 0], cell[:, 1]]
    p = p[keep]
    xtr, xscale, xshear, ytr, yshear, yscale = s.georef

    def world(rc: np.ndarray) -> np.ndarray:
        return np.stack((xscale * rc[:, 1] + xshear * rc[:, 0] + xtr, yshear * rc[:, 1] + yscale * rc[:, 0] + ytr), 1)

    area = inside_buffer(water.shape, s)
    if area is not None and len(p):
        if xshear or yshear:
            raise ValueError("the buffer polygon of a sheared image isn't defined")
        p = p[strictly_inside(world(p), world(buffer_polygon(area)))]
    out = smooth_contour(world(p), s.sigma, s.min_length, s.max_gap, s.compat, s.window) if len(p) else None
    return out if out is not None and len(out) else None
