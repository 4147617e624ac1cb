"""NumPy on one image or tile at a time, inside grouped Arrow tasks."""

from __future__ import annotations

import numpy as np


def box_deviation(a: np.ndarray, radius: int) -> np.ndarray:
    """The population deviation over (2 radius + 1) squared cells around each cell of a but its margin of radius; nan cells don't count, nan centres
    stay nan. The last two axes of a are rows and columns, the others hold images of their own."""

    def total(v: np.ndarray) -> np.ndarray:
        across = sum(v[..., k : v.shape[-1] - 2 * radius + k] for k in range(2 * radius + 1))
        return sum(across[..., k : v.shape[-2] - 2 * radius + k, :] for k in range(2 * radius + 1))

    known = ~np.isnan(a)
    x = np.where(known, a, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        n = total(known.astype(float))
        mean = total(x) / n
        out = np.sqrt(np.maximum(total(x * x) / n - mean * mean, 0.0))
    inner = slice(radius, -radius) if radius else slice(None)
    return np.where(known[..., inner, inner], out, np.nan)


def _peak(power: np.ndarray, r: int, c: int) -> tuple[float, float]:
    """How far the peak at (r, c) lies from it, by its larger neighbour's share in each direction."""
    h, w = power.shape
    out = []
    for before, after in ((power[r - 1, c], power[(r + 1) % h, c]), (power[r, c - 1], power[r, (c + 1) % w])):
        side = max(before, after)
        out.append(float((side if after >= before else -side) / (side + power[r, c])))
    return out[0], out[1]


def window_shift(ref: np.ndarray, img: np.ndarray, max_shift: int) -> tuple[float, float, float] | None:
    """(rows, columns, reliability) by which img must move to lie on ref; None without texture or beyond max_shift. The reliability, 0 to 100, is how
    little of the peak's 3 x 3 mean the rest reaches with its mean and three deviations."""
    if np.ptp(ref) == 0 or np.ptp(img) == 0:
        return None
    f = np.fft.fft2(ref - ref.mean()) * np.conj(np.fft.fft2(img - img.mean()))
    power = np.abs(np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)))
    h, w = power.shape
    r, c = (int(v) for v in np.unravel_index(power.argmax(), power.shape))
    dr, dc = r - h if r > h // 2 else r, c - w if c > w // 2 else c
    if max(abs(dr), abs(dc)) > max_shift:
        return None
    around = np.ix_([(r + k) % h for k in (-1, 0, 1)], [(c + k) % w for k in (-1, 0, 1)])
    rest = np.ones(power.shape, bool)
    rest[around] = False
    noise = power[rest].mean() + 3 * power[rest].std() if rest.any() else 0.0
    fr, fc = _peak(power, r, c)
    return dr + fr, dc + fc, float(np.clip(100 - 100 * noise / power[r, c], 0, 100))


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two windows as wholes."""
    span = max(np.ptp(a), np.ptp(b), 1e-12)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    both = ((a - a.mean()) * (b - b.mean())).mean()
    return float((2 * a.mean() * b.mean() + c1) * (2 * both + c2) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var() + b.var() + c2)))


def lattice_shifts(r, c, ref, img, masked, corner: tuple[int, int], grid_res: int, window: int, max_shift: int, tile: int) -> list[tuple]:
    """(r, c, dr, dc, reliability, better) at the clear lattice pixels of the tile that begins at corner, from its pixels and those around it."""
    top, left = int(r.min()), int(c.min())
    known = np.zeros((int(r.max()) - top + 1, int(c.max()) - left + 1), bool)
    a, b = np.full(known.shape, np.nan), np.full(known.shape, np.nan)
    a[r - top, c - left], b[r - top, c - left] = ref, img
    known[r - top, c - left] = ~masked
    known &= ~np.isnan(a) & ~np.isnan(b)
    half, mid, out = window // 2, grid_res // 2, []
    for i in range(-(-(corner[0] - mid) // grid_res) * grid_res + mid, corner[0] + tile, grid_res):
        for j in range(-(-(corner[1] - mid) // grid_res) * grid_res + mid, corner[1] + tile, grid_res):
            y, x = i - top, j - left
            if not (0 <= y < known.shape[0] and 0 <= x < known.shape[1]) or not known[y, x]:
                continue
            part = np.s_[max(0, y - half) : y + half, max(0, x - half) : x + half]
            ok = known[part]
            p, q = (np.where(ok, v[part], v[part][ok].mean()) for v in (a, b))
            if min(p.shape) < 2 * max_shift + 2 or (got := window_shift(p, q, max_shift)) is None:
                continue
            dr, dc, sure = got
            u, v = int(np.floor(dr + 0.5)), int(np.floor(dc + 0.5))
            inner = np.s_[max_shift : p.shape[0] - max_shift, max_shift : p.shape[1] - max_shift]
            moved = np.roll(q, (u, v), (0, 1))
            out.append((i, j, dr, dc, sure, _alike(p[inner], moved[inner]) >= _alike(p[inner], q[inner])))
    return out
