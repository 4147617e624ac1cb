import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain_site as k
from tidemark.operators import kernels


def grids(n=9):
    return st.integers(2, n).flatmap(lambda h: st.integers(2, n).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def flood(mask):
    seen, parts = np.zeros(mask.shape, int), 0
    for r, c in np.argwhere(mask):
        if not seen[r, c]:
            parts += 1
            todo = [(r, c)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not seen[y, x]:
                    seen[y, x] = parts
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return seen


@given(grids())
@settings(max_examples=150, deadline=None)
def test_regions(mask):
    a, b = k.label_regions(mask), flood(mask)
    assert ((a > 0) == mask).all() and len(set(zip(a.ravel(), b.ravel()))) == len(set(a.ravel()))
    once = k.drop_small(mask, 3)
    assert (k.drop_small(once, 3) == once).all() and not (once & ~mask).any()


@given(grids())
@settings(max_examples=150, deadline=None)
def test_erosion_and_dilation_order(mask):
    assert not (k.erode_cross(mask) & ~mask).any() and not (mask & ~k.dilate_square(mask)).any()


@given(grids())
@settings(max_examples=150, deadline=None)
def test_contours_use_each_segment_once(mask):
    lines = k.contour_lines(mask)
    steps = sum(len(x) - 1 for x in lines)
    cells = sum(1 if 0 < s < 4 else 0 for r in range(mask.shape[0] - 1) for c in range(mask.shape[1] - 1) for s in [mask[r : r + 2, c : c + 2].sum()])
    saddles = sum(mask[r, c] == mask[r + 1, c + 1] != mask[r, c + 1] == mask[r + 1, c] for r in range(mask.shape[0] - 1) for c in range(mask.shape[1] - 1))
    assert steps == cells + saddles
    for x in lines:
        closed = (x[0] == x[-1]).all()
        edge = all(p[0] in (0, mask.shape[0] - 1) or p[1] in (0, mask.shape[1] - 1) for p in (x[0], x[-1]))
        assert closed or edge
        assert (np.abs(np.diff(x, axis=0)).sum(1) == 1).all()


def test_saddle_keeps_high_corners_apart():
    lines = k.contour_lines(np.array([[1, 0], [0, 1]], bool))
    assert sorted(tuple(map(tuple, sorted(x.tolist()))) for x in lines) == [((0.0, 0.5), (0.5, 0.0)), ((0.5, 1.0), (1.0, 0.5))]


def test_small_regions_by_size():
    water = np.ones((12, 12), bool)
    water[2:4, 2:4] = False
    water[6:10, 5:9] = False
    out = k.clean_classes(water, least_land=5, least_water=5, erosion=False, dilation=False)
    assert out[2:4, 2:4].all() and not out[6:10, 5:9].any()


def test_polygon_and_strict_interior():
    area = np.zeros((6, 8), bool)
    area[1:5, 2:7] = True
    area[2, 4] = False  # gaps in a row are filled
    p = k.buffer_polygon(area)
    assert len(p) == 8
    got = k.strictly_inside(np.array([[2.0, 4.0], [1.0, 3.0], [2.5, 2.0], [3.9, 5.9], [4.0, 6.0], [0.0, 0.0]]), p)
    assert got.tolist() == [True, False, False, True, False, False]


def test_sections_quirks():
    line = np.array([[0.0, 0], [1, 0], [2, 0], [50, 0], [51, 0], [52, 0], [53, 0]])
    assert [len(x) for x in k.sections(line)] == [2, 3]  # each lacks its last vertex
    assert [len(x) for x in k.sections(line, compat=False)] == [3, 4]
    lone = np.array([[0.0, 0], [50, 0], [51, 0], [52, 0]])
    assert len(k.sections(lone)) == 1 and len(k.sections(lone)[0]) == 3  # everything, gap included
    assert [len(x) for x in k.sections(lone, compat=False)] == [3]
    assert k.sections(np.zeros((0, 2))) == []


def test_smoothing():
    line = np.stack((np.arange(60.0), np.zeros(60)), 1)
    assert np.allclose(k.smooth_contour(line, min_length=30)[:, 1], 0)
    assert k.smooth_contour(line, min_length=100) is None
    assert len(k.smooth_contour(line, None, 30)) == 59
    wavy = np.stack((np.arange(60.0), np.tile([0.0, 1.0], 30)), 1)
    assert np.ptp(k.resample(wavy, 5.0)[20:40, 1]) < np.ptp(k.resample(wavy, 0.1)[20:40, 1])


@pytest.mark.parametrize("shift", [(0, 0), (3, -5), (-7, 2)])
def test_phase(shift):
    a = np.random.default_rng(0).random((64, 64))
    dr, dc, sure = kernels.window_shift(a, np.roll(a, (-shift[0], -shift[1]), (0, 1)), 8)
    assert (round(dr), round(dc)) == shift and abs(dr - shift[0]) < 0.1 and sure > 80
    assert kernels.window_shift(a, np.roll(a, 12, 0), 8) is None and kernels.window_shift(a, np.ones((64, 64)), 8) is None
