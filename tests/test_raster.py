"""Contours and pixels on drawn shapes."""

import numpy as np
import pytest

from tilewright.functions import raster as R

SQUARE = np.array([[10, 10], [30, 10], [30, 30], [10, 30]], float)


def test_polygons_in_a_tile():
    box, share = R.kept_box(SQUARE, 0, 0, 100)
    assert box == (10, 10, 31, 31) and share == 1.0
    assert R.fill_polygon(SQUARE, 100, 100).sum() == 21 * 21
    assert R.visible_mask(SQUARE + 490, 0, 0, 100) is None
    bar = lambda a, b: np.array([[a, 46], [b, 46], [b, 54], [a, 54]], float)
    assert R.kept_box(bar(-150, 250), 0, 0, 100)
    assert R.kept_box(bar(-1950, 2050), 0, 0, 100, visible=0.1)
    assert R.kept_box(np.array([[98, 40], [118, 40], [118, 60], [98, 60]], float), 0, 0, 100) is None


def test_traces_fill_again():
    u = np.zeros((40, 50), bool)
    u[5:30, 5:10] = u[5:30, 20:25] = u[25:30, 5:25] = True
    blob = np.zeros((40, 50), bool)
    yy, xx = np.mgrid[:40, :50]
    blob[(yy - 20) ** 2 + (xx - 22) ** 2 <= 144] = True
    sliver = np.zeros((40, 50), bool)
    sliver[7, 3:40] = True
    for mask in (u, blob, sliver):
        back = np.zeros_like(mask)
        for p in R.trace(mask):
            back |= R.fill_polygon(p, *mask.shape)
        assert (back == mask).all()
    two = u.copy()
    two[25:30, 10:20] = False
    pieces = R.trace(two)
    assert len(pieces) == 2 and len(R.merge(*pieces)) == len(pieces[0]) + len(pieces[1]) + 2


def test_fills_line_by_line():
    def plain(p, height, width):
        mask, q = np.zeros((height, width), bool), np.roll(p, -1, axis=0)
        for y in range(height):
            xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in zip(p, q) if (a[1] <= y) != (b[1] <= y))
            for x0, x1 in zip(xs[::2], xs[1::2]):
                mask[y, max(0, int(np.ceil(x0))) : max(0, int(np.floor(x1)) + 1)] = True
        for a, b in zip(p, q):
            n = int(max(*abs(b - a), 1))
            x, y = (np.rint(np.linspace(a[i], b[i], n + 1)).astype(int) for i in (0, 1))
            ok = (x >= 0) & (x < width) & (y >= 0) & (y < height)
            mask[y[ok], x[ok]] = True
        return mask

    rng = np.random.default_rng(0)
    for i in range(300):
        p = rng.integers(-20, 60, (1 + i % 9, 2)) + (rng.random((1 + i % 9, 2)) if i % 4 == 0 else 0.0)
        if i % 3 == 0 and len(p) > 1:  # a box
            p = np.array([p[0], (p[1][0], p[0][1]), p[1], (p[0][0], p[1][1])])
        assert (R.fill_polygon(p, 35, 1 + i % 40) == plain(p, 35, 1 + i % 40)).all()


def test_noise_in_pieces():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.2, 0.4, 0.6, 1.0):
        mask = rng.random((30, 40)) < share
        left, pieces = {(int(x), int(y)) for y, x in zip(*np.nonzero(mask))}, []
        for y, x in zip(*np.nonzero(mask)):
            todo, piece = [(int(x), int(y))], set()
            while todo:
                p = todo.pop()
                if p in left:
                    left.remove(p)
                    piece.add(p)
                    todo += [(p[0] + dx, p[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
            pieces += [piece] if piece else []
        labels, n = R.components(mask)
        assert n == len(pieces) and all((labels[y, x] == labels[next(iter(p))[::-1]]) for p in pieces for x, y in p)
        loops = R.trace(mask)
        ends = lambda p: (min(p), max(p), min(y for _, y in p), max(y for _, y in p))
        assert sorted(ends(set(map(tuple, loop.tolist()))) for loop in loops) == sorted(map(ends, pieces))
        assert all((abs(np.diff(loop, axis=0)) <= 1).all() for loop in loops)


def test_single_pixels_are_padded():
    m = np.zeros((5, 5), bool)
    m[2, 2] = True
    assert len(R.trace(m)[0]) == 3


def test_simplify():
    dense = np.concatenate([np.linspace(a, b, 5, endpoint=False) for a, b in zip(SQUARE, np.roll(SQUARE, -1, 0))])
    assert len(R.simplify(dense, 1.0)) == 4
    assert R.simplify(dense, 0) is dense or (R.simplify(dense, 0) == dense).all()


def test_class_raster_order_and_shapes():
    shapes = [(SQUARE, 3), (SQUARE + 5, 8), (SQUARE + 10, 7)]
    out = R.class_raster(shapes, 60, 60)
    assert out[20, 20] == 3 and out[38, 38] == 7 and out[15 + 18, 15] == 8
    back = dict(R.raster_shapes(out))
    assert set(back) == {3, 7, 8}


def test_pixels():
    ramp = np.arange(0, 65536, 64, dtype=np.uint16).reshape(32, 32)
    assert (R.stretch(ramp, 0, 100).min(), R.stretch(ramp, 0, 100).max()) == (0, 255)
    assert not R.stretch(np.full((8, 8), 9), 1, 99).any()
    tile = R.preprocess(np.tile(ramp, (2, 2)), 3, 5, 40)
    assert tile.shape == (40, 40) and tile.dtype == np.uint8
    with pytest.raises(ValueError, match="leaves"):
        R.preprocess(ramp, 10, 10, 40)
    rng = np.random.default_rng(0)
    assert 130 < R.grain(rng.normal(30000, 150, (200, 200))) < 155


def film(h=700, w=300, centre=350, half=200, seed=0):
    y = np.arange(h)
    bead = np.maximum(0, 1 - ((y - centre) / half) ** 2)
    return (30000 + 20000 * bead)[:, None] + np.random.default_rng(seed).normal(0, 150, (h, w))


def test_bead_geometry():
    b = R.bead(np.median(film(), axis=1))
    assert abs(b["centre"] - 350) < 4 and abs(b["half_width"] - 200 / np.sqrt(2)) < 6
    top = R.bead(np.median(film()[300:], axis=1))
    assert top["top"] is None and abs(top["centre"] - 50) < 15
    assert R.bead(np.full(700, 5.0)) is None
    assert R.bead(np.median(film()[330:370], axis=1)) is None
    short = np.zeros(700)
    short[340:360] = 1
    assert R.bead(short) is None


def test_longest_run():
    assert R.longest_run(np.array([1, 0, 1, 1, 0, 1, 1], bool)) == (2, 4)
    assert R.longest_run(np.zeros(4, bool)) == (0, 0)


def test_placement_and_compositing():
    target = np.median(film(), axis=1)
    blocked = np.zeros((700, 300), bool)
    row, col, score = R.place_by_profile(target[150:450], target, blocked, np.array([20, 40]))
    assert (row, col) == (150, 20) and score > 0.99
    blocked[:, 20] = True
    assert R.place_by_profile(target[150:450], target, blocked, np.array([20, 40]))[1] == 40
    host = film().astype(np.uint16)
    out = R.composite(host, np.full((10, 10), -0.1), 100, 50, 0.0)
    changed = out != host
    assert changed[100:110, 50:60].all() and changed.sum() == 100
    assert (R.composite(host, np.zeros((5, 5)), 0, 0, 0.0) == host).all()


def disc(h, w, cy, cx, r):
    yy, xx = np.mgrid[:h, :w]
    return (yy - cy) ** 2 + (xx - cx) ** 2 <= r * r


def test_extract_finds_the_dip():
    rng = np.random.default_rng(0)
    mask = disc(120, 160, 60, 80, 10)
    clean = 30000 + rng.normal(0, 50, (120, 160))
    hurt = np.where(disc(120, 160, 60, 80, 8), clean * 0.8, clean)
    got = R.extract(hurt, mask, 0.0, sign=-1)
    assert got["residual"].min() < -0.15 and (got["residual"] <= 0).all() and not got["residual"][~mask].any()
    assert R.extract(hurt, mask, 0.0, sign=1)["residual"].max() < 0.02
    deep = R.extract(hurt, mask, 0.0, sign=-1, blur=3.0, most=1.5)["residual"].min()
    assert deep <= R.extract(hurt, mask, 0.0, sign=-1, blur=3.0)["residual"].min()


def test_null_implant_changes_the_mask_only():
    mask = disc(90, 90, 45, 45, 12)
    host = np.where(disc(90, 90, 45, 45, 9), 20000, 30000).astype(np.uint16)
    out = R.null_implant(host, mask, 0.0, 3)
    assert (out[~mask] == host[~mask]).all() and abs(out[mask].mean() - 30000) < 200


def test_fill_is_smooth():
    yy, xx = np.mgrid[:40, :40]
    plane = 2.0 * xx + 3.0 * yy
    assert np.abs(R.fill_smooth(np.where(disc(40, 40, 20, 20, 8), 0, plane), disc(40, 40, 20, 20, 8)) - plane).max() < 1.0


def test_augmentation_bounds_and_warp():
    rng = np.random.default_rng(1)
    for _ in range(200):
        assert abs(R.augmentation(rng.random(6), True)["degrees"]) <= 10
    img = np.zeros((20, 30))
    img[5:15, 10:20] = 1
    p = {"sx": 1.0, "sy": 1.0, "degrees": 90.0, "amplitude": 2.0, "flip_x": False, "flip_y": False}
    out, pts = R.warp(img, np.array([[10, 5], [20, 15]], float), p)
    assert out.shape == (30, 20) and abs(out.sum() - 200) < 1e-6 and out.max() <= 2 + 1e-9
    assert (pts.min(0) >= 0).all() and (pts.max(0) <= [19, 29]).all()


def test_place_by_geometry():
    seam, blocked = np.ones((200, 300), bool), np.zeros((200, 300), bool)
    blocked[:, :50] = True
    spot = R.place_by_geometry(0.5, 11, 11, 100, 60, seam, blocked, np.arange(0, 280, 10), lambda r, c: -abs(c - 120), -1e9)
    assert spot[:2] == (125, 120)
    assert R.place_by_geometry(5, 11, 11, 100, 60, seam, blocked, np.arange(0, 280, 10), lambda r, c: 1.0, 0) is None
    assert abs(R.across_weld(np.array([[0, 155], [5, 165]]), 100, 60) - 1) < 1e-9
