"""Kernels for implants and checks, against plain loops."""

import numpy as np
import pytest

from tilewright.functions import raster as R
from tilewright.operators import spatial, statistics

SQUARE = np.array([[20, 20], [27, 20], [27, 27], [20, 27]], float)


def test_dilate_equals_a_loop():
    rng = np.random.default_rng(0)
    for r in (0, 1, 3):
        m = rng.random((17, 23)) < 0.05
        want = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m)):
            want[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = True
        assert (R.dilate(m, r) == want).all()


def test_contrast_is_measured_in_grains():
    rng = np.random.default_rng(1)
    image = 1000 + rng.normal(0, 10, (120, 130))
    image[20:28, 20:28] -= 50
    grain = R.grain(image[40:, 40:])
    assert abs(R.local_cnr(image, SQUARE) - 50 / grain) < 1.0
    back, dip = R.pore_dip(image, SQUARE)
    assert abs(back - 1000) < 5 and abs(dip - 50) < 6
    others = np.zeros(image.shape, bool)
    others[:60, :60] = True
    assert R.pore_dip(image, SQUARE, others) is None  # no ring is left
    assert R.pore_dip(-image, SQUARE) is None and R.pore_dip(2000 - image, SQUARE) is None


def test_keep_out_and_clashes():
    mask = R.keep_out(60, 50, [SQUARE], 3, [(40, 50, 20)])
    assert mask[17:31, 17:31].all() and mask[50:, 40:].all() and mask.sum() == 14 * 14 + 100
    ell = np.array([[0, 0], [30, 0], [30, 4], [4, 4], [4, 30], [0, 30]], float)
    assert not R.masks_clash(ell, SQUARE, 3) and R.masks_clash(ell, SQUARE - 8, 9)  # the boxes overlap in both cases


def test_cuts_of_turned_films():
    film = np.arange(60).reshape(6, 10)
    for k in range(4):
        crop = np.rot90(film, k)[1:4, 2:5]
        assert R.compare_cut(film, k, 2, 1, crop) == "exact"
        assert R.compare_cut(film, k, 2, 1, crop + (np.arange(9).reshape(3, 3) < 2)) == "2 px differ"
    assert R.compare_cut(film, 0, 8, 0, np.zeros((3, 3))).startswith("bad offset")
    with pytest.raises(ValueError, match="leaves"):
        R.cut(film, 1, -1, 0, 2, 2)


def test_rederived_polygons():
    got = R.rederived(SQUARE, 10, 10, 40)
    assert got["iou"] == 1.0 and got["deviation"] == 0 and got["pieces"] == 1
    fork = np.array([[0, 0], [30, 0], [30, 20], [20, 20], [20, 5], [10, 5], [10, 20], [0, 20]], float)
    cut = R.rederived(fork, 0, 10, 40)  # the window holds the two prongs only
    assert cut["pieces"] == 2 and cut["iou"] > 0.9
    assert R.rederived(SQUARE, 26, 26, 300) is None


def test_turned_shapes_are_found(spark):
    points = "array<struct<x:double,y:double>>"
    ell = [(10.0, 20.0), (15.0, 20.0), (15.0, 33.0), (9.0, 30.0)]
    turned = [(y - 2, 99 - x - 1) for x, y in ell]  # a quarter turn of an image 100 wide, then moved by (-2, -1)
    right, left = spark.createDataFrame([(1, ell)], f"id int, points {points}"), spark.createDataFrame([(7, turned)], f"id int, points {points}")
    r = spatial.translation_matches(left, right, rotations=(0, 1, 2, 3), width=100.0, height=80.0).collect()
    assert [tuple(x) for x in r] == [(7, 1, 1, 2.0, 1.0)]
    assert spatial.translation_matches(left, right).count() == 0


def test_groups_are_drawn_with_replacement(spark):
    df = spark.createDataFrame([(g, float(g * a + a * a), float(a), float(a % 3)) for g in range(7) for a in range(5)], "g int, y double, a double, b double")
    draws = statistics.bootstrap_draws(df, "g", "y", "a", "b", draws=30).collect()
    assert len(draws) == 30 and {r.n for r in draws} == {35}  # always seven groups of five rows
