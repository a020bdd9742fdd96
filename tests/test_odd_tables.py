"""Queries of the catalogue against their SQL, over small tables with odd values."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_catalog import plain
from tilewright.functions import raster
from tilewright.operators import films, selection, spatial
from tilewright.plans import catalog


def check(spark, name, folder, **tables):
    """The query's rows over ``tables`` (SQL by name), which must be those of its SQL; as many are returned."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    cur = con.execute(catalog.SQL[name])
    have = [d[0] for d in cur.description]
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in have) for r in df.collect()) == want
    return len(want)


def test_gaps_of_part_seconds(spark, tmp_path):
    times = ["00:00:00.4", "01:00:00.6", "02:00:01.5", "03:00:02.5", "04:00:02.499999", None]
    rows = ", ".join(f"({i}, 7, {'NULL' if t is None else f'TIMESTAMP \'2024-01-01 {t}\''})" for i, t in enumerate(times))
    assert check(spark, "gap_islands", tmp_path, events=f"SELECT event_id::BIGINT AS event_id, user_id::BIGINT AS user_id, ts FROM (VALUES {rows}) v(event_id, user_id, ts)") == 6


def _grids(spark):
    rng = random.Random(3)
    axis = lambda n: sorted({rng.randrange(900) for _ in range(n)})
    grid = spark.createDataFrame([(f, 100 + f, axis(7), axis(6)) for f in range(3)], "film long, side long, xs array<long>, ys array<long>")
    b = [(i % 4, f"s{i}", x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 300)) for i, (x, y) in enumerate((rng.randrange(-50, 1000), rng.randrange(-50, 1000)) for _ in range(120))]
    b = spark.createDataFrame([(*v[:2], *map(float, v[2:])) for v in b], "film long, shape string, x0 double, y0 double, x1 double, y1 double")
    return grid, grid.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys")).select("film", "x", "y", "side"), b


def test_grids_give_the_join_of_their_windows(spark):
    grid, windows, b = _grids(spark)
    rows = lambda df: sorted(map(tuple, df.select("film", "x", "y", "side", "shape", "x0", "y0", "x1", "y1").collect()))
    want = rows(spatial.window_boxes(windows, b))
    assert want and rows(spatial.grid_boxes(grid, b)) == want
    assert rows(spatial.grid_boxes(grid, b, cell=64)) == rows(spatial.grid_boxes(grid, b, cell=1000)) == want


def test_best_window_of_a_grid(spark):
    grid, windows, b = _grids(spark)
    points = b.select("film", "shape", F.col("x0").alias("px"), (F.col("y0") * 1.1).alias("py"))
    far = spark.createDataFrame([(0, "far", 300.25, 5e9), (1, "near", 0.0, 0.0)], "film long, shape string, px double, py double")  # all x as far, but for rounding
    rows = lambda df: sorted(map(tuple, df.collect()))
    points = points.unionByName(far)
    assert rows(spatial.best_grid_window(grid, points)) == rows(spatial.best_window(windows, points))


@pytest.mark.parametrize("name", ["tile_window_join", "best_window", "window_join_cells", "keep_rule_rect", "rule_sweep", "rule_sweep_classes"])
def test_windows_are_never_broadcast(spark, name):
    """The planner takes the windows of a grid for a row a film, so a plan without its join on films broadcasts millions of them."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan()
    for part in str(plan.toString()).split("\n"):
        assert "BroadcastHashJoin" not in part or "LeftSemi" in part or "LeftAnti" in part, part


def test_null_tiles_are_not_joined_by_tile(spark):
    """Windows were taken for few and those with an inserted point were broadcast by tile; all is now decided film by film."""
    plan = str(catalog.QUERIES["null_tile_selection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString())
    assert "Join" in plan and "Join [tile#" not in plan


def test_kinds_of_null_tiles(spark):
    t = [(f"t{i}", i % 3, 10 * (i % 7), 0, 10, [True, False, None][i % 5 % 3]) for i in range(40)]
    windows = spark.createDataFrame(t, "tile string, film long, x long, y long, side long, has_box boolean")
    points = lambda rows: spark.createDataFrame([(f, float(x), 5.0) for f, x in rows], "film long, px double, py double")
    centres, inserted = [(0, 5), (0, 25), (1, 0), (1, 69), (2, 31)], [(0, 29.5), (1, 70)]
    got = {r.tile: r.kind for r in selection.null_tiles(windows, points(centres), points(inserted), F.lit(1), 7).collect()}
    has = lambda w, p: any(w[1] == f and w[2] <= x < w[2] + w[4] for f, x in p)
    left = [w for w in t if has(w, centres) and not has(w, inserted)]
    drawn = sorted((hashlib.sha256(f"7|{w[0]}".encode()).hexdigest(), w[0]) for w in left if w[5] is False)
    held = {tile for _, tile in drawn[:1]}
    assert len(drawn) > 1 and got == {w[0]: "boxed" if w[5] else "holdout" if w[0] in held else "null" for w in left}


def test_pairs_near_each_other(spark):
    b = _grids(spark)[2].unionByName(spark.createDataFrame([(0, "s0", 5.0, 5.0, 9.0, 9.0)], "film long, shape string, x0 double, y0 double, x1 double, y1 double"))  # one shape of two boxes
    got = sorted(map(tuple, spatial.near_pairs(b, 6, 64).select("a.shape", "a.x0", "b.shape", "b.x0").collect()))
    rows = b.collect()
    near = lambda p, q: q.x0 <= p.x1 + 6 and q.x1 >= p.x0 - 6 and q.y0 <= p.y1 + 6 and q.y1 >= p.y0 - 6
    assert got == sorted((p.shape, p.x0, q.shape, q.x0) for p in rows for q in rows if p.film == q.film and p.shape < q.shape and near(p, q)) and got


def test_clashes_that_need_no_drawing(monkeypatch):
    def drawn(a, b, grow):
        low = np.minimum(a.min(0), b.min(0)) - grow - 2
        width, height = (np.maximum(a.max(0), b.max(0)) - low + grow + 3).astype(int)
        return bool((raster.dilate(raster.fill_polygon(a - low, height, width), grow) & raster.fill_polygon(b - low, height, width)).any())

    rng = np.random.default_rng(0)
    ring = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    boxes = [ring(*rng.integers(0, 30, 2), *rng.integers(0, 25, 2)) for _ in range(60)]
    shapes = boxes + [rng.integers(0, 40, (n, 2)).astype(float) for n in (1, 2, 3, 4, 4, 5, 6, 8) * 4] + [ring(0, 0, 9, 9)[[0, 0, 2, 2]], ring(0, 0, 9, 9)[[0, 2, 1, 3]]]
    for a in shapes:
        for b in shapes[::3]:
            assert raster.masks_clash(a, b, 3) == drawn(a, b, 3)
    monkeypatch.setattr(raster, "fill_polygon", None)  # pairs of rectangles were drawn, a millisecond each
    assert raster.masks_clash(ring(0, 0, 50, 9), ring(20, -20, 5, 60), 3) and not raster.masks_clash(ring(0, 0, 5, 5), ring(9, 0, 5, 5), 3)


@pytest.mark.parametrize("name, kernel, most", [("implants", "array_kernel", 20), ("local_contrasts", "local_contrasts", 100), ("raster_round_trip", "raster_round_trip", 360)])
def test_equal_rasters_are_worked_on_once(spark, tmp_path, monkeypatch, name, kernel, most):
    """800 parts of two sizes: the kernel got all of them."""
    seen, plain_kernel = [], getattr(films, kernel)
    monkeypatch.setattr(films, kernel, lambda rows, *a, **k: (seen.append(rows.count()), plain_kernel(rows, *a, **k))[1])
    parts = "SELECT i::BIGINT AS p_partkey, (3 + i // 400)::BIGINT AS p_size FROM range(800) t(i)"
    assert check(spark, name, tmp_path, part=parts) == (1600 if name == "raster_round_trip" else 800)
    assert seen == [most]


@pytest.mark.parametrize("name, kernel", [("local_contrasts", "local_contrasts"), ("raster_round_trip", "raster_round_trip")])
def test_rasters_are_spread(spark, tmp_path, monkeypatch, name, kernel):
    """All rasters were drawn in one task, since their keys are few bytes."""
    tasks, plain_kernel = [], getattr(films, kernel)
    monkeypatch.setattr(films, kernel, lambda rows, *a, **k: (tasks.append(rows.select(F.spark_partition_id()).distinct().count()), plain_kernel(rows, *a, **k))[1])
    parts = "SELECT i::BIGINT AS p_partkey, (3 + i // 400)::BIGINT AS p_size FROM range(800) t(i)"
    assert check(spark, name, tmp_path, part=parts) == (1600 if name == "raster_round_trip" else 800)
    assert tasks == [4]


def test_contrasts_of_mixed_films(spark):
    """Films of one size with equal polygons are worked on together; the others are not mixed up with them."""
    rng = random.Random(5)
    ring = lambda x, y: [(x, y), (x + 4.0, y), (x + 4.0, y + 3.0), (x, y + 3.0)]
    kinds = [(ring(5.0, 6.0), 20, 30), (ring(6.0, 6.0), 20, 30), (ring(5.0, 6.0), 30, 20), (ring(0.0, 0.0), 4, 5), ([(1.0, 1.0)], 12, 12)]
    made = [("f", str(i), *kinds[i * 7 % 5], [rng.gauss(1000, 9) for _ in range(kinds[i * 7 % 5][1] * kinds[i * 7 % 5][2])]) for i in range(60)]
    rows = spark.createDataFrame(made, "film string, shape string, points array<struct<x: double, y: double>>, height int, width int, pixels array<double>").coalesce(1)

    def plain(points, height, width, pixels):
        image, mask = np.reshape(pixels, (height, width)), raster.fill_polygon(np.array(points), height, width)
        yx, grown = np.argwhere(mask), lambda r: np.array([[(abs(yx - (y, x)).max(1) <= r).any() for x in range(width)] for y in range(height)])
        near = grown(3)
        around = grown(9) & ~near
        return (np.median(image[around]) - image[mask].mean()) / raster.grain(image, near) if around.any() else None

    got = {r.shape: r.cnr for r in films.local_contrasts(rows).collect()}
    want = {r[1]: plain(*r[2:]) for r in made}
    assert got.keys() == want.keys() and {v for k, v in want.items() if int(k) * 7 % 5 == 3} == {None}
    assert all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in want.items())


def test_equal_polygons_are_drawn_once(monkeypatch):
    """Each film of a batch had its polygon's masks drawn and grown anew."""
    drawn, fill = [], raster.fill_polygon
    images, square = np.random.default_rng(0).normal(1000, 9, (7, 20, 30)), np.array([(5, 6), (9, 6), (9, 9), (5, 9)], float)
    want = [raster.local_cnr(image, square) for image in images]
    monkeypatch.setattr(raster, "fill_polygon", lambda *a: (drawn.append(a), fill(*a))[1])
    assert raster.local_cnrs(images, square).tolist() == pytest.approx(want) and len(drawn) == 1
