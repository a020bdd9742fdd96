"""Operators on small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from tilewright.functions import arrays, geometry
from tilewright.functions import scalars as S
from tilewright.operators import audit, constraints, groups, rebalance, sampling, spatial, statistics, tiles, windows


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize(("h", "w"), [(717, 6943), (6943, 717)])
def test_side_rounds_half_to_even(spark, h, w):
    assert one(spark, tiles.tile_side(F.lit(h), F.lit(w), 0.5)) == 358


@pytest.mark.parametrize(
    ("length", "edge", "want"),
    [(1000, "flush", list(range(0, 901, 50))), (1030, "drop", list(range(0, 901, 50))), (1030, "flush", [*range(0, 901, 50), 930]), (80, "drop", [0]), (80, "flush", [0])],
)
def test_positions(spark, length, edge, want):
    side = F.lit(100).cast("long")
    assert one(spark, tiles.axis_positions(F.lit(length), side, tiles.stride_of(side, 0.5), edge)) == want


def test_unknown_edge():
    with pytest.raises(ValueError, match="edge"):
        tiles.axis_positions(F.lit(1), F.lit(1), F.lit(1), "wrap")


def test_ids(spark):
    rows = spark.createDataFrame([("A_DJ-RT-1__x0__y0__s10",), ("B_DJ-RT-1__x5__y0__s10",), ("DJ-RT-1__x5__y7__s10",), ("odd",)], "t string")
    got = [tuple(r.p) for r in rows.select(S.parse_tile_id(F.col("t")).alias("p")).collect()]
    assert [g[1] for g in got] == ["DJ-RT-1"] * 3 + ["odd"]
    assert got[2][2:] == (5, 7, 10) and got[3][2:] == (None, None, None)


def _sets(spark, lists):
    return spark.createDataFrame([(f"t{i}", sorted(x)) for i, x in enumerate(lists)], "tile string, classes array<int>")


def test_repeat_factors(spark):
    rows = rebalance.repeat_factors(_sets(spark, [{0}] * 50 + [{1}, {0, 1}] + [set()] * 48), 0.08)
    got = {tuple(r.classes): round(r.factor, 9) for r in rows.collect()}
    assert got == {(0,): 1.0, (1,): 2.0, (0, 1): 2.0, (): 1.0}


def test_equal_factors(spark):
    f = rebalance.equal_class_factors([((0,), 5), ((0, 3), 1), ((1,), 3), ((3,), 1)], 6)
    assert f == pytest.approx({0: 0.6, 1: 2, 3: 3})
    f = rebalance.equal_class_factors([((0,), 6), ((5,), 3), ((3,), 1)], 3)
    assert f == pytest.approx({0: 0.5, 3: 3, 5: 1})
    got = {tuple(r.classes): r.factor for r in rebalance.equal_factors(_sets(spark, [{0}] * 5 + [{0, 3}] + [{1}] * 3 + [{3}] + [set()] * 2)).collect()}
    assert got == pytest.approx({(0,): 0.6, (0, 3): 3, (1,): 2, (3,): 3, (): 1})
    assert rebalance.equal_factors(_sets(spark, [set(), set()])).select("factor").distinct().collect()[0].factor == 1


def test_equal_target(spark):
    counts = spark.createDataFrame([(0, 5), (1, 3), (2, 1)], "cls int, n int")
    assert [rebalance.equal_target(counts, h) for h in ("max", "second", "7")] == [5, 3, 7]
    with pytest.raises(ValueError, match="target"):
        rebalance.equal_target(counts, "0")


def test_stochastic_rounding(spark):
    rows = spark.range(20_000).withColumn("r", F.lit(2.25))
    got = sampling.with_copies(rows, F.col("r"), 0, "id")
    assert {r.copies for r in got.select("copies").distinct().collect()} == {2, 3}
    assert abs(got.agg(F.avg("copies")).first()[0] - 2.25) < 0.015
    assert got.repartition(7).orderBy("id").limit(50).collect() == got.orderBy("id").limit(50).collect()
    whole = sampling.with_copies(spark.createDataFrame([(1.0, 1), (3.0, 2)], "r double, id long"), F.col("r"), 0, "id")
    assert sorted(r.copies for r in whole.collect()) == [1, 3]


def test_spread(spark):
    table = lambda v: spark.createDataFrame([(i, 1, float(x)) for i, x in enumerate(v)], "cls int, tiles int, views double")
    assert rebalance.views_spread(table([3, 2])).first().spread == pytest.approx(1 / 3, abs=1e-6)
    assert rebalance.views_spread(table([2, 2])).first().spread == 0
    assert rebalance.views_spread(table([])).first().spread == 0


def test_signature_and_trim(spark):
    sig = lambda c: one(spark, S.class_signature(F.lit(c) if c else F.array().cast("array<int>")))
    assert [sig([]), sig([3, 3]), sig([3, 1])] == ["null", "3", "1+3"]
    rows = [("D", b, f"{b}{i}") for b, n in (("null", 10), ("3", 4), ("1+3", 3)) for i in range(n)]
    rows += [("E", b, f"{b}{i}") for b, n in (("null", 8), ("3", 5), ("1+3", 3)) for i in range(n)]
    kept = sampling.trim_arms(spark.createDataFrame(rows, "arm string, bucket string, id string"), "arm", "bucket", 1, "id").where("keep").drop("keep")
    want = {("D", "null"): 8, ("E", "null"): 8, ("D", "3"): 4, ("E", "3"): 4, ("D", "1+3"): 3, ("E", "1+3"): 3}
    assert {(r.arm, r.bucket): r["count"] for r in kept.groupBy("arm", "bucket").count().collect()} == want
    again = sampling.trim_arms(kept, "arm", "bucket", 1, "id")
    assert again.where("NOT keep").count() == 0
    constraints.enforce([constraints.arms_equal(again, "arm", "bucket", "keep", "arms")])


def test_greedy_fill_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"g{k}", i) for k in range(40) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g string, i int")
    got = {r.g: r.part for r in sampling.split_grouped(df, "g", 0.3, 5).collect()}
    import hashlib

    sizes = {g: sum(1 for x, _ in rows if x == g) for g, _ in rows}
    taken = 0
    for g in sorted(sizes, key=lambda g: hashlib.sha256(f"5|{g}".encode()).hexdigest()):
        assert got[g] == ("val" if taken < 0.3 * len(rows) else "train")
        taken += sizes[g] if got[g] == "val" else 0


def test_stratify():
    cases = [(f"E{i}", 1, ({0: 1} if i % 2 == 0 else {}) | ({3: 1} if i % 12 == 5 else {}), None) for i in range(120)]
    for seed in range(20):
        side = groups.stratify(cases, 30, seed)
        test = [g for g in cases if side[g[0]] == "test"]
        assert len(test) == 30
        for k in (0, 3):
            n = sum(g[2].get(k, 0) for g in cases)
            assert abs(sum(g[2].get(k, 0) for g in test) - n * 30 / 120) <= 1
    forced = [("V1+V2", 2, {0: 2}, None), ("V3", 1, {0: 1}, "val"), ("V4", 1, {}, None)]
    assert all(groups.stratify(forced, 1, s)["V3"] == "val" for s in range(5))
    for n in (0, 4):
        with pytest.raises(ValueError, match="n_test"):
            groups.stratify(forced, n)


def test_linked_groups(spark):
    members = spark.createDataFrame([("V1", "val"), ("V2", "val"), ("V3", "val"), ("T1", "train"), ("T9", "train")], "exposure string, part string")
    links = spark.createDataFrame([("V1", "V2"), ("V3", "T1")], "a string, b string")
    got = {(r.n_members, r.forced) for r in groups.linked_groups(members, links, "exposure", "part").collect()}
    assert got == {(2, None), (2, "val")}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (60, 60)], "a long, b long")
    got = {r.id: r.root for r in groups.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and got[50] == got[40] == 40 and 60 not in got


def test_crop_rect(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))))
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    rect = lambda seam, label: tuple(one(spark, geometry.crop_rect(seam, label, F.lit(100), F.lit(400), 0.1)))
    assert rect(box(50, 40, 350, 60), none) == (48, 38, 352, 62, "contained")
    assert rect(box(50, 40, 350, 60), box(100, 80, 120, 90)) == (48, 38, 352, 92, "extended")
    assert rect(none, none) == (None, None, None, None, "no_seam")


def test_geometry(spark):
    points = lambda p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    square = points([(10, 10), (30, 10), (30, 30), (10, 30)])
    assert one(spark, geometry.polygon_area(square)) == 400
    assert one(spark, geometry.polygon_area(points([(0, 0), (4, 5)]))) == 20
    assert [one(spark, geometry.point_in_polygon(F.lit(float(x)), F.lit(float(y)), square)) for x, y in ((20, 20), (10, 15), (31, 15), (30, 30))] == [1, 0, -1, 0]
    turned = one(spark, geometry.rotate_quarter(square, 100, 50, 4))
    assert [(p.x, p.y) for p in turned] == [(10, 10), (30, 10), (30, 30), (10, 30)]
    once = one(spark, geometry.rotate_quarter(square, 100, 50, 1))
    assert (once[0].x, once[0].y) == (10, 89)
    assert one(spark, geometry.yolo_segment(F.lit(3), points([(0, 0), (50, 0), (50, 200)]), F.lit(100))) == "3 0.000000 0.000000 0.500000 0.000000 0.500000 1.000000"
    assert len(one(spark, geometry.rectangle_corners(points([(0, 0), (4, 5)])))) == 4


def test_cells_give_the_plain_join(spark):
    rng = random.Random(1)
    w = spark.createDataFrame([("f", rng.randrange(900), rng.randrange(900), 100) for _ in range(80)], "film string, x long, y long, side long").distinct()
    b = [(x, y, x + rng.randrange(1, 300), y + rng.randrange(1, 300)) for x, y in ((rng.randrange(900), rng.randrange(900)) for _ in range(80))]
    b = spark.createDataFrame([("f", f"s{i}", *map(float, v)) for i, v in enumerate(b)], "film string, shape string, x0 double, y0 double, x1 double, y1 double")
    rows = lambda cell: sorted((r.x, r.y, r.shape) for r in spatial.window_boxes(w, b, cell=cell).collect())
    assert rows(None) == rows(64) == rows(1000) and rows(64)


def test_contrast_stretch(spark):
    ramp = F.transform(F.sequence(F.lit(0), F.lit(65472), F.lit(64)), lambda v: v.cast("double"))
    full = one(spark, arrays.contrast_stretch(ramp, 0, 100))
    assert (min(full), max(full)) == (0, 255)
    tight = one(spark, arrays.contrast_stretch(ramp, 10, 90))
    assert sum(v == 0 for v in tight) > 0.05 * len(tight) and sum(v == 255 for v in tight) > 0.05 * len(tight)
    assert set(one(spark, arrays.contrast_stretch(F.array_repeat(F.lit(7.0), 64), 1, 99))) == {0}


def test_additive_space(spark):
    grey = [0.0, 500.0, 1000.0, 30000.0, 65535.0]
    back = one(spark, arrays.from_additive(arrays.to_additive(F.lit(grey), 100.0), 100.0))
    assert back[1:] == [500, 1000, 30000, 65535] and back[0] == 101
    assert one(spark, arrays.blend(F.lit([10.0, 20.0]), F.lit([30.0, 40.0]), F.lit([0.0, 0.5]))) == [10, 30]


def test_gcd_and_runs(spark):
    rows = spark.createDataFrame([("a", v) for v in (10, 25, 40, 100)] + [("b", 7), ("b", 7)], "g string, v long")
    assert {r.g: r.step for r in statistics.gcd_step(rows, ["g"], "v").collect()} == {"a": 15, "b": 0}
    runs = spark.createDataFrame([(i, f) for i, f in enumerate([1, 0, 1, 1, 0, 1, 1])], "i int, f int").withColumn("g", F.lit(1))
    assert tuple(statistics.longest_run(runs, ["g"], ["i"], F.col("f") == 1).first())[1:] == (2, 2)
    assert tuple(statistics.longest_run(runs, ["g"], ["i"], F.col("f") == 9).first())[1:] == (0, 0)


def test_bootstrap_covers_the_slope(spark):
    rng = random.Random(5)
    rows = [(g, 2.0 * a + 0.5 * b + g + rng.gauss(0, 1), a, b) for g in range(60) for a, b in ((rng.random() * 9, rng.random() * 9) for _ in range(8))]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double")
    ci = statistics.bootstrap_ols(df, "g", "y", "a", "b", draws=100).first()
    assert ci.low < 2.0 < ci.high and ci.high - ci.low < 0.5


def test_audit_cases(spark):
    checks = audit.label_problems(F.lit(9), F.lit(0.5), F.lit(1.2), F.lit(0.1), F.lit(0.0), 6)
    assert one(spark, checks) == ["class", "range", "empty"]
    rows = spark.createDataFrame([("c1", "a", [("u", ["x"])]), ("c1", "b", [("u", [])]), ("c2", "c", None), ("c3", "d", None)], "customer_id string, _id string, use_cases array<struct<use_case:string,annotations:array<string>>>")
    assert sorted(r["_id"] for r in audit.catalogue_filter(rows, ["c1", "c2"], "u", ["d"]).collect()) == ["a", "d"]
    assert windows.coverage_pick([("a", {1}), ("b", {1}), ("c", set()), ("d", {1}), ("e", {1}), ("f", {2})]) == ["a", "b", "c", "d", "f"]
    summed = audit.merged_counts(spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},), (None,)], "m map<string,long>"), "m")
    assert {r.key: r.n for r in summed.collect()} == {"a": 4, "b": 2}


def test_constraints(spark):
    a, b = spark.range(5), spark.range(3, 8)
    got = {r.name: r.violations for r in constraints.report([constraints.all_in(a, b, "id", "in"), constraints.disjoint(a, b, "id", "apart"), constraints.same_rows(a, a, "same"), constraints.grew_by(a, a.union(b), b, "grew")]).collect()}
    assert got == {"in": 3, "apart": 2, "same": 0, "grew": 0}
    with pytest.raises(constraints.Broken, match="apart: 2"):
        constraints.enforce([constraints.disjoint(a, b, "id", "apart")])
    part = spark.createDataFrame([("a", "val"), ("b", "val"), ("c", "train")], "id string, part string")
    want = spark.createDataFrame([("val", 2), ("train", 2)], "part string, n long")
    assert constraints.same_count(part, want, "part", "n").first().violations == 1
    pores = spark.createDataFrame([("s", i % 4 == 0) for i in range(24)] + [("t", True)] * 30, "src string, darker boolean")
    assert constraints.polarity_gate(pores, "src", "darker").first().violations == 1
