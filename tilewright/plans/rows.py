"""Catalogue queries of the relational operators on labels, splits, merges and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import geometry, labels
from tilewright.operators import audit, constraints, groups, sampling, selection
from tilewright.plans.inputs import BOXES, boxes, table
from tilewright.plans.registry import query

_LINE = "printf('%d %d.%d7 0.%d', p_partkey % 6, p_size, p_partkey, p_size)"


@query(f"""WITH l AS (SELECT p_partkey AS tile, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE {_LINE} END AS t FROM part)
SELECT tile, CASE WHEN t = '' OR tile % 4 > 1 THEN 0 WHEN tile % 4 = 0 THEN 1 ELSE 2 END AS added,
  CASE WHEN t = '' THEN chr(10) WHEN tile % 4 > 1 THEN t || chr(10) ELSE regexp_replace(t, ' ([0-9.]+) ([0-9.]+)', CASE WHEN tile % 4 = 0 THEN ' \\10 \\20' ELSE ' \\100 \\200' END) || chr(10) END AS text FROM l""")
def unique_labels(spark, sf):
    """The label texts of a quarter of the tiles are taken, those of another quarter with one zero appended too."""
    line = F.format_string("%d %d.%d7 0.%d", F.col("p_partkey") % 6, F.col("p_size"), F.col("p_partkey"), F.col("p_size"))
    text = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(line, F.lit("\n")))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("tile"), text.alias("label_text"))
    used = rows.where("tile % 4 < 2 AND label_text <> ''").select("tile", F.explode(labels.label_variants(F.col("label_text"))).alias("v")).where("v.added <= tile % 4")
    return labels.unique_labels(rows, used.select(F.sha2("v.text", 256).alias("digest")))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN concat('H', p_size, '-', p_partkey % 3) END AS host FROM part")
def hosts_of_films(spark, sf):
    film = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("S-"), F.col("p_size"))).otherwise(F.concat(F.lit("S"), F.col("p_partkey"), F.lit("-v3-H"), F.col("p_size"), F.lit("-"), F.col("p_partkey") % 3))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), labels.host_of(film).alias("host"))


@query(
    """SELECT user_id, name, epoch FROM (SELECT user_id, epoch, name, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, name) AS k FROM
  (SELECT user_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE (event_id % 40)::INT END AS epoch, CASE WHEN event_id % 7 = 0 THEN concat('best-', event_id, '.pt') ELSE concat('best-epoch=', event_id % 40, '-', event_id, '.pt') END AS name FROM events WHERE event_id % 2 = 0)) WHERE k = 1"""
)
def latest_checkpoint(spark, sf):
    e = F.col("event_id")
    stem = F.when(e % 2 == 0, "best").otherwise("last")
    name = F.when(e % 7 == 0, F.concat(stem, F.lit("-"), e, F.lit(".pt"))).otherwise(F.concat(stem, F.lit("-epoch="), e % 40, F.lit("-"), e, F.lit(".pt")))
    return labels.latest_checkpoint(table(spark, sf, "events").select("user_id", name.alias("name")), "user_id", "name", "best")


@query(
    """SELECT 'child has no val exposure' AS name, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey % 20 = 0) AS violations
UNION ALL SELECT 'ids differ', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0)
UNION ALL SELECT 'images differ', (SELECT count(DISTINCT o_totalprice) FROM orders WHERE o_orderkey % 3 = 1 AND o_totalprice IN (SELECT o_totalprice FROM orders WHERE o_orderkey % 5 = 0))
UNION ALL SELECT 'test tiles are there', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0)
UNION ALL SELECT 'no val tile', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 20 = 0)
UNION ALL SELECT 'no train tile', (SELECT count(*) FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 20 = 1)
UNION ALL SELECT 'boxes as reported', (SELECT count(*) FROM (SELECT l_returnflag FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY 1 HAVING count(*) <> 100))
UNION ALL SELECT 'null tiles as selected', (SELECT (count(*) <> 7)::INT FROM orders WHERE o_orderkey % 11 = 0)
UNION ALL SELECT 'rows as reported', 0"""
)
def merge_report(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_custkey").alias("exposure"), F.col("o_totalprice").alias("digest"))
    parent, child, val = o.where("tile_id % 5 = 0"), o.where("tile_id % 3 = 1"), o.where("exposure % 20 = 0")
    split = o.where("exposure % 20 < 2").select("tile_id", F.when(F.col("exposure") % 20 == 0, "val").otherwise("train").alias("part"))
    test = o.where("tile_id % 7 = 0").select("tile_id")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"), F.col("l_returnflag").alias("cls"))  # noqa: E741
    expected = l.select("cls").distinct().withColumn("n", F.lit(100))
    texts = o.select(F.when(F.col("tile_id") % 11 == 0, " \n").otherwise("0 0.5 0.5 0.1 0.1\n").alias("label_text"))
    return constraints.report(
        [
            *selection.merge_checks(parent, child, val),
            *selection.standalone_test_checks(parent, test, split, l, expected),
            constraints.empty_labels(texts, 10, 3),
            constraints.rows_as_reported(l, l.groupBy("cls").agg(F.count("*").alias("n"))),
        ]
    )


@query("SELECT o_orderkey AS tile_id, 'train' AS part FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey + 1000000000, 'train' FROM orders WHERE o_orderkey % 2 = 1")
def merged_datasets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_custkey").alias("exposure"), F.sha1(F.col("o_orderkey").cast("string")).alias("digest"))
    parent, child = o.where("tile_id % 2 = 0").withColumn("part", F.lit("train")), o.where("tile_id % 2 = 1").withColumn("tile_id", F.col("tile_id") + 1000000000)
    return selection.merged(parent, child, o.where("exposure < 0")).select("tile_id", "part")


@query("SELECT o_orderkey AS tile_id, CASE WHEN o_orderkey % 2 = 1 THEN concat('1 0.', o_orderkey, '70', chr(10)) ELSE concat('1 0.', o_orderkey, '7', chr(10)) END AS label_text FROM orders")
def merged_labels(spark, sf):
    """The child's labels are all taken as they are."""
    text = F.concat(F.lit("1 0."), F.col("o_orderkey"), F.lit("7\n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_custkey").alias("exposure"), F.sha1(F.col("o_orderkey").cast("string")).alias("digest"), text.alias("label_text"))
    parent, child = o.where("tile_id % 2 = 0").withColumn("part", F.lit("train")), o.where("tile_id % 2 = 1")
    return selection.merged(parent, child, o.where("exposure < 0"), o.select(F.sha2("label_text", 256).alias("digest"))).select("tile_id", "label_text")


@query("SELECT arm, event_type, count(*) AS before, count(*) FILTER (keep) AS after, count(*) FILTER (NOT keep) AS dropped FROM (SELECT event_id % 2 AS arm, event_type, event_id % 3 > 0 AS keep FROM events) GROUP BY GROUPING SETS ((arm, event_type), (arm))")
def trim_report(spark, sf):
    rows = table(spark, sf, "events").select((F.col("event_id") % 2).alias("arm"), "event_type", (F.col("event_id") % 3 > 0).alias("keep"))
    return sampling.trim_report(rows, "arm", "event_type")


@query("SELECT o_orderkey AS tile_id, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 0 THEN 'test' WHEN o_orderkey % 4 = 0 THEN 'val' ELSE 'train' END AS part FROM orders")
def carve_test(spark, sf):
    o = table(spark, sf, "orders")
    split = o.select(F.col("o_orderkey").alias("tile_id"), F.when(F.col("o_orderkey") % 4 == 0, "val").otherwise("train").alias("part"))
    return selection.carve_test(split, o.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("tile_id")))


@query("SELECT o_orderkey AS tile_id, 'test' AS part FROM orders WHERE o_custkey % 3 = 0")
def standalone_test(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.col("o_custkey").alias("c"), F.lit("val").alias("part"))
    return selection.standalone_test(o.drop("c"), o.where("c % 3 = 0")).select("tile_id", "part")


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'failed' ELSE 'done' END AS state FROM events")
def retry_rounds(spark, sf):
    """An attempt succeeds in the round that its id names, or never."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"))
    done, failed = selection.retry_rounds(rows, lambda p, k: p.withColumn("ok", F.col("id") % 4 == k), "id", rounds=3)
    return done.select("id", F.lit("done").alias("state")).unionByName(failed.select("id", F.lit("failed").alias("state")))


@query("WITH b AS (SELECT l_orderkey AS tile, l_linenumber - 1 AS cls, l_quantity AS w, l_quantity / 2 AS h FROM lineitem) SELECT cls, tile FROM b WHERE w >= 12 AND h >= 12 GROUP BY ALL UNION SELECT DISTINCT cls, tile FROM b WHERE cls NOT IN (SELECT cls FROM b WHERE w >= 12 AND h >= 12)")
def clear_examples(spark, sf):
    """Of every class the tiles with a box that is large enough to show."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    box = F.struct((F.col("l_linenumber") - 1).cast("int").alias("class_id"), F.col("l_quantity").alias("w"), (F.col("l_quantity") / 2).alias("h"))
    sets = l.groupBy(F.col("l_orderkey").alias("tile")).agg(F.collect_list(box).alias("boxes"))
    out = None
    for k in range(7):  # the line numbers 1 to 7 are the classes
        one = selection.clear_examples(sets, k).select(F.lit(k).cast("long").alias("cls"), "tile")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey FROM (SELECT p_partkey, p_retailprice AS v, median(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) WHERE v >= m")
def visible_sources(spark, sf):
    return selection.at_least_median(table(spark, sf, "part"), "p_brand", "p_retailprice").select("p_partkey")


@query(
    """SELECT coalesce(a.film, b.film) AS film, coalesce(n, 0) + coalesce(m, 0) AS n_shapes, coalesce(n, 0) AS n_host FROM (SELECT l_partkey AS film, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS film, count(*) AS m FROM lineitem WHERE l_linenumber > 5 GROUP BY 1) b ON a.film = b.film"""
)
def union_of_shapes(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("film"), "l_linenumber")  # noqa: E741
    sets = lambda rows, kind: rows.groupBy("film").agg(F.collect_list(F.lit(kind)).alias("shapes"))
    out = selection.union_of_shapes(sets(l.where("l_linenumber < 4"), "host"), sets(l.where("l_linenumber > 5"), "new"))
    return out.select("film", F.size("shapes").cast("long").alias("n_shapes"), F.size(F.filter("shapes", lambda s: s == "host")).cast("long").alias("n_host"))


@query("SELECT o_orderkey AS tile_id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def not_rendered(spark, sf):
    """A third of the tiles was rendered before; of a fifth of these the bytes have changed."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), F.sha1("o_orderstatus").alias("digest"))
    manifest = o.where("tile_id % 3 = 0").withColumn("digest", F.when(F.col("tile_id") % 5 == 0, "old").otherwise(F.col("digest")))
    return selection.not_rendered(o, manifest).select("tile_id")


@query(
    """WITH g AS (SELECT min(doc_id) OVER (PARTITION BY text) AS root, doc_id FROM documents WHERE text IS NOT NULL) SELECT root, count(*) AS n_members, CASE WHEN count(*) FILTER (doc_id % 10 <> 0) > 0 THEN 'val' END AS forced FROM g GROUP BY root HAVING count(*) FILTER (doc_id % 10 = 0) > 0"""
)
def linked_groups(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("d"))
    first = docs.groupBy("d").agg(F.min("doc_id").alias("a"))
    links = docs.join(first, "d").where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    members = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("part"))
    return groups.linked_groups(members, links, "doc_id", "part")


_SEAM = "px BETWEEN 40 AND 420 AND py BETWEEN 30 AND 330 AND NOT (px BETWEEN 200 AND 230 AND py BETWEEN 20 AND 90)"


@query(f"""WITH b AS (SELECT DISTINCT film, shape, cls, x0, y0, x1, y1 FROM ({BOXES})),
n AS (SELECT DISTINCT a.film, a.shape FROM b a JOIN b c ON a.film = c.film AND a.shape <> c.shape AND c.x0 <= a.x1 + 4 AND c.x1 >= a.x0 - 4 AND c.y0 <= a.y1 + 4 AND c.y1 >= a.y0 - 4)
SELECT DISTINCT film, shape FROM (SELECT *, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM b) WHERE cls IN ('AF', 'NO') AND (x1 - x0) * (y1 - y0) >= 300 AND x0 >= 0.75 AND y0 >= 0.75 AND x1 <= 598.25 AND y1 <= 498.25
  AND greatest(x1 - x0, y1 - y0) <= 50 AND (cls <> 'NO' OR x1 - x0 >= y1 - y0) AND {_SEAM} AND (film, shape) NOT IN (SELECT film, shape FROM n)""")
def source_instances(spark, sf):
    """Boxes as rectangles on films with a large seam and a small one that crosses it."""
    b = boxes(spark, sf).distinct()
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    points = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    shapes = b.select("film", "shape", F.when(F.col("cls") == "AF", 0).when(F.col("cls") == "NO", 2).otherwise(5).alias("class_id"), F.lit("x").alias("label"), points.alias("points"), F.lit(500).alias("height"), F.lit(600).alias("width"))
    at = lambda x0, y0, x1, y1: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    films = b.select("film").distinct()
    seams = films.select("film", at(40, 30, 420, 330).alias("points")).unionByName(films.select("film", at(200, 20, 230, 90).alias("points"))).withColumn("area", geometry.polygon_area(F.col("points")))
    return selection.source_instances(shapes, seams, [0, 2], [2], 300, 50, 4)


@query(
    """SELECT event_type AS part, count(*) AS tiles, count(*) FILTER (value < 16) AS small, count(*) FILTER (value > 64) AS large, count(*) FILTER (event_id % 50 < 2) AS flat, count(*) FILTER (event_id % 10 > 3) AS saturated, count(*) FILTER (event_id % 3 > 0) AS positive, sum(event_id % 3)::BIGINT AS boxes, max(event_id % 3) AS most_boxes FROM events GROUP BY 1"""
)
def tile_bands(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("event_type").alias("part"), (F.col("value") * 10).alias("side"), (e % 50).alias("std"), (e % 10 / 10.0).alias("saturated"), (e % 3).alias("n_boxes"))
    return audit.tile_bands(rows)


@query("SELECT l_returnflag AS cls, count(*) AS boxes, count(*) FILTER (l_quantity > 45) AS cut, round(count(*) FILTER (l_quantity > 45) / count(*), 6) AS share FROM lineitem GROUP BY 1")
def cut_shares(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("cls"), (F.col("l_quantity") > 45).alias("cut"))
    return audit.cut_shares(rows, "cls", "cut")


def _points(*corners):
    return F.array(*(F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.cast("double").alias("x"), F.lit(y).cast("double").alias("y") if not hasattr(y, "alias") else y.cast("double").alias("y")) for x, y in corners))


_S = "(2 * (p_partkey % 200) + 25)::DOUBLE"
_F6 = "printf('%.6f', {})"
_UNIT = "printf('%.6f', least(greatest({} / s, 0.0), 1.0))"


@query(f"""SELECT id, printf('%d ', id % 6) || concat_ws(' ', {_F6.format('(id % 11 + id % 11 + size) / 2.0::DOUBLE / s')}, {_F6.format('(id % 7 + id % 7 + 2.0::DOUBLE * size) / 2.0::DOUBLE / s')}, {_F6.format('size::DOUBLE / s')}, {_F6.format('2.0::DOUBLE * size / s')}) AS box,
  printf('%d ', id % 6) || concat_ws(' ', {_UNIT.format('(id % 11)::DOUBLE')}, {_UNIT.format('(id % 7)::DOUBLE')}, {_UNIT.format('(id % 11 + size)::DOUBLE')}, {_UNIT.format('(id % 7)::DOUBLE')}, {_UNIT.format('(-1.0)::DOUBLE')}, {_UNIT.format('(id % 7 + 40 * size)::DOUBLE')}) AS segment
  FROM (SELECT p_partkey AS id, p_size AS size, {_S} AS s FROM part)""")
def label_lines(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    side = 2 * (k % 200) + 25
    x, y = (k % 11).cast("double"), (k % 7).cast("double")
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + n).alias("x1"), (y + 2 * n).alias("y1"))
    points = _points((x, y), (x + n, y), (F.lit(-1.0), y + 40 * n))
    return table(spark, sf, "part").select(k.alias("id"), geometry.yolo_box(k % 6, box, side).alias("box"), geometry.yolo_segment(k % 6, points, side).alias("segment"))


@query(
    """SELECT id, x0, y0, x1, y1, CASE WHEN sx0 IS NULL THEN 'no_seam' WHEN lx0 IS NOT NULL AND (x0 <> px0 OR y0 <> py0 OR x1 <> px1 OR y1 <> py1) THEN 'extended' ELSE 'contained' END AS flag FROM (
  SELECT *, CASE WHEN sx0 IS NULL THEN NULL WHEN lx0 IS NULL THEN px0 ELSE least(px0, greatest(lx0 - pad, 0)) END::BIGINT AS x0, CASE WHEN sx0 IS NULL THEN NULL WHEN lx0 IS NULL THEN py0 ELSE least(py0, greatest(ly0 - pad, 0)) END::BIGINT AS y0,
    CASE WHEN sx0 IS NULL THEN NULL WHEN lx0 IS NULL THEN px1 ELSE greatest(px1, least(lx1 + pad, 300)) END::BIGINT AS x1, CASE WHEN sx0 IS NULL THEN NULL WHEN lx0 IS NULL THEN py1 ELSE greatest(py1, least(ly1 + pad, 200)) END::BIGINT AS y1 FROM (
  SELECT *, greatest(sx0 - pad, 0) AS px0, greatest(sy0 - pad, 0) AS py0, least(sx1 + pad, 300) AS px1, least(sy1 + pad, 200) AS py1 FROM (
  SELECT *, round_even(0.25 * least(sx1 - sx0, sy1 - sy0), 0) AS pad FROM (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 50)::DOUBLE END AS sx0, 20.0::DOUBLE AS sy0, (p_partkey % 50 + 3 * p_size)::DOUBLE AS sx1, (20 + 2 * p_size)::DOUBLE AS sy1,
    CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 40)::DOUBLE END AS lx0, (10 + p_partkey % 30)::DOUBLE AS ly0, (p_partkey % 40 + 60)::DOUBLE AS lx1, (50 + p_partkey % 90)::DOUBLE AS ly1 FROM part))))"""
)
def crop_rects(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    box = lambda *v: F.struct(*(x.cast("double").alias(c) for x, c in zip(v, ("x0", "y0", "x1", "y1"))))
    seam = F.when(k % 7 > 0, box(k % 50, F.lit(20), k % 50 + 3 * n, 20 + 2 * n))
    label = F.when(k % 3 > 0, box(k % 40, 10 + k % 30, k % 40 + 60, 50 + k % 90))
    rect = geometry.crop_rect(seam, label, F.lit(200.0), F.lit(300.0), 0.25)
    return table(spark, sf, "part").select(k.alias("id"), rect.alias("r")).select("id", "r.*")
