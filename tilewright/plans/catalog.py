"""Every operator as a query over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions import arrays, geometry
from tilewright.functions import scalars as S
from tilewright.operators import audit, constraints, groups, rebalance, sampling, selection, spatial, statistics, tiles, windows
from tilewright.operators import films as film_ops
from tilewright.plans import exchange, kernels, rows  # noqa: F401  they register their queries
from tilewright.plans.inputs import BOXES, FILMS, FRACTION, GRID, OVERLAP, axis, boxes, films, table, tiles_sql
from tilewright.plans.registry import QUERIES, SQL, query  # noqa: F401

# tiles


@query(f"SELECT film, side, y, x FROM ({tiles_sql('flush')})")
def tile_positions_flush(spark, sf):
    return tiles.enumerate_tiles(films(spark, sf), FRACTION, OVERLAP, "flush").select("film", "side", "y", "x")


@query(f"SELECT film, side, y, x FROM ({tiles_sql('drop')})")
def tile_positions_drop(spark, sf):
    return tiles.enumerate_tiles(films(spark, sf), FRACTION, OVERLAP, "drop").select("film", "side", "y", "x")


def _count_sql(edge):
    return f"SELECT '{edge}' AS edge, count(*) AS films, sum(len({axis('width', edge)}) * len({axis('height', edge)}))::BIGINT AS n_tiles FROM ({GRID})"


@query(f"{_count_sql('drop')} UNION ALL {_count_sql('flush')}")
def tile_count_by_edge(spark, sf):
    one = lambda edge: tiles.tile_counts(films(spark, sf), FRACTION, OVERLAP, edge).agg(F.count("*").alias("films"), F.sum("n_tiles").alias("n_tiles")).select(F.lit(edge).alias("edge"), "films", "n_tiles")
    return one("drop").unionByName(one("flush"))


def _rounded_sql(x, how):
    return f"CASE {how} WHEN 'floor' THEN floor({x}) WHEN 'ceil' THEN ceil({x}) ELSE round_even({x}, 0) END::BIGINT"


def _axis_sql(n):
    over = f"({n} - side)"
    return f"""CASE WHEN {n} <= side THEN 1 WHEN border = 'inclusive' THEN {over} // stride + 1 WHEN border = 'exclusive' THEN greatest(ceil({over} / stride), 1)
    WHEN border = 'flush' THEN {over} // stride + 1 + (CASE WHEN {over} % stride > 0 THEN 1 ELSE 0 END) ELSE ceil({n} / stride) END::BIGINT"""


_SWEEP = f"""WITH r AS (SELECT a AS side_rule, b AS stride_rule, c AS border FROM (SELECT unnest(['floor', 'half_even', 'ceil']) AS a), (SELECT unnest(['floor', 'half_even', 'ceil']) AS b), (SELECT unnest(['inclusive', 'exclusive', 'flush', 'pad']) AS c)),
s AS (SELECT *, greatest(1, {_rounded_sql(f'(least(height, width) * {FRACTION})', 'side_rule')}) AS side FROM ({FILMS}), r),
t AS (SELECT *, greatest(1, {_rounded_sql(f'(side * {1 - OVERLAP})', 'stride_rule')}) AS stride FROM s)
SELECT side_rule, stride_rule, border, sum(({_axis_sql('width')}) * ({_axis_sql('height')}))::BIGINT AS n_tiles FROM t GROUP BY ALL"""


@query(_SWEEP)
def grid_sweep(spark, sf):
    return tiles.grid_variants(films(spark, sf), FRACTION, OVERLAP)


@query(f"SELECT * FROM ({_SWEEP}) WHERE n_tiles >= (SELECT count(*) FROM part) * 30 ORDER BY side_rule, stride_rule, border LIMIT 6")
def grid_shortlist(spark, sf):
    n = films(spark, sf).count()
    return tiles.prune_variants(tiles.grid_variants(films(spark, sf), FRACTION, OVERLAP), n * 30, 1 << 60)


@query(
    """SELECT o_orderkey AS id, stem, regexp_replace(stem, '^[AB]_', '') AS exposure, concat(stem, '__x', x, '__y', y, '__s', s) AS tile, x, y, s AS side FROM
  (SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'A_' WHEN o_orderkey % 3 = 1 THEN 'B_' ELSE '' END, 'DJ-RT-', o_custkey) AS stem, (o_orderkey % 700)::BIGINT AS x, (o_custkey % 300)::BIGINT AS y, (10 + o_orderkey % 50)::BIGINT AS s FROM orders)"""
)
def tile_id_round_trip(spark, sf):
    o = table(spark, sf, "orders")
    stem = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "A_").when(F.col("o_orderkey") % 3 == 1, "B_").otherwise(""), F.lit("DJ-RT-"), F.col("o_custkey").cast("string"))
    tile = S.tile_id(stem, F.col("o_orderkey") % 700, F.col("o_custkey") % 300, 10 + F.col("o_orderkey") % 50)
    rows = o.select(F.col("o_orderkey").alias("id"), tile.alias("tile")).withColumn("t", S.parse_tile_id(F.col("tile")))
    return rows.select("id", "t.stem", "t.exposure", "tile", "t.x", "t.y", "t.side")


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 END AS cls,
  CASE p_partkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 WHEN 7 THEN 8 END AS raster FROM part"""
)
def label_maps(spark, sf):
    names = F.array(*(F.lit(f" {x} ") for x in (*S.CLASS_OF_LABEL, *S.GROUP_VALUES)))
    label = F.get(names, (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.class_of(label).alias("cls"), S.raster_value(label).alias("raster"))


# inventory and audit


@query("SELECT sha1(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return audit.duplicate_groups(table(spark, sf, "documents"), F.col("text"), "doc_id")


@query("SELECT count(*) AS n_groups, coalesce(sum(n - 1), 0)::BIGINT AS n_redundant FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def redundant_count(spark, sf):
    return audit.redundant_count(duplicate_groups(spark, sf))


@query("SELECT doc_id FROM documents WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def dedupe_filter(spark, sf):
    return audit.not_redundant(table(spark, sf, "documents"), F.col("text"), "doc_id").select("doc_id")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL ORDER BY n DESC")
def label_histogram(spark, sf):
    return audit.histogram(table(spark, sf, "labels"), "quality", "toxic").orderBy(F.desc("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_labels(spark, sf):
    return audit.orphans(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k").select(F.col("k").alias("c_custkey"))


@query("SELECT CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT d.doc_id AS a, l.doc_id AS b FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY 1")
def pair_check(spark, sf):
    return audit.pair_check(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def pair_images(spark, sf):
    return audit.pair(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "has_label")


@query("SELECT concat('/labels/', p_partkey % 7, '/', p_partkey, '.a.json') AS label, p_partkey FROM part")
def label_paths(spark, sf):
    path = F.concat(F.lit("/raw/"), (F.col("p_partkey") % 7).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".a.TIF"))
    return table(spark, sf, "part").select(audit.label_path(path, "/raw", "/labels").alias("label"), "p_partkey")


@query("SELECT key, sum(n)::BIGINT AS n FROM (SELECT o_orderkey, l_returnflag || l_linestatus AS key, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) GROUP BY key")
def map_merge_count(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("cls")).agg(F.count("*").alias("n"))  # noqa: E741
    maps = l.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("counts"))
    return audit.merged_counts(maps, "counts")


@query("SELECT slot, round(sum(v), 3) AS total FROM (SELECT generate_subscripts(embedding, 1)::BIGINT - 1 AS slot, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY slot")
def vector_sum(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"))
    return audit.vector_sum(rows, "v").select(F.col("slot").cast("long").alias("slot"), F.round("total", 3).alias("total"))


@query("SELECT p_brand, round(sum(p_retailprice) FILTER (p_size > 40) / greatest(count(*) FILTER (p_size > 40), 1), 6) AS mean FROM part GROUP BY p_brand HAVING count(*) FILTER (p_size > 40) > 0")
def guarded_mean(spark, sf):
    big = F.col("p_size") > 40
    rows = table(spark, sf, "part").groupBy("p_brand").agg(F.sum(F.when(big, F.col("p_retailprice"))).alias("s"), F.count_if(big).alias("n")).where("n > 0")
    return rows.select("p_brand", F.round(audit.guarded_mean(F.col("s"), F.col("n")), 6).alias("mean"))


@query(f"SELECT min(height)::DOUBLE AS height_min, median(height) AS height_median, max(height)::DOUBLE AS height_max, min(width)::DOUBLE AS width_min, median(width) AS width_median, max(width)::DOUBLE AS width_max, count(*) FILTER (height > width) AS portrait FROM ({FILMS})")
def extent_summary(spark, sf):
    return audit.extent_summary(films(spark, sf))


@query("SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
def pixel_moments(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.explode("embedding").alias("v"))
    return audit.pixel_moments(rows, F.col("v").cast("double")).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    """SELECT id, list_filter([CASE WHEN NOT (cls BETWEEN 0 AND 5) THEN 'class' END, CASE WHEN outs THEN 'range' END, CASE WHEN edge AND NOT outs THEN 'edge' END, CASE WHEN w <= 0 OR h <= 0 THEN 'empty' END], lambda x: x IS NOT NULL) AS problems
  FROM (SELECT *, NOT (cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1) AS outs, (cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6 OR cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6) AS edge
    FROM (SELECT event_id AS id, event_id % 7 AS cls, (event_id % 101) / 97.0::DOUBLE AS cx, (event_id % 89) / 88.0::DOUBLE AS cy, (event_id % 13) / 12.0::DOUBLE AS w, (event_id % 17) / 16.0::DOUBLE AS h FROM events))"""
)
def label_checks(spark, sf):
    e = F.col("event_id")
    part = lambda m, d: (e % m) / F.lit(float(d))
    return table(spark, sf, "events").select(e.alias("id"), audit.label_problems(e % 7, part(101, 97), part(89, 88), part(13, 12), part(17, 16), 6).alias("problems"))


@query("SELECT n_nationkey, list_filter([CASE WHEN n_nationkey / 24.0 > 0.95 THEN 'whole_film' END, CASE WHEN n_nationkey / 24.0 < 0.05 THEN 'sliver' END, CASE WHEN n_nationkey % 2 = 0 THEN 'extended' END], lambda x: x IS NOT NULL) AS flags FROM nation")
def crop_flags(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", audit.film_flags(F.col("n_nationkey") / 24.0, F.col("n_nationkey") % 2 == 0).alias("flags"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def listed_films(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return audit.listed(table(spark, sf, "orders"), "o_custkey", c.where("c_nationkey < 12"), c.where("c_acctbal < 0")).select("o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("k", "v"))


@query("SELECT c_custkey, coalesce(a, b, c) AS seam, CASE WHEN a IS NOT NULL THEN 'gt' WHEN b IS NOT NULL THEN 'predicted' WHEN c IS NOT NULL THEN 'inline' END AS seam_source FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'g' END AS a, CASE WHEN c_custkey % 3 = 0 THEN 'p' END AS b, CASE WHEN c_custkey % 2 = 0 THEN 'i' END AS c FROM customer)")
def seam_fallback(spark, sf):
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(c, F.when(c % 4 == 0, "g").alias("gt"), F.when(c % 3 == 0, "p").alias("predicted"), F.when(c % 2 == 0, "i").alias("inline"))
    return audit.with_fallback(rows, "gt", "predicted", "inline").select("c_custkey", "seam", "seam_source")


# selection and splits

_DRAW = "sha256('7|' || {})"


@query(f"""WITH p AS (SELECT doc_id, 'positive' AS kind FROM labels WHERE toxic = 1), c AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format('doc_id')}) AS k FROM labels WHERE quality = 1 AND toxic = 0)
SELECT * FROM p UNION ALL SELECT doc_id, 'clean' FROM c WHERE k <= round_even((SELECT count(*) FROM p) * 2.5, 0)""")
def select_pos_neg(spark, sf):
    rows = table(spark, sf, "labels")
    return sampling.select_pos_neg(rows, F.col("toxic") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0), 2.5, 7, "doc_id").select("doc_id", "kind")


@query(f"SELECT event_id, CASE WHEN k <= (SELECT round_even(count(*) * 0.1, 0) FROM events) THEN 'val' ELSE 'train' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY {_DRAW.format('event_id')}) AS k FROM events)")
def split_random(spark, sf):
    return sampling.split_random(table(spark, sf, "events").select("event_id"), 0.1, 7, "event_id")


@query(f"""SELECT user_id, n, CASE WHEN before < (SELECT count(*) * 0.1 FROM events) THEN 'val' ELSE 'train' END AS part FROM
  (SELECT user_id, n, coalesce(sum(n) OVER (ORDER BY {_DRAW.format('user_id')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))""")
def split_grouped_greedy(spark, sf):
    return sampling.split_grouped(table(spark, sf, "events"), "user_id", 0.1, 7)


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW.format('event_id')}) AS k FROM events) WHERE k <= 5")
def random_pick_per_class(spark, sf):
    return sampling.sample(table(spark, sf, "events").select("event_id", "event_type"), F.lit(5), 7, "event_id", partition=("event_type",))


@query(f"""WITH b AS (SELECT event_id, event_id % 2 AS arm, event_type FROM events), c AS (SELECT event_type, arm, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT event_type, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS least FROM c GROUP BY event_type)
SELECT event_id, arm, event_type, k <= least AS keep FROM (SELECT *, row_number() OVER (PARTITION BY arm, event_type ORDER BY {_DRAW.format('event_id')}) AS k FROM b) JOIN m USING (event_type)""")
def trim_arms(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 2).alias("arm"), "event_type")
    return sampling.trim_arms(rows, "arm", "event_type", 7, "event_id")


# rebalancing

_SETS = "SELECT l_orderkey AS tile, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS classes FROM lineitem GROUP BY l_orderkey"
_T = 0.3
_FACTORS = f"""WITH s AS ({_SETS}), n AS (SELECT count(*) AS n FROM s), c AS (SELECT cls, greatest(1.0, sqrt({_T} / (count(*) / (SELECT n FROM n)))) AS r FROM (SELECT unnest(classes) AS cls FROM s) GROUP BY cls),
f AS (SELECT tile, max(r) AS factor FROM (SELECT tile, unnest(classes) AS cls FROM s) JOIN c USING (cls) GROUP BY tile)"""


def _sets(spark, sf):
    return rebalance.class_sets(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile"), F.concat("l_returnflag", "l_linestatus").alias("cls")), "tile", "cls")


@query(f"{_FACTORS} SELECT tile, array_to_string(classes, '+') AS classes, round(factor, 9) AS factor FROM s JOIN f USING (tile)")
def repeat_factors(spark, sf):
    return rebalance.repeat_factors(_sets(spark, sf), _T).select("tile", F.array_join("classes", "+").alias("classes"), F.round("factor", 9).alias("factor"))


_COPIES = f"{_FACTORS}, k AS (SELECT tile, factor, (floor(factor) + CASE WHEN ('0x' || substr(sha256('7|' || tile), 1, 8))::BIGINT / 4294967296.0::DOUBLE < factor - floor(factor) THEN 1 ELSE 0 END)::BIGINT AS copies FROM f)"


@query(f"{_COPIES} SELECT copies, count(*) AS n FROM k GROUP BY copies")
def repeat_counts(spark, sf):
    rows = sampling.with_copies(rebalance.repeat_factors(_sets(spark, sf), _T), F.col("factor"), 7, "tile")
    return rows.groupBy("copies").agg(F.count("*").alias("n"))


@query(f"{_COPIES} SELECT tile, unnest(range(1, copies + 1)) AS copy FROM k WHERE copies > 0")
def replicate_rows(spark, sf):
    rows = sampling.with_copies(rebalance.repeat_factors(_sets(spark, sf), _T), F.col("factor"), 7, "tile")
    return sampling.replicate(rows).select("tile", "copy")


@query(f"""{_COPIES}, v AS (SELECT cls, count(*) AS tiles, sum(copies) AS views FROM (SELECT tile, unnest(classes) AS cls FROM s) JOIN k USING (tile) GROUP BY cls), a AS (SELECT DISTINCT l_returnflag || l_linestatus AS cls FROM lineitem UNION ALL SELECT 'none')
SELECT cls, coalesce(tiles, 0)::BIGINT AS tiles, round(coalesce(tiles, 0) / (SELECT n FROM n), 6) AS share, coalesce(views, 0)::DOUBLE AS views, round(views::DOUBLE / tiles, 6) AS multiplier FROM a LEFT JOIN v USING (cls)""")
def class_table(spark, sf):
    rows = sampling.with_copies(rebalance.repeat_factors(_sets(spark, sf), _T), F.col("factor"), 7, "tile")
    classes = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cls")).distinct()
    return rebalance.class_table(rows, classes.unionByName(spark.createDataFrame([("none",)], "cls string")), F.col("copies"))


@query(f"{_COPIES}, v AS (SELECT cls, sum(copies) AS views FROM (SELECT tile, unnest(classes) AS cls FROM s) JOIN k USING (tile) GROUP BY cls) SELECT round((max(views) - min(views)) / max(views)::DOUBLE, 6) AS spread FROM v")
def equal_spread(spark, sf):
    return rebalance.views_spread(class_table(spark, sf))


@query(f"WITH s AS ({_SETS}), c AS (SELECT cls, count(*) AS n FROM (SELECT unnest(classes) AS cls FROM s) GROUP BY cls), t AS (SELECT * FROM (SELECT 'max' AS target, max(n)::DOUBLE AS views FROM c UNION ALL SELECT 'second', n::DOUBLE FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM c) WHERE k = 2 UNION ALL SELECT '500', 500.0)) SELECT target, cls, round(views, 0) AS views FROM t CROSS JOIN c")
def equal_factors(spark, sf):
    """Expected views of every class under the factors for each target: all are the target."""
    one = lambda how: rebalance.equal_factors(_sets(spark, sf), how).select(F.lit(how).alias("target"), F.explode("classes").alias("cls"), "factor").groupBy("target", "cls").agg(F.round(F.sum("factor"), 0).alias("views"))
    return one("max").unionByName(one("second")).unionByName(one("500"))


@query(f"SELECT array_to_string(classes, '+') AS bucket, count(*) AS n FROM ({_SETS}) GROUP BY 1")
def bucket_counts(spark, sf):
    return _sets(spark, sf).groupBy(S.class_signature(F.col("classes")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""{_FACTORS}, b AS (SELECT l_returnflag || l_linestatus AS cls, count(*) AS boxes FROM lineitem GROUP BY 1), v AS (SELECT cls, count(*) AS tiles, sum(factor) AS views FROM (SELECT tile, unnest(classes) AS cls FROM s) JOIN f USING (tile) GROUP BY cls)
SELECT cls, tiles, boxes, round(tiles / (SELECT n FROM n), 6) AS share, round(views, 4) AS expected_views, round(boxes / tiles, 6) AS boxes_per_tile, ceil(round(views - tiles, 6))::BIGINT AS to_add FROM v JOIN b USING (cls)""")
def budget(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile"), F.concat("l_returnflag", "l_linestatus").alias("cls"))
    return rebalance.budget(rows, "tile", "cls", _T)


@query(
    """SELECT cls, tiles, defects, target, round(tiles::DOUBLE / nullif(defects, 0), 6) AS rate, greatest(0, target - tiles)::BIGINT AS missing,
  CASE WHEN target <= tiles THEN 0 ELSE ceil(round(1.1::DOUBLE * ((target - tiles) / (tiles::DOUBLE / defects)), 6)) END::BIGINT AS more
  FROM (SELECT l_returnflag || l_linestatus AS cls, count(DISTINCT l_orderkey) AS tiles, count(*) AS defects, (SELECT count(*) // 5 FROM orders) AS target FROM lineitem GROUP BY 1)"""
)
def topup_deficit(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("cls")).agg(F.count_distinct("l_orderkey").alias("tiles"), F.count("*").alias("defects"))
    target = table(spark, sf, "orders").agg(F.floor(F.count("*") / 5).alias("target"))
    return rebalance.topup(rows.crossJoin(F.broadcast(target)))


# spatial joins

_FLUSH = tiles_sql("flush")
_TOUCH = "b.x1 >= t.x AND b.x0 <= t.x + t.side AND b.y1 >= t.y AND b.y0 <= t.y + t.side"
_PAIRS = f"SELECT t.film, t.x, t.y, t.side, b.shape, b.cls, b.x0, b.y0, b.x1, b.y1 FROM ({_FLUSH}) t JOIN ({BOXES}) b ON t.film = b.film AND {_TOUCH}"
_CLIPPED = f"""SELECT *, least(1.0, bw * bh / greatest((x1 - x0) * (y1 - y0), 1.0)) AS visible FROM (SELECT *, ceil(least(x1 - x, side)) - floor(greatest(x0 - x, 0)) AS bw, ceil(least(y1 - y, side)) - floor(greatest(y0 - y, 0)) AS bh FROM ({_PAIRS})
  WHERE least(x1 - x, side) - greatest(x0 - x, 0) > 0 AND least(y1 - y, side) - greatest(y0 - y, 0) > 0)"""


def _pairs(spark, sf, cell=None):
    return spatial.grid_boxes(tiles.with_grid(films(spark, sf), FRACTION, OVERLAP, "flush"), boxes(spark, sf), cell=cell)


_PAIR_COUNT = f"SELECT film, x, y, side, count(*) AS n FROM ({_PAIRS}) GROUP BY ALL"


@query(_PAIR_COUNT)
def tile_window_join(spark, sf):
    return _pairs(spark, sf).groupBy("film", "x", "y", "side").agg(F.count("*").alias("n"))


@query(_PAIR_COUNT)
def window_join_cells(spark, sf):
    return _pairs(spark, sf, cell=256).groupBy("film", "x", "y", "side").agg(F.count("*").alias("n"))


@query(f"SELECT film, x, y, count(*) AS n_boxes, count(*) FILTER (bw >= 4 AND bh >= 4 AND (visible >= 0.10 OR bw * bh >= 0.005::DOUBLE * side * side)) AS kept, round(sum(visible), 9) AS visible FROM ({_CLIPPED}) GROUP BY ALL")
def keep_rule_rect(spark, sf):
    rows = spatial.clipped_boxes(_pairs(spark, sf))
    keep = geometry.keep_rule(F.col("box_w"), F.col("box_h"), F.col("visible"), F.col("side"))
    return rows.groupBy("film", "x", "y").agg(F.count("*").alias("n_boxes"), F.count_if(keep).alias("kept"), F.round(F.sum("visible"), 9).alias("visible"))


_RULES = [(a, b, c) for a in (2.0, 4.0, 8.0) for b in (0.05, 0.1, 0.25) for c in (0.0025, 0.005)]
_RULES_SQL = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_RULES))


@query(f"""SELECT rule, sum(n)::BIGINT AS boxes, count(*) AS positive_tiles FROM (SELECT rule, film, x, y, count(*) AS n FROM ({_CLIPPED}) c, (VALUES {_RULES_SQL}) r(rule, a, b, c)
  WHERE bw >= r.a AND bh >= r.a AND (visible >= r.b OR bw * bh >= r.c * side * side) GROUP BY ALL) GROUP BY rule""")
def rule_sweep(spark, sf):
    return spatial.rule_sweep(spatial.clipped_boxes(_pairs(spark, sf)), _RULES, ["film", "x", "y"])


@query(f"SELECT rule, cls, count(*) AS boxes FROM ({_CLIPPED}) c, (VALUES {_RULES_SQL}) r(rule, a, b, c) WHERE bw >= r.a AND bh >= r.a AND (visible >= r.b OR bw * bh >= r.c * side * side) GROUP BY ALL")
def rule_sweep_classes(spark, sf):
    return spatial.rule_sweep_classes(spatial.clipped_boxes(_pairs(spark, sf)), _RULES, "cls")


@query(f"SELECT film, x, y FROM ({_FLUSH}) t WHERE EXISTS (SELECT 1 FROM ({BOXES}) b WHERE b.film = t.film AND b.x0 >= t.x AND b.x0 < t.x + t.side AND b.y0 >= t.y AND b.y0 < t.y + t.side AND b.cls = 'RF')")
def point_in_window(spark, sf):
    t = tiles.enumerate_tiles(films(spark, sf), FRACTION, OVERLAP, "flush").select("film", "x", "y", "side")
    points = boxes(spark, sf).where("cls = 'RF'").select("film", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return spatial.windows_with_point(t, points).select("film", "x", "y")


@query(f"SELECT film, x, y FROM ({_FLUSH}) t WHERE EXISTS (SELECT 1 FROM ({BOXES}) b WHERE b.film = t.film AND b.x0 >= t.x AND b.x0 < t.x + t.side AND b.y0 >= t.y AND b.y0 < t.y + t.side)")
def point_in_window_cells(spark, sf):
    t = tiles.enumerate_tiles(films(spark, sf), FRACTION, OVERLAP, "flush").select("film", "x", "y", "side")
    points = boxes(spark, sf).select("film", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return spatial.windows_with_point(t, points, cell=128).select("film", "x", "y")


@query(f"SELECT DISTINCT a.film, a.shape FROM ({BOXES}) a JOIN ({BOXES}) b ON a.film = b.film AND a.shape <> b.shape AND b.x0 <= a.x1 + 6 AND b.x1 >= a.x0 - 6 AND b.y0 <= a.y1 + 6 AND b.y1 >= a.y0 - 6")
def shape_clashes(spark, sf):
    return spatial.clashes(boxes(spark, sf), 6).select("film", "shape").distinct()


@query(f"""SELECT film, shape, px >= x AND px < x + side AND py >= y AND py < y + side AS inside, distance, x, y FROM (SELECT *, row_number() OVER (PARTITION BY film, shape ORDER BY NOT (px >= x AND px < x + side AND py >= y AND py < y + side), distance, y, x) AS k
  FROM (SELECT t.*, b.shape, px, py, round(sqrt((px - t.x - t.side / 2.0) * (px - t.x - t.side / 2.0) + (py - t.y - t.side / 2.0) * (py - t.y - t.side / 2.0)), 6) AS distance FROM ({_FLUSH}) t JOIN (SELECT film, shape, min((x0 + x1) / 2) AS px, min((y0 + y1) / 2) AS py FROM ({BOXES}) GROUP BY ALL) b USING (film))) WHERE k = 1""")
def best_window(spark, sf):
    points = boxes(spark, sf).groupBy("film", "shape").agg(F.min((F.col("x0") + F.col("x1")) / 2).alias("px"), F.min((F.col("y0") + F.col("y1")) / 2).alias("py"))
    return spatial.best_grid_window(tiles.with_grid(films(spark, sf), FRACTION, OVERLAP, "flush"), points)


def _quad(dx=0.0, dy=0.0):
    s, p = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    corner = lambda x, y: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return F.array(corner(p, p), corner(p + s, p), corner(p + s, p + 2 * s), corner(p - 1, p + s))


_P = "(p_partkey % 50)::DOUBLE"
_QX, _QY = f"[{_P}, {_P} + p_size, {_P} + p_size, {_P} - 1]", f"[{_P}, {_P}, {_P} + 2 * p_size, {_P} + p_size]"


@query(f"""SELECT p_partkey AS id, list_min(qx) AS x0, list_min(qy) AS y0, list_max(qx) AS x1, list_max(qy) AS y1,
  round(abs(list_sum(list_transform(range(1, 5), lambda i: qx[i] * qy[i % 4 + 1] - qx[i % 4 + 1] * qy[i]))) / 2, 6) AS area FROM (SELECT p_partkey, {_QX} AS qx, {_QY} AS qy FROM part)""")
def polygon_measures(spark, sf):
    q = _quad()
    box = geometry.bbox(q)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")), F.round(geometry.polygon_area(q), 6).alias("area"))


_PX, _PY = "({p} + (p_partkey % 17)::DOUBLE * p_size / 12.0::DOUBLE)".format(p=_P), "({p} + (p_partkey % 13)::DOUBLE * p_size / 5.0::DOUBLE)".format(p=_P)
_AX, _AY, _BX, _BY = "qx[i]", "qy[i]", "qx[i % 4 + 1]", "qy[i % 4 + 1]"
_ON = f"({_BX} - {_AX}) * (py - {_AY}) - ({_BY} - {_AY}) * (px - {_AX}) = 0 AND px BETWEEN least({_AX}, {_BX}) AND greatest({_AX}, {_BX}) AND py BETWEEN least({_AY}, {_BY}) AND greatest({_AY}, {_BY})"
_CROSS = f"({_AY} > py) <> ({_BY} > py) AND px < {_AX} + (py - {_AY}) * ({_BX} - {_AX}) / ({_BY} - {_AY})"


@query(f"""SELECT id, CASE WHEN len(list_filter(range(1, 5), lambda i: {_ON})) > 0 THEN 0 WHEN len(list_filter(range(1, 5), lambda i: {_CROSS})) % 2 = 1 THEN 1 ELSE -1 END AS side
FROM (SELECT p_partkey AS id, {_QX} AS qx, {_QY} AS qy, {_PX} AS px, {_PY} AS py FROM part)""")
def point_in_polygon(spark, sf):
    p, s = (F.col("p_partkey") % 50).cast("double"), F.col("p_size").cast("double")
    px, py = p + (F.col("p_partkey") % 17).cast("double") * s / 12.0, p + (F.col("p_partkey") % 13).cast("double") * s / 5.0
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), geometry.point_in_polygon(px, py, _quad()).alias("side"))


@query("SELECT p_partkey AS id, r AS representative, 0 AS rotation, (p_partkey % 50 - r % 50)::DOUBLE AS dx, (p_partkey % 50 - r % 50)::DOUBLE AS dy, n FROM (SELECT p_partkey, min(p_partkey) OVER w AS r, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_size))")
def translation_classes(spark, sf):
    return spatial.translation_classes(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), _quad().alias("points")))


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_size) AS representative, count(*) OVER (PARTITION BY p_size) AS n FROM part")
def rotation_classes(spark, sf):
    """Every part's quadrangle turned by its key's quarter turns: turned copies are found again."""
    turned = F.lit(None)
    for k in range(4):
        turned = F.when(F.col("p_partkey") % 4 == k, geometry.rotate_quarter(_quad(), 300.0, 200.0, k)).otherwise(turned)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), turned.alias("points"))
    return spatial.translation_classes(rows, rotations=(0, 1, 2, 3), width=300.0, height=200.0).select("id", "representative", "n")


@query("SELECT l_orderkey AS image, l_orderkey % 4 AS rotation, (l_orderkey % 7)::DOUBLE AS dx, (l_orderkey % 5)::DOUBLE AS dy, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey")
def crop_offsets(spark, sf):
    """Every order as an image with a polygon a line number; its crop is a turned and moved copy, whose turn and offset are found."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("double").alias("k")).distinct()
    corner = lambda x, y: F.struct((100 + x).alias("x"), (50 + y).alias("y"))
    k, zero = F.col("k"), F.lit(0.0)
    whole = F.array(corner(zero + 9 * k, zero), corner(5 + 12 * k, zero), corner(5 + 12 * k, 1 + 2 * k), corner(9 * k - 1, 2 * k))
    turned = F.lit(None)
    for q in range(4):
        turned = F.when(F.col("image") % 4 == q, geometry.rotate_quarter(whole, 400.0, 300.0, q)).otherwise(turned)
    moved = F.transform(turned, lambda p: F.struct((p["x"] - F.col("image") % 7).alias("x"), (p["y"] - F.col("image") % 5).alias("y")))
    left = rows.select("image", F.col("k").alias("id"), moved.alias("points"))
    right = rows.select("image", F.col("k").alias("id"), whole.alias("points"))
    found = spatial.translation_matches(left, right, rotations=(0, 1, 2, 3), width=400.0, height=300.0, by=("image",))
    return spatial.majority_offset(found, "rotation").withColumn("rotation", F.col("rotation").cast("long"))


@query(
    """SELECT c, dx, dy, n FROM (SELECT c, dx, dy, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, dx, dy) AS k FROM (SELECT l_returnflag AS c, (l_orderkey % 5)::DOUBLE AS dx, (l_suppkey % 3)::DOUBLE AS dy, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1"""
)
def majority_offset(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("image"), (F.col("l_orderkey") % 5).cast("double").alias("dx"), (F.col("l_suppkey") % 3).cast("double").alias("dy"))
    return spatial.majority_offset(rows).withColumnRenamed("image", "c")


# statistics


@query(
    "SELECT event_type, count(*) AS n, count(value) AS n_defined, "
    + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{str(round(100 * q, 1)).rstrip('0').rstrip('.').replace('.', '_')}" for q in statistics.BANDS)
    + " FROM (SELECT event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events) GROUP BY event_type"
)
def percentile_bands(spark, sf):
    rows = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"))
    return statistics.percentile_bands(rows, ["event_type"], "value")


@query(
    """SELECT event_type, round(max(abs(a - b)), 9) AS ks FROM (SELECT event_type, sum(x) OVER w / sum(x) OVER (PARTITION BY event_type) AS a, sum(y) OVER w / sum(y) OVER (PARTITION BY event_type) AS b FROM
  (SELECT event_type, value, count(*) FILTER (event_id % 2 = 0) AS x, count(*) FILTER (event_id % 2 <> 0) AS y FROM events WHERE value IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY value)) GROUP BY event_type"""
)
def ks_distance(spark, sf):
    return statistics.ks_distance(table(spark, sf, "events"), ["event_type"], F.col("event_id") % 2 == 0, "value")


@query("SELECT event_type, round(1.4826 * mad(value), 6) AS sigma FROM events GROUP BY event_type")
def robust_sigma(spark, sf):
    return statistics.robust_sigma(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")


@query(
    """WITH r AS (SELECT user_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), g AS (SELECT user_id, f, i, i - sum(f::INT) OVER (PARTITION BY user_id ORDER BY i) AS k FROM r),
u AS (SELECT user_id, min(i) AS s, count(*) AS n FROM g WHERE f GROUP BY user_id, k), b AS (SELECT user_id, s, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS z FROM u)
SELECT user_id, coalesce(s, 0)::BIGINT AS start, coalesce(n, 0)::BIGINT AS length FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM b WHERE z = 1) USING (user_id)"""
)
def longest_run(spark, sf):
    return statistics.longest_run(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 50)


@query(
    """WITH d AS (SELECT l_suppkey AS g, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS a, l_discount - avg(l_discount) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
s AS (SELECT count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM d) SELECT n, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 6) AS b1, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 6) AS b2 FROM s"""
)
def fe_ols(spark, sf):
    return statistics.fixed_effect_ols(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", "l_discount").withColumn("n", F.col("n").cast("long"))


@query(
    """WITH d AS (SELECT l_suppkey AS g, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS a, l_discount - avg(l_discount) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
m AS (SELECT g, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, count(*) AS n, row_number() OVER (ORDER BY sha256('3|' || g)) - 1 AS pos FROM d GROUP BY g),
p AS (SELECT draw, floor(('0x' || substr(sha256('3|' || draw || '|' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (SELECT count(*) FROM m))::BIGINT AS pos FROM (SELECT unnest(range(1, 101)) AS draw), (SELECT unnest(range(1, (SELECT count(*) FROM m) + 1)) AS k)),
s AS (SELECT draw, sum(n)::BIGINT AS n, sum(aa) AS aa, sum(ab) AS ab, sum(bb) AS bb, sum(ay) AS ay, sum(byy) AS byy FROM p JOIN m USING (pos) GROUP BY draw)
SELECT draw, n, round((ay * bb - byy * ab) / (aa * bb - ab * ab), 5) AS b1, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 4) AS b2 FROM s"""
)
def bootstrap_draws(spark, sf):
    out = statistics.bootstrap_draws(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", draws=100, seed=3)
    return out.select(F.col("draw").cast("long").alias("draw"), "n", F.round("b1", 5).alias("b1"), F.round("b2", 4).alias("b2"))


@query("SELECT l_returnflag, bin::BIGINT AS bin, count(*) AS n, round(avg(q), 6) AS x_mean, round(avg(p), 6) AS y_mean FROM (SELECT l_returnflag, l_quantity AS q, l_extendedprice AS p, ntile(25) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_extendedprice, l_orderkey) AS bin FROM lineitem) GROUP BY ALL")
def binned_mean(spark, sf):
    rows = table(spark, sf, "lineitem")
    out = statistics.binned_mean(rows, "l_quantity", "l_extendedprice", ["l_extendedprice", "l_orderkey"], by=("l_returnflag",))
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("SELECT bin::BIGINT AS bin, count(*) AS n, round(avg(q), 6) AS x_mean, round(avg(p), 6) AS y_mean FROM (SELECT l_quantity AS q, l_extendedprice AS p, ntile(40) OVER (ORDER BY l_quantity, l_extendedprice) AS bin FROM lineitem) GROUP BY ALL")
def binned_mean_all(spark, sf):
    out = statistics.binned_mean(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_extendedprice"], bins=40)
    return out.withColumn("bin", F.col("bin").cast("long"))


@query("WITH RECURSIVE d AS (SELECT p_brand, list_sort(list_distinct(list((v - low)::BIGINT))) AS l FROM (SELECT p_brand, round(p_retailprice * 100)::BIGINT AS v, min(round(p_retailprice * 100)::BIGINT) OVER (PARTITION BY p_brand) AS low FROM part) GROUP BY p_brand) SELECT p_brand, coalesce(list_reduce(l, lambda a, b: gcd(a, b)), 0)::BIGINT AS step FROM d")
def gcd_step(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("v"))
    return statistics.gcd_step(rows, ["p_brand"], "v")


@query("SELECT user_id, event_id AS epoch, v AS best FROM (SELECT user_id, event_id, coalesce(round(value), 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(round(value), 0) DESC, event_id) AS k FROM events) WHERE k = 1")
def best_epoch(spark, sf):
    rows = table(spark, sf, "events").withColumn("v", F.round("value"))
    return statistics.best_epoch(rows, "v", "event_id", ("user_id",))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (value > 50) >= 20)")
def min_sample_cut(spark, sf):
    return statistics.min_sample(table(spark, sf, "events"), "user_id", F.col("value") > 50, 20).select("event_id")


# order-dependent operators

_SECONDS = "epoch(ts)::BIGINT"


@query(f"SELECT event_id, user_id, sum(coalesce((s - p > 3600)::INT, 0)) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS island FROM (SELECT event_id, user_id, {_SECONDS} AS s, lag({_SECONDS}) OVER (PARTITION BY user_id ORDER BY {_SECONDS}, event_id) AS p FROM events)")
def gap_islands(spark, sf):
    seconds = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")  # to the nearest second, as the SQL's cast
    rows = table(spark, sf, "events").select("event_id", "user_id", seconds.alias("s"))
    return windows.gap_islands(rows, ["user_id"], "s", F.col("s"), [F.asc_nulls_last("s"), F.asc_nulls_last("event_id")], 3600).select("event_id", "user_id", "island")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3")
def first_rows(spark, sf):
    return windows.first_rows(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(
    """WITH p AS (SELECT s_nationkey AS g, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS at, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
u AS (SELECT c_nationkey AS g, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) SELECT c_custkey, s_suppkey FROM u JOIN p ON u.g = p.g AND u.k % p.n = p.at"""
)
def round_robin(spark, sf):
    uses = table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), "c_custkey")
    pool = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), "s_suppkey")
    return windows.round_robin(uses, pool, ["g"], ["c_custkey"], ["s_suppkey"]).select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, (k // 7)::BIGINT AS batch, (k // 7 % 5)::BIGINT AS host FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)")
def batching(spark, sf):
    return windows.batches(table(spark, sf, "customer"), ["c_nationkey"], ["c_custkey"], 7, 5).select("c_custkey", "batch", "host")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_per_source(spark, sf):
    return windows.top_per_source(table(spark, sf, "orders"), "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 10).select("o_custkey", "o_orderkey", "o_totalprice")


# groups and rollups


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS root FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1)")
def dup_components(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    first = docs.groupBy("d").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z")
    return groups.components(docs.join(first, "d").select("a", F.col("doc_id").alias("b")))


@query()
def split_test_stratified(spark, sf):
    """All customers with orders; labels are order priorities."""
    per = table(spark, sf, "orders").groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("k")).agg(F.count("*").alias("n"))
    return groups.stratified_sides(per, "o_custkey", "k", "n", 4, 7).select(F.col("o_custkey").cast("string").alias("exposure"), "side")


@query(
    """WITH r AS (SELECT o_orderstatus AS side, o_custkey AS exposure, l_orderkey AS tile, l_returnflag || l_linestatus AS cls FROM orders JOIN lineitem ON o_orderkey = l_orderkey), c AS (SELECT DISTINCT l_returnflag || l_linestatus AS cls FROM lineitem UNION ALL SELECT 'zz'), s AS (SELECT DISTINCT side FROM r)
SELECT side, cls, count(DISTINCT exposure) AS exposures, count(DISTINCT tile) AS tiles, count(tile) AS boxes FROM s CROSS JOIN c LEFT JOIN r USING (side, cls) GROUP BY ALL"""
)
def nested_rollup(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile"), F.concat("l_returnflag", "l_linestatus").alias("cls"))  # noqa: E741
    rows = l.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile"), F.col("o_orderstatus").alias("side"), F.col("o_custkey").alias("exposure")), "tile")
    classes = l.select("cls").distinct().unionByName(spark.createDataFrame([("zz",)], "cls string"))
    return groups.side_rollup(rows, classes)


@query(
    """SELECT source, sum(n)::BIGINT AS n, array_to_string(list_sort(list(s || ':' || n)), ',') AS by_status, sum(ok)::BIGINT AS n_ok, sum(known)::BIGINT AS n_known, round(sum(ok)::DOUBLE / nullif(sum(known), 0), 3) AS ok_share FROM
  (SELECT n_name AS source, o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS ok, count(o_totalprice) AS known FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY source"""
)
def source_rollup(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("source"))
    rows = table(spark, sf, "orders").join(c, "o_custkey").withColumn("ok", F.col("o_totalprice") > 100000)
    out = groups.source_rollup(rows, "source", "o_orderstatus", "ok", "o_totalprice")
    entries = F.transform(F.map_entries("by_status"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return out.withColumn("by_status", F.array_join(F.array_sort(entries), ","))


@query("SELECT DISTINCT a.doc_id AS exposure FROM documents a WHERE a.text IN (SELECT text FROM documents WHERE doc_id % 10 = 0) AND a.doc_id % 10 <> 0")
def tainted_exposures(spark, sf):
    """Copies of validation documents that are not validation documents themselves; groups are (group, exposure) rows."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("group")).where("group IS NOT NULL")
    return groups.tainted(docs.withColumnRenamed("doc_id", "exposure"), table(spark, sf, "documents").where("doc_id % 10 = 0").select(F.col("doc_id").alias("exposure")))


@query(
    """SELECT 'labels_known' AS name, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS violations
UNION ALL SELECT 'parts_disjoint', (SELECT count(DISTINCT user_id) FROM events WHERE event_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_id % 5 = 0))
UNION ALL SELECT 'orders_have_customers', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'merge_grew', (SELECT (a + b <> c)::INT FROM (SELECT (SELECT count(*) FROM events WHERE event_id % 3 = 0) AS a, (SELECT count(*) FROM events WHERE event_id % 5 = 0) AS b, (SELECT count(*) FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0) AS c))
UNION ALL SELECT 'rows_differ', (SELECT count(*) FROM events WHERE event_id % 7 = 0 AND event_type IS NOT NULL)
UNION ALL SELECT 'counts_differ', (SELECT count(*) FROM (SELECT event_type FROM events GROUP BY event_type HAVING count(*) % 2 = 1))
UNION ALL SELECT 'arms_differ', (SELECT count(*) FROM (SELECT event_type FROM events GROUP BY event_type HAVING count(*) FILTER (event_id % 2 = 0 AND value > 50) <> count(*) FILTER (event_id % 2 = 1 AND value > 50)))
UNION ALL SELECT 'polarity', (SELECT count(*) FROM (SELECT n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(o_totalprice) >= 20 AND avg((o_totalprice > 100000)::INT) < 0.8))"""
)
def constraint_report(spark, sf):
    docs, labels, orders = (table(spark, sf, t) for t in ("documents", "labels", "orders"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    third, fifth, either = events.where("event_id % 3 = 0"), events.where("event_id % 5 = 0"), events.where("event_id % 3 = 0 OR event_id % 5 = 0")
    typed = events.where("event_type IS NOT NULL").select("event_id", "event_type")
    even = events.groupBy("event_type").agg((F.count("*") - F.count("*") % 2).alias("n"))
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return constraints.report(
        [
            constraints.all_in(labels, docs, "doc_id", "labels_known"),
            constraints.disjoint(third, fifth, "user_id", "parts_disjoint"),
            constraints.all_in(orders, c, "o_custkey", "orders_have_customers"),
            constraints.grew_by(third, either, fifth, "merge_grew"),
            constraints.same_rows(typed, typed.where("event_id % 7 <> 0"), "rows_differ"),
            constraints.same_count(events, even, "event_type", "counts_differ"),
            constraints.arms_equal(events.withColumn("arm", F.col("event_id") % 2).withColumn("keep", F.col("value") > 50), "arm", "event_type", "keep", "arms_differ"),
            constraints.polarity_gate(orders.join(c, "o_custkey").withColumn("darker", F.col("o_totalprice") > 100000), "n_name", "darker"),
        ]
    )


# array kernels

_SORTED = "list_sort(list_transform(embedding, lambda x: x::DOUBLE))"
_E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _quantile_sql(s, n, q):
    at = f"(({n} - 1) * {q / 100.0}::DOUBLE)"
    return f"({s}[floor({at})::INT + 1] + ({s}[least(floor({at})::INT + 2, {n})] - {s}[floor({at})::INT + 1]) * ({at} - floor({at})))"


def _e():
    return F.col("embedding").cast("array<double>")


@query(f"SELECT vec_id, list_sum(p)::BIGINT AS total, list_max(p)::BIGINT AS hi, p[1]::BIGINT AS first FROM (SELECT vec_id, list_transform(e, lambda v: trunc(least(greatest((v - lo) / (hi - lo) * 255.0, 0.0), 255.0))) AS p FROM (SELECT vec_id, {_E} AS e, {_quantile_sql(_SORTED, 64, 10)} AS lo, {_quantile_sql(_SORTED, 64, 90)} AS hi FROM embeddings))")
def contrast_stretch(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", arrays.contrast_stretch(_e(), 10, 90).alias("p"))
    return p.select("vec_id", F.aggregate("p", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_max("p").cast("long").alias("hi"), F.col("p")[0].cast("long").alias("first"))


@query(f"SELECT vec_id, r, round(median(v), 6) AS med FROM (SELECT vec_id, unnest(range(0, 64)) // 8 AS r, unnest({_E}) AS v FROM embeddings) GROUP BY ALL")
def strip_profile(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(arrays.row_medians(_e(), 8, 8)).alias("r", "m"))
    return rows.select("vec_id", F.col("r").cast("long").alias("r"), F.round("m", 6).alias("med"))


@query("SELECT vec_id, round(min(c), 6) AS score FROM (SELECT a.vec_id, a.i // 16 AS s, corr(a.v, b.v) AS c FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) a JOIN (SELECT unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id = 0) b USING (i) GROUP BY ALL) GROUP BY vec_id")
def profile_ncc(spark, sf):
    rows = table(spark, sf, "embeddings")
    target = rows.where("vec_id = 0").select(_e().alias("t"))
    return rows.crossJoin(F.broadcast(target)).select("vec_id", F.round(arrays.worst_slice_score(_e(), F.col("t"), 4, 16), 6).alias("score"))  # one target row


@query(f"SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT vec_id, unnest({_E}) AS v FROM embeddings) GROUP BY ALL")
def tile_qa(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", arrays.pixel_qa(_e()).alias("q"))
    return rows.select("vec_id", F.round("q.mean", 6).alias("mean"), F.round("q.std", 6).alias("std"))


@query("SELECT vec_id, round(avg(v) FILTER (v > 0) - avg(v) FILTER (v <= 0), 6) AS contrast FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id")
def region_contrast(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.region_contrast(_e(), F.transform(_e(), lambda v: v > 0)), 6).alias("contrast"))


@query("SELECT vec_id, round(count(*) FILTER (v > 0 AND v > 0.1)::DOUBLE / nullif(count(*) FILTER (v > 0 OR v > 0.1), 0), 6) AS iou FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id")
def mask_iou(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(arrays.mask_iou(F.transform(_e(), lambda v: v > 0), F.transform(_e(), lambda v: v > 0.1)), 6).alias("iou"))


_AT = "e[1 + 8 * (i // 4 + 3) + i % 4 + 2]"


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(0, 16), lambda i: {_AT} * (i + 1))), 6) AS cropped, round(list_sum(list_transform(range(0, 64), lambda i: e[1 + 8 * (7 - i // 8) + i % 8] * (i + 1))), 6) AS below,
  round(list_sum(list_transform(range(0, 64), lambda i: e[1 + 8 * (i // 8) + 7 - i % 8] * (i + 1))), 6) AS beside, round(list_sum(list_transform(range(0, 60), lambda i: e[1 + 8 * ((i // 12) * 8 // 5) + (i % 12) * 8 // 12] * (i + 1))), 6) AS resized
  FROM (SELECT vec_id, {_E} AS e FROM embeddings)""")
def crop_and_flip(spark, sf):
    """Every pixel of the results counts with its place."""
    e = _e()
    total = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        total(arrays.crop(e, 8, F.lit(2), F.lit(3), 4)).alias("cropped"),
        total(arrays.flip_rows(e, 8, 8)).alias("below"),
        total(arrays.flip_columns(e, 8, 8)).alias("beside"),
        total(arrays.resize_nearest(e, 8, 8, 5, 12)).alias("resized"),
    )


# selection


@query(
    """SELECT o_orderkey AS stem FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 11 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) % 3 = 1)"""
)
def eligible_films(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("exposure"), F.when(F.col("o_orderpriority") != "1-URGENT", "uint16").otherwise("uint8").alias("dtype"), (F.col("o_orderkey") % 11 != 0).alias("has_label"))
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "exposure")
    steps = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("stem")).agg((F.count("*") % 3).alias("step"))
    return selection.eligible_films(o, c.where("c_nationkey = 3"), c.where("c_acctbal < 0"), steps).select("stem")


@query(f"SELECT film FROM ({FILMS}) WHERE width > height AND width >= 400 AND film NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)")
def host_films(spark, sf):
    used = table(spark, sf, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("film")).distinct()
    return selection.hosts(films(spark, sf), used, 400).select("film")


@query(f"""WITH b AS (SELECT DISTINCT film, shape, cls, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM ({BOXES})), q AS (SELECT cls, quantile_cont(area, 0.5) AS lo, quantile_cont(area, 0.9) AS hi FROM b GROUP BY cls),
n AS (SELECT DISTINCT a.film, a.shape FROM b a JOIN b c ON a.film = c.film AND a.shape <> c.shape AND c.x0 <= a.x1 + 6 AND c.x1 >= a.x0 - 6 AND c.y0 <= a.y1 + 6 AND c.y1 >= a.y0 - 6)
SELECT DISTINCT b.film, b.shape FROM b JOIN q USING (cls) WHERE area BETWEEN lo AND hi AND (b.film, b.shape) NOT IN (SELECT film, shape FROM n)""")
def isolated_sources(spark, sf):
    b = boxes(spark, sf).distinct().withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return selection.isolated_mid_sized(b, 6, by="cls").select("film", "shape").distinct()


@query(
    """SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'val' WHEN user_id % 10 = 1 THEN 'test' ELSE 'train' END AS part FROM events"""
)
def assign_parts(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("exposure"))
    users = e.select("exposure").distinct()
    return selection.assign_parts(e, users.where("exposure % 10 = 0"), users.where("exposure % 10 = 1")).select("event_id", "part")


@query(f"""WITH w AS (SELECT event_id, event_type, value > 60 AS pos FROM events), n AS (SELECT event_type, count(*) AS n FROM w WHERE pos GROUP BY 1)
SELECT event_id FROM w WHERE pos UNION ALL SELECT event_id FROM (SELECT event_id, n, row_number() OVER (PARTITION BY event_type ORDER BY {_DRAW.format('event_id')}) AS k FROM w JOIN n USING (event_type) WHERE NOT pos) WHERE k <= n""")
def segmentation_selection(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.array((F.col("value") > 60).cast("int")).alias("classes"))
    return selection.balanced_parts(rows, "event_type", 7, "event_id").select("event_id")


@query(f"""WITH t AS (SELECT film, x, y, side, concat(film, '__x', x, '__y', y, '__s', side) AS tile, (film + x) % 3 = 0 AS has_box FROM ({_FLUSH})), b AS ({BOXES}),
h AS (SELECT tile, has_box FROM t WHERE EXISTS (SELECT 1 FROM b WHERE cls = 'AF' AND b.film = t.film AND x0 >= x AND x0 < x + side AND y0 >= y AND y0 < y + side) AND NOT EXISTS (SELECT 1 FROM b WHERE cls = 'RF' AND b.film = t.film AND x0 >= x AND x0 < x + side AND y0 >= y AND y0 < y + side))
SELECT tile, CASE WHEN has_box THEN 'boxed' WHEN k <= 50 THEN 'holdout' ELSE 'null' END AS kind FROM (SELECT tile, has_box, row_number() OVER (PARTITION BY has_box ORDER BY {_DRAW.format('tile')}) AS k FROM h)""")
def null_tile_selection(spark, sf):
    t = tiles.enumerate_tiles(films(spark, sf), FRACTION, OVERLAP, "flush").select("film", "x", "y", "side")
    t = t.withColumn("tile", S.tile_id(F.col("film").cast("string"), F.col("x"), F.col("y"), F.col("side"))).withColumn("has_box", (F.col("film") + F.col("x")) % 3 == 0)
    p = boxes(spark, sf).select("film", "cls", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return selection.null_tiles(t, p.where("cls = 'AF'"), p.where("cls = 'RF'"), F.lit(50), 7).select("tile", "kind")


@query("SELECT n_regionkey::BIGINT AS source, count(*) AS n, count(*) FILTER (o IS NULL) AS missing FROM (SELECT n_regionkey, c_custkey, o_custkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey) GROUP BY 1")
def missing_by_source(spark, sf):
    n = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("source")))
    keys = table(spark, sf, "customer").join(n, "c_nationkey").select("source", F.col("c_custkey").alias("film"))
    stems = table(spark, sf, "customer").select(F.col("c_custkey").alias("film"), F.col("c_custkey").alias("stem"))
    inventory = table(spark, sf, "orders").select(F.col("o_custkey").alias("stem")).distinct()
    return selection.missing_by_source(selection.two_hop(keys, stems, inventory))


@query("SELECT tile, cls FROM (SELECT l_orderkey AS tile, l_returnflag || l_linestatus AS cls, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem) a WHERE EXISTS (SELECT 1 FROM (SELECT l_orderkey AS tile, l_partkey AS p, l_suppkey AS s, l_quantity + l_orderkey % 2 AS q FROM lineitem) b WHERE a.tile = b.tile AND a.p = b.p AND a.s = b.s AND a.q = b.q)")
def arm_pairs(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    base = [F.col("l_orderkey").alias("uid"), F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("top")]
    left = l.select(*base, F.col("l_quantity").alias("left"), F.concat("l_returnflag", "l_linestatus").alias("cls"))
    right = l.select(*base, (F.col("l_quantity") + F.col("l_orderkey") % 2).alias("left"))
    return selection.matched_pairs(left, right).select(F.col("uid").alias("tile"), "cls")


@query("SELECT o_orderkey AS tile_id, o_orderkey % 101 = 0 AS new, o_orderkey % 103 = 0 AS gone FROM orders WHERE (o_orderkey % 101 = 0 OR o_orderkey % 103 = 0 OR o_orderkey % 107 = 0) AND NOT (o_orderkey % 101 = 0 AND o_orderkey % 103 = 0)")
def label_changes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"), "o_orderpriority")
    stored = o.where("tile_id % 101 <> 0").select("tile_id", F.col("o_orderpriority").alias("label_text"))
    derived = o.where("tile_id % 103 <> 0").select("tile_id", F.concat("o_orderpriority", F.when(F.col("tile_id") % 107 == 0, " ").otherwise("")).alias("label_text"))
    return selection.label_changes(stored, derived)


# array-batched kernels


_ONE, _TWO = [9, 10, 17, 18], [44, 45, 46, 52, 53, 54]  # flat places of two components of an 8 x 8 mask
_RING_ONE, _RING_TWO = [1, 2, 8, 11, 16, 19, 25, 26], [36, 37, 38, 43, 47, 51, 55, 60, 61, 62]


@query(
    f"""SELECT vec_id::VARCHAR AS stem, k::BIGINT AS instance, round(CASE k WHEN 1 THEN list_avg(list_transform({_ONE}, lambda i: e[i + 1])) - list_avg(list_transform({_RING_ONE}, lambda i: e[i + 1]))
  ELSE list_avg(list_transform({_TWO}, lambda i: e[i + 1])) - list_avg(list_transform({_RING_TWO}, lambda i: e[i + 1])) END, 6) AS contrast FROM (SELECT vec_id, {_E} AS e, unnest([1, 2]) AS k FROM embeddings)"""
)
def instance_contrast(spark, sf):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.isin(_ONE + _TWO))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("stem"), F.lit(8).alias("height"), F.lit(8).alias("width"), _e().alias("pixels"), mask.alias("mask"))
    return film_ops.instance_contrasts(rows, least=2, ring=1).withColumn("contrast", F.round("contrast", 6))


_BEAD = "30000.0::DOUBLE + 20000.0::DOUBLE * greatest(0.0, 1.0::DOUBLE - pow((j - 150 - id % 200) / (40.0::DOUBLE + 3 * s), 2))"


@query(
    f"""WITH w AS (SELECT k, exp(-0.5::DOUBLE * (k / 6.0::DOUBLE) * (k / 6.0::DOUBLE)) AS w FROM (SELECT unnest(range(-24, 25)) AS k)),
t AS (SELECT i, k, w / (SELECT sum(w) FROM w) AS w, CASE WHEN i + k < 0 THEN -(i + k) WHEN i + k > 499 THEN 998 - (i + k) ELSE i + k END AS j FROM (SELECT unnest(range(0, 500)) AS i), w),
g AS (SELECT id, i, sum(w * ({_BEAD})) AS g FROM (SELECT p_partkey AS id, p_size AS s FROM part), t GROUP BY id, i),
m AS (SELECT id, quantile_cont(g, 0.05) AS dark, quantile_cont(g, 0.95) AS bright FROM g GROUP BY id),
r AS (SELECT id, min(i) AS first, max(i) AS last FROM g JOIN m USING (id) WHERE g > (dark + bright) / 2 AND bright > 0 AND bright - dark >= 0.03 * bright GROUP BY id),
k AS (SELECT *, (first + last) / 2.0::DOUBLE AS centre, (last - first) / 2.0::DOUBLE AS half FROM r WHERE last - first + 1 BETWEEN 40 AND 485 AND first > 0 AND last < 499 AND last - first >= 60)
SELECT p_partkey::VARCHAR AS stem, centre, half AS half_width, first AS top, last AS bottom FROM part LEFT JOIN k ON id = p_partkey"""
)
def bead_geometry(spark, sf):
    """A part as a film's row profile: a parabola, clear of the borders, whose place and width follow its key and size."""
    y, k, s = F.sequence(F.lit(0), F.lit(499)), F.col("p_partkey"), F.col("p_size")
    bead = F.transform(y, lambda v: 30000.0 + 20000.0 * F.greatest(F.lit(0.0), 1.0 - F.pow((v - 150 - k % 200) / (40.0 + 3 * s), F.lit(2.0))))
    return film_ops.beads(table(spark, sf, "part").select(k.cast("string").alias("stem"), bead.alias("profile")))
