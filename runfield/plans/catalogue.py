"""Every grid query with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runfield.functions import scalars
from runfield.operators import bitrows, boxes, components, features, relabel, rle, sweep, unify, validate
from runfield.operators.stored import StoredRuns
from runfield.plans import oracle as o
from runfield.plans import pipeline
from runfield.plans.growing import GrowingVolume
from runfield.sources import raw, volumes
from runfield.sources.shared import new_path, written
from runfield.sources.volumes import Dims, table
from runfield.streaming import rows as arriving

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return register


def activity_dims(spark: SparkSession, sf_dir: str) -> Dims:
    """Hours, days and users of the activity grid; the last two from the table."""
    user, day, _ = volumes.activity_place()
    last = table(spark, sf_dir, "events").select(user.alias("u"), day.alias("d")).where("u is not null and d >= 0").agg(F.max("d"), F.max("u")).first()
    return Dims(24, *(0 if x is None else int(x) + 1 for x in last))


def _activity_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.dense(volumes.activity(spark, sf_dir, distinct=False), activity_dims(spark, sf_dir))


def _ship_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(rle.segments(volumes.shipments(spark, sf_dir, distinct=False)), "segments")


def _ship_labelled(spark: SparkSession, sf_dir: str, strategy: str = "band") -> DataFrame:
    return pipeline.labelled_runs(volumes.shipments(spark, sf_dir, distinct=False), strategy)


def _activity_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(pipeline.labelled_runs(volumes.activity(spark, sf_dir, distinct=False)), "labelled")


# Sources and reshaping


@query("""SELECT CAST(vec_id AS INTEGER) AS slice, CAST(p // 8 AS INTEGER) AS "row", CAST(p % 8 AS INTEGER) AS col, CASE WHEN CAST(x AS DOUBLE) > 0.15 THEN 1 ELSE 0 END AS val
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS p FROM embeddings)""")
def src_from_array(spark, sf_dir):
    bits = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.15, 1).otherwise(0))
    return volumes.from_row_major(table(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits")), "bits", 8, "vec_id")


@query(o.vox(o.EV, 'SELECT slice, "row", col, CAST((slice * 7 + "row" * 5 + col * 3) % 256 AS INTEGER) AS val FROM grid', o.GRID))
def src_generate(spark, sf_dir):
    return volumes.generate(spark, activity_dims(spark, sf_dir), "cast((slice * 7 + row * 5 + col * 3) % 256 as int)")


@query(o.vox(o.EV, '''SELECT slice, "row", col, CASE WHEN ((((CAST(slice AS BIGINT) * (SELECT max("row") + 1 FROM vox) + "row") * 24 + col + 42) % 1048573 * 48271 + 11) % 2147483647) % 65521 * 48271 % 65521 < 16380 THEN 1 ELSE 0 END AS val FROM grid''', o.GRID))
def src_random(spark, sf_dir):
    return volumes.random_bits(spark, activity_dims(spark, sf_dir), seed=42, density=0.25)


@query(o.vox(o.EV, 'SELECT slice, "row", col, 7 AS val FROM grid', o.GRID))
def src_fill(spark, sf_dir):
    return volumes.fill(spark, activity_dims(spark, sf_dir), 7)


@query("""SELECT 0 AS slice, CAST(vec_id AS INTEGER) AS "row", CAST(p AS INTEGER) AS col, CASE WHEN vec_id BETWEEN 10 AND 200 AND p BETWEEN 5 AND 20 THEN 9 WHEN CAST(x AS DOUBLE) > 0.15 THEN 1 ELSE 0 END AS val
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS p FROM embeddings)""")
def src_fill_box(spark, sf_dir):
    each = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x"))
    image = each.select(F.lit(0).alias("slice"), F.col("vec_id").cast("int").alias("row"), "col", F.when(F.col("x").cast("double") > 0.15, 1).otherwise(0).alias("val"))
    return volumes.fill_box(image, 9, (0, 10, 5), (0, 200, 20))


@query(o.vox(o.EV, 'SELECT slice, "row", col, CASE WHEN slice BETWEEN 3 AND 40 AND "row" BETWEEN 2 AND 17 AND col BETWEEN 6 AND 11 THEN 5 ELSE val END AS val FROM dense', o.GRID, o.DENSE))
def src_fill_box3d(spark, sf_dir):
    return volumes.fill_box(_activity_dense(spark, sf_dir), 5, (3, 2, 6), (40, 17, 11))


@query(o.vox(o.EV, '''SELECT CAST(s AS INTEGER) AS slice, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN v.slice IS NULL THEN 0 ELSE 1 END AS val
FROM (SELECT unnest(range(0, (SELECT max(slice) + 3 FROM vox))) AS s), (SELECT unnest(range(0, (SELECT max("row") + 3 FROM vox))) AS r), (SELECT unnest(range(0, 26)) AS c)
LEFT JOIN vox v ON v.slice + 1 = s AND v."row" + 1 = r AND v.col + 1 = c'''))
def src_pad(spark, sf_dir):
    return volumes.pad(_activity_dense(spark, sf_dir), activity_dims(spark, sf_dir), 1)


@query(o.vox(o.SHIP, 'SELECT slice, col AS "row", "row" AS col FROM vox'))
def reshape_transpose(spark, sf_dir):
    return volumes.transpose(volumes.shipments(spark, sf_dir))


@query(o.vox(o.SHIP, 'SELECT CAST(max(col) + 1 AS INTEGER) AS width, CAST(max("row") + 1 AS INTEGER) AS height, CAST(max(slice) + 1 AS INTEGER) AS depth FROM vox'))
def meta_dims(spark, sf_dir):
    return volumes.dimensions(volumes.shipments(spark, sf_dir, distinct=False))


@query(o.vox(o.SHIP, 'SELECT slice, "row", col, (CAST(slice AS BIGINT) * (SELECT max("row") + 1 FROM vox) + "row") * (SELECT max(col) + 1 FROM vox) + col AS pos FROM vox'))
def meta_linear_index(spark, sf_dir):
    voxels = volumes.shipments(spark, sf_dir)
    return volumes.linear_index(voxels, volumes.dimensions(voxels))


@query(o.vox(o.EV, 'SELECT slice, "row", col FROM grid WHERE (slice * 7 + "row" * 5 + col * 3) % 256 % 2 = 1', o.GRID))
def pred_foreground(spark, sf_dir):
    return volumes.foreground(src_generate(spark, sf_dir))


# Scalars


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey = 0 THEN 0 ELSE ceil(sqrt(CAST(o_orderkey AS DOUBLE))) - 1 END AS BIGINT) AS r FROM orders")
def fn_isqrt(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.isqrt_below(F.col("o_orderkey")).alias("r"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * l_orderkey + l_suppkey * l_partkey AS BIGINT) AS two, CAST(l_linenumber * l_orderkey * 2 + l_suppkey * l_partkey * 3 AS BIGINT) AS three FROM lineitem")
def fn_dot(spark, sf_dir):
    a, b = F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey")), F.array("l_orderkey", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.dot(a, b).alias("two"), scalars.dot(a, b, F.expr("array(2L, 3L)")).alias("three"))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(least(nullif(l_suppkey % 3, 0), nullif(l_partkey % 4, 0), nullif(l_orderkey % 5, 0), nullif(l_linenumber % 2, 0)), 0) AS BIGINT) AS m FROM lineitem")
def fn_minp(spark, sf_dir):
    values = [F.col("l_suppkey") % 3, F.col("l_partkey") % 4, F.col("l_orderkey") % 5, (F.col("l_linenumber") % 2).cast("long")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.least_positive(*values).alias("m"))


@query("SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi FROM lineitem")
def fn_minmax(spark, sf_dir):
    lo, hi = scalars.ordered_pair(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lo.alias("lo"), hi.alias("hi"))


@query("SELECT o_custkey, unnest(range(0, count(*))) AS i FROM orders GROUP BY o_custkey")
def fn_iota(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").count()
    return sizes.select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))


@query("SELECT o_orderkey, CAST((o_orderkey + 1 + 63) // 64 * 64 AS BIGINT) AS up FROM orders")
def fn_round_up(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.round_up(F.col("o_orderkey") + 1, F.lit(64)).alias("up"))


@query("""WITH d AS (SELECT event_type, t, CAST(count(CASE WHEN value > t THEN 1 END) AS DOUBLE) / count(*) AS density FROM events, (SELECT unnest(range(0, 200, 5)) AS t) GROUP BY event_type, t)
SELECT event_type, CAST(t AS INTEGER) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(density - 0.5), t) AS k FROM d) WHERE k = 1""")
def fn_find_closest(spark, sf_dir):
    return sweep.nearest(sweep.of_steps(table(spark, sf_dir, "events"), "event_type", "value", 5, 40), "event_type", 0.5)


@query("""WITH c AS (SELECT event_type, value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type, value),
d AS (SELECT event_type, value, CAST(sum(n) OVER (PARTITION BY event_type) - sum(n) OVER (PARTITION BY event_type ORDER BY value) AS DOUBLE) / sum(n) OVER (PARTITION BY event_type) AS density FROM c)
SELECT event_type, value AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(density - 0.25), value) AS k FROM d) WHERE k = 1""")
def fn_find_closest_value(spark, sf_dir):
    # thresholds are the values of the table
    return sweep.nearest(sweep.of_values(table(spark, sf_dir, "events"), "event_type", "value"), "event_type", 0.25)


# Raw volumes


@query(o.vox(o.EV, 'SELECT slice, "row", col, val FROM dense', o.GRID, o.DENSE))
def src_raw_volume(spark, sf_dir):
    # written as bytes, in stripes that are smaller than a slice, and read again
    voxels, dims = volumes.activity(spark, sf_dir), activity_dims(spark, sf_dir)
    path = new_path(spark, "raw-volume")
    raw.write_volume(voxels.withColumn("val", F.lit(1)), path, dims, stripe=max(1, dims.height // 3))
    return raw.read_volume(spark, path)


# Run-length encoding


@query(o.vox(o.SHIP, 'SELECT slice, "row", x0, x1 FROM run', o.RUNS))
def rle_packed(spark, sf_dir):
    return bitrows.runs(bitrows.packed(volumes.shipments(spark, sf_dir, distinct=False)))


@query(o.vox(o.EMB, 'SELECT slice, "row", count(*) AS n FROM vox GROUP BY slice, "row"'))
def seg_count_packed(spark, sf_dir):
    return bitrows.volumes(bitrows.packed(volumes.embedding_bits(spark, sf_dir)))


@query(o.vox(o.EV, 'SELECT slice, "row", col, val, edge FROM edges', o.GRID, o.DENSE, o.EDGES))
def rle_edges(spark, sf_dir):
    return rle.edges(_activity_dense(spark, sf_dir))


@query(o.vox(o.SHIP, 'SELECT slice, "row", x0, x1 FROM run', o.RUNS))
def rle_halfopen(spark, sf_dir):
    return rle.runs(volumes.shipments(spark, sf_dir, distinct=False))


@query(o.vox(o.SHIP, 'SELECT slice, "row", x0, CAST(x1 - 1 AS INTEGER) AS x1 FROM run', o.RUNS))
def rle_closed(spark, sf_dir):
    return rle.closed(rle.runs(volumes.shipments(spark, sf_dir, distinct=False)))


@query(o.vox(o.EV, 'SELECT slice, "row", col, val, CAST(sum(edge) OVER (PARTITION BY slice, "row" ORDER BY col) AS BIGINT) AS er FROM edges', o.GRID, o.DENSE, o.EDGES))
def rle_er(spark, sf_dir):
    return rle.relative_labels(_activity_dense(spark, sf_dir))


@query(o.vox(o.SHIP, '''SELECT * FROM (SELECT slice, "row", coalesce(lag(x1) OVER (PARTITION BY slice, "row" ORDER BY x0), 0) AS x0, x0 AS x1 FROM run
UNION ALL SELECT slice, "row", max(x1), 31 FROM run GROUP BY slice, "row") WHERE x0 < x1''', o.RUNS))
def seg_gaps(spark, sf_dir):
    return rle.gaps(rle.runs(volumes.shipments(spark, sf_dir, distinct=False)), 31)


@query(o.vox(o.SHIP, 'SELECT slice, "row", CAST(greatest(x0 - 1, 0) AS INTEGER) AS x0, CAST(least(x1, 30) AS INTEGER) AS x1 FROM run', o.RUNS))
def seg_widen(spark, sf_dir):
    return rle.widened(rle.closed(rle.runs(volumes.shipments(spark, sf_dir, distinct=False))), 31)


@query(o.vox(o.SHIP, 'SELECT slice, "row", count(*) AS n FROM vox GROUP BY slice, "row"'))
def seg_count_foreground(spark, sf_dir):
    return rle.foreground_counts(rle.runs(volumes.shipments(spark, sf_dir, distinct=False)))


@query(o.seg(o.SHIP, 'SELECT slice, "row", seg, x0, x1, seg_id FROM seg'))
def seg_ids(spark, sf_dir):
    return rle.segments(volumes.shipments(spark, sf_dir, distinct=False))


# Contacts


@query(o.contacts(o.SHIP, "SELECT a, b FROM contacts"))
def unify_contacts(spark, sf_dir):
    return unify.contacts(_ship_segments(spark, sf_dir))


@query(o.contacts(o.SHIP, "SELECT a, b FROM contacts"))
def unify_contacts_stored(spark, sf_dir):
    return StoredRuns.store(_ship_segments(spark, sf_dir), buckets=16).contacts()


@query(o.contacts(o.EV, "SELECT a, b FROM contacts"))
def unify_contacts_er(spark, sf_dir):
    voxels, dims = volumes.activity(spark, sf_dir, distinct=False), activity_dims(spark, sf_dir)
    return unify.contacts_by_position(written(rle.segments(voxels), "segments"), rle.relative_labels(pipeline.dense(voxels, dims)))


@query(o.contacts(o.SHIP, "SELECT seg_id, (SELECT min(b) FROM contacts c WHERE c.a = seg_id AND dz = 0) AS label FROM seg"))
def unify_first(spark, sf_dir):
    return unify.first_labels(_ship_segments(spark, sf_dir))


@query(o.contacts(o.SHIP, "SELECT a, b FROM contacts WHERE dz = -1 AND dy < 1"))
def unify_transitive(spark, sf_dir):
    return unify.contacts(_ship_segments(spark, sf_dir), [unify.BACK, unify.BACK_ABOVE])


@query(o.contacts(o.SHIP, "SELECT seg_id FROM seg WHERE seg_id NOT IN (SELECT a FROM contacts)"))
def unify_new_labels(spark, sf_dir):
    return unify.new_labels(_ship_segments(spark, sf_dir))


@query(o.contacts(o.SHIP, "SELECT seg_id FROM seg WHERE seg_id NOT IN (SELECT a FROM contacts WHERE dz = 0)"))
def unify_new_labels_bis(spark, sf_dir):
    return unify.new_labels(_ship_segments(spark, sf_dir), [unify.ABOVE])


@query(o.vox(o.SHIP, '''SELECT slice, "row", CAST(line AS INTEGER) AS line, min(x0) AS x0, max(x1) AS x1 FROM (
SELECT *, sum(start) OVER (PARTITION BY slice, "row" ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) - 1 AS line FROM (
SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY slice, "row" ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS start
FROM (SELECT slice, "row", x0, x1 FROM run UNION SELECT CAST(slice + 1 AS INTEGER), "row", x0, x1 FROM run))) GROUP BY slice, "row", line''', o.RUNS))
def seg_double_line(spark, sf_dir):
    return unify.double_lines(rle.runs(volumes.shipments(spark, sf_dir, distinct=False)))


@query(o.labels(o.SHIP, "SELECT seg_id, label FROM labelled"))
def unify_double(spark, sf_dir):
    return _ship_labelled(spark, sf_dir, "double").select("seg_id", "label")


@query(o.contacts(o.SHIP, 'SELECT slice, "row", dz, dy, count(*) AS n FROM contacts GROUP BY slice, "row", dz, dy'))
def unify_count_intersections(spark, sf_dir):
    return unify.contact_counts(_ship_segments(spark, sf_dir))


@query(o.contacts(o.SHIP, '''SELECT (SELECT count(*) FROM seg) AS runs, count(*) AS contacts, count(DISTINCT a) AS inherits, count(*) - count(DISTINCT a) AS unions,
(SELECT count(*) FROM seg) - count(DISTINCT a) AS new_labels FROM contacts'''))
def unify_stats(spark, sf_dir):
    return unify.statistics(_ship_segments(spark, sf_dir))


# Components


@query(o.labels(o.SHIP, "SELECT seg_id, root FROM labelled"))
def ccl_roots(spark, sf_dir):
    seg = _ship_segments(spark, sf_dir)
    return components.roots(seg.select("seg_id"), unify.contacts(seg)).select("seg_id", "root")


@query(o.labels(o.SHIP, 'SELECT slice, "row", seg, seg_id, label FROM labelled'))
def ccl_segment_labels(spark, sf_dir):
    return _ship_labelled(spark, sf_dir).select("slice", "row", "seg", "seg_id", "label")


@query(o.labels(o.SHIP, "SELECT count(DISTINCT root) AS n FROM labelled"))
def ccl_count(spark, sf_dir):
    return _ship_labelled(spark, sf_dir).agg(F.count(F.when(F.col("seg_id") == F.col("root"), 1)).alias("n"))


@query(o.contacts(o.SHIP, "SELECT a, b FROM contacts WHERE dz = -1 AND slice % 8 = 0"))
def reduce_boundary_contacts(spark, sf_dir):
    return components.slab_labels(_ship_segments(spark, sf_dir), 8)[1]


@query(o.labels(o.SHIP, '''SELECT s.seg_id, s.slab_root, l.root FROM (SELECT n AS seg_id, min(m) AS slab_root FROM slab_reach GROUP BY n) s JOIN labelled l USING (seg_id)''',
    '''slab_e AS (SELECT a, b FROM contacts WHERE NOT (dz = -1 AND slice % 8 = 0) UNION ALL SELECT b, a FROM contacts WHERE NOT (dz = -1 AND slice % 8 = 0)),
slab_reach(n, m) AS (SELECT seg_id, seg_id FROM seg UNION SELECT e.a, r.m FROM slab_reach r JOIN slab_e e ON e.b = r.n WHERE r.m < e.a)'''))  # fmt: skip
def reduce_slab_labels(spark, sf_dir):
    return components.reduced(*components.slab_labels(_ship_segments(spark, sf_dir), 8)).select("seg_id", "slab_root", "root")


@query(o.labels(o.SHIP, "SELECT seg_id, label FROM labelled"))
def reduce_slab_depth(spark, sf_dir):
    return pipeline.labelled_runs(volumes.shipments(spark, sf_dir, distinct=False), "slab", slices=3).select("seg_id", "label")


# Label images


@query(o.cells(o.SHIP, 'SELECT slice, "row", col, label FROM cells'))
def ccl_labels(spark, sf_dir):
    return relabel.label_cells(_ship_labelled(spark, sf_dir))


@query(o.cells(o.EV, 'SELECT g.slice, g."row", g.col, coalesce(c.label, 0) AS label FROM grid g LEFT JOIN cells c ON g.slice = c.slice AND g."row" = c."row" AND g.col = c.col', o.GRID))
def ccl_label_image_dense(spark, sf_dir):
    return relabel.dense_labels(_activity_labelled(spark, sf_dir), activity_dims(spark, sf_dir))


@query(o.cells(o.EMB, 'SELECT slice, "row", col, label FROM cells'))
def ccl_labels_2d(spark, sf_dir):
    return pipeline.label_image(volumes.embedding_bits(spark, sf_dir))


@query(o.cells(o.EV, 'SELECT slice, "row", col, label FROM cells'))
def ccl_labels_pixel(spark, sf_dir):
    er = rle.relative_labels(_activity_dense(spark, sf_dir))
    return relabel.labels_by_position(er, _activity_labelled(spark, sf_dir))


@query(o.cells("""vox AS (SELECT CAST(user_id AS INTEGER) AS slice, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS "row", CAST(hour(ts) AS INTEGER) AS col
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND CAST(ts AS DATE) >= DATE '2024-01-01' GROUP BY 1, 2, 3 HAVING count(*) * 85 % 256 % 2 = 1)""", 'SELECT slice, "row", col, label FROM cells'))
def ccl_labels_values(spark, sf_dir):
    # grey values by the number of events, 85 and 255 odd, 170 even: the lowest bit decides
    user, day, hour = volumes.activity_place()
    places = table(spark, sf_dir, "events").select(user.alias("slice"), day.alias("row"), hour.alias("col")).where("slice is not null and row >= 0")
    values = places.groupBy("slice", "row", "col").agg((F.count("*") * 85 % 256).cast("int").alias("val"))
    return pipeline.label_image(volumes.foreground(values))


@query(o.labels(o.SHIP, """SELECT DISTINCT label, CAST((label % 1048573 * 48271 + 12345) % 65521 % 201 + 55 AS INTEGER) AS r, CAST((label % 1048573 * 40692 + 12345) % 65521 % 201 + 55 AS INTEGER) AS g,
CAST((label % 1048573 * 69621 + 12345) % 65521 % 201 + 55 AS INTEGER) AS b FROM labelled"""))
def label_palette(spark, sf_dir):
    return relabel.palette(_ship_labelled(spark, sf_dir))


@query(o.cells(o.EV, """SELECT label, count(*) AS n FROM cells GROUP BY label UNION ALL SELECT 0, (SELECT (max(slice) + 1) * (max("row") + 1) * 24 FROM vox) - (SELECT count(*) FROM vox)"""))
def label_histogram(spark, sf_dir):
    return relabel.histogram(relabel.label_cells(_activity_labelled(spark, sf_dir)), activity_dims(spark, sf_dir))


# Features

_FLAT = 'SELECT slice, label, "S", "Sx", "Sy", lo_col, lo_row, hi_col, CAST(hi_row - 1 AS INTEGER) AS hi_row FROM ('


@query(o.labels(o.SHIP, o.features("labelled")))
def cca_features(spark, sf_dir):
    return pipeline.component_features(volumes.shipments(spark, sf_dir, distinct=False))


@query(o.labels(o.SHIP, 'SELECT label, "S", lo_col, lo_row, lo_slice, hi_col, hi_row, hi_slice FROM (' + o.features("labelled") + ")"))
def cca_features_chosen(spark, sf_dir):
    return pipeline.component_features(volumes.shipments(spark, sf_dir, distinct=False), features.FeatureConfig(moments=False))


@query(o.labels(o.EV, o.features("labelled")))
def cca_features_activity(spark, sf_dir):
    return pipeline.component_features(volumes.activity(spark, sf_dir, distinct=False), strategy="slab")


@query(o.labels(o.EMB, _FLAT + o.features("labelled", "slice, label") + ")"))
def cca_features_2d(spark, sf_dir):
    return features.of_runs_2d(pipeline.labelled_runs(volumes.embedding_bits(spark, sf_dir)))


@query(o.labels(o.SHIP, o.features('(SELECT * FROM labelled WHERE slice BETWEEN 2 AND 60 AND "row" BETWEEN 10 AND 70 AND label >= 5 AND label < 4000)')))
def cca_features_box(spark, sf_dir):
    return features.in_box(_ship_labelled(spark, sf_dir), (2, 60), (10, 70), (5, 4000))


#: For each order a box: from a slice and a row named by its keys, up to 6 slices and 9 rows; every 40th up to 46 rows.
_BOXES = """boxes AS (SELECT o_orderkey AS box, o_custkey % {depth} AS z0, o_custkey % {depth} + o_custkey % 6 AS z1, o_orderkey % 84 AS y0, o_orderkey % 84 + o_orderkey % 9 + CASE WHEN o_orderkey % 40 = 0 THEN 37 ELSE 0 END AS y1,
  o_custkey % 20 AS x0, o_custkey % 20 + o_orderkey % 11 AS x1, o_orderkey % 50 AS expected FROM {orders})"""
_SHIP_DEPTH = "(SELECT max(slice) + 1 FROM vox)"


def _order_boxes(spark: SparkSession, sf_dir: str, voxels: DataFrame) -> DataFrame:
    depth = voxels.agg(F.max("slice") + 1).first()[0] or 1
    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null and o_custkey is not null")
    spans = "o_orderkey % 9 + case when o_orderkey % 40 = 0 then 37 else 0 end"
    return orders.selectExpr(
        "o_orderkey AS box", f"o_custkey % {depth} AS z0", f"o_custkey % {depth} + o_custkey % 6 AS z1", "o_orderkey % 84 AS y0", f"o_orderkey % 84 + {spans} AS y1",
        "o_custkey % 20 AS x0", "o_custkey % 20 + o_orderkey % 11 AS x1", "o_orderkey % 50 AS expected",
    )


@query(o.labels(o.SHIP, o.features('labelled JOIN boxes ON slice BETWEEN z0 AND z1 AND "row" BETWEEN y0 AND y1', "box, label").replace("x0", "labelled.x0").replace("x1", "labelled.x1"), _BOXES.format(depth=_SHIP_DEPTH, orders="orders")))
def cca_features_boxes(spark, sf_dir):
    voxels = volumes.shipments(spark, sf_dir, distinct=False)
    return boxes.in_boxes(written(pipeline.labelled_runs(voxels), "labelled"), _order_boxes(spark, sf_dir, voxels))


@query(o.labels(o.SHIP, """SELECT box, (SELECT coalesce(bool_and(label = expected), true) FROM labelled l WHERE slice BETWEEN z0 AND z1 AND "row" BETWEEN y0 AND y1 AND l.x0 <= b.x1 AND l.x1 > b.x0) AS ok FROM boxes b""", _BOXES.format(depth=_SHIP_DEPTH, orders="orders")))
def label_test_areas(spark, sf_dir):
    voxels = volumes.shipments(spark, sf_dir, distinct=False)
    return boxes.areas_have(written(pipeline.labelled_runs(voxels), "labelled"), _order_boxes(spark, sf_dir, voxels))


@query(o.labels(o.SHIP, o.features("labelled")))
def cca_features_growing(spark, sf_dir):
    # the volume is added slab by slab
    voxels = volumes.shipments(spark, sf_dir, distinct=False)
    depth = voxels.agg(F.max("slice") + 1).first()[0] or 1
    slices = -(-depth // 5)
    path = new_path(spark, "by-slab")
    voxels.withColumn("slab", F.expr(f"slice div {slices}")).write.partitionBy("slab").parquet(path)
    cells = spark.read.schema("slice int, row int, col int, slab int").parquet(path)
    volume = GrowingVolume(spark, new_path(spark, "growing"), slices)
    for slab in range(-(-depth // slices)):
        volume.add(slab, cells.where(F.col("slab") == slab).drop("slab"))
    return volume.features()


@query(o.labels(o.EV, o.features("labelled")))
def cca_features_stream(spark, sf_dir):
    # days arrive in four portions; the state of a slab of users goes from one to the next
    voxels, dims = volumes.activity(spark, sf_dir, distinct=False), activity_dims(spark, sf_dir)
    cells = written(arriving.dealt(voxels), "dealt-cells")
    source, sink, state = (new_path(spark, f"rows-{k}") for k in ("source", "sink", "state"))
    days = -(-max(dims.height, 1) // 4)
    for k in range(4):
        portion = cells.where(F.col("row").between(k * days, (k + 1) * days - 1))
        if k == 3:
            portion = portion.unionByName(arriving.endings(cells, dims.height + 1))
        portion.write.mode("append").parquet(source)
        arriving.advanced(spark, source, sink, state)
    return arriving.features_of(written(spark.read.schema(arriving.OUTPUT).parquet(sink), "stream-output"))


@query(o.labels(o.SHIP, o.features("labelled", 'slice, "row", label')))
def cca_features_rows(spark, sf_dir):
    return features.by_row(_ship_labelled(spark, sf_dir))


@query(o.labels(o.SHIP, o.features("labelled")))
def cca_features_points(spark, sf_dir):
    return features.of_cells(relabel.label_cells(_ship_labelled(spark, sf_dir)))


@query(o.labels(o.EMB, _FLAT + o.features("labelled", "slice, label") + ")"))
def cca_features_points_2d(spark, sf_dir):
    return features.of_cells_2d(pipeline.label_image(volumes.embedding_bits(spark, sf_dir)))


@query(o.labels(o.SHIP, o.features("labelled", "root", "root AS label")))
def cca_features_merge(spark, sf_dir):
    # features of slabs' components, folded together over the boundary
    seg = _ship_segments(spark, sf_dir)
    both = written(components.reduced(*components.slab_labels(seg, 8)), "reduced")
    partial = features.of_runs(seg.join(both.select("seg_id", F.col("slab_root").alias("label")), "seg_id"))
    return features.merged(partial, both.select(F.col("slab_root").alias("label"), F.col("root").alias("into")).distinct())


@query(o.labels(o.SHIP, 'SELECT (SELECT max(label) FROM labelled) + 1 - label AS label, * EXCLUDE (label) FROM (' + o.features("labelled") + ")"))
def cca_normalize(spark, sf_dir):
    found = written(pipeline.component_features(volumes.shipments(spark, sf_dir, distinct=False)), "features")
    top = found.agg(F.max("label").alias("top"))
    names = found.select(F.col("label").alias("src")).crossJoin(F.broadcast(top)).select("src", (F.col("top") + 1 - F.col("src")).alias("dst"))
    return features.normalized(found, names)


@query(o.labels(o.SHIP, "SELECT count(*) > 0 AS equal, CAST(0 AS BIGINT) AS n_differing FROM labelled"))
def cca_equals(spark, sf_dir):
    seg = _ship_segments(spark, sf_dir)
    return features.equal(*(features.of_runs(pipeline.labelled_segments(seg, strategy)) for strategy in ("band", "double")))


@query(o.labels(o.SHIP, "SELECT count(*) = 0 AS equal, count(*) AS n_differing FROM (SELECT DISTINCT label FROM labelled) WHERE label % 7 = 0 OR label % 10 = 3"))
def cca_equals_changed(spark, sf_dir):
    # a seventh of the components with another volume, a tenth missing
    found = written(pipeline.component_features(volumes.shipments(spark, sf_dir, distinct=False)), "features")
    return features.equal(found, found.where("label % 10 <> 3").withColumn("S", F.when(F.col("label") % 7 == 0, F.col("S") + 1).otherwise(F.col("S"))))


@query(o.labels(o.SHIP, 'SELECT label, CAST("Sx" AS DOUBLE) / "S" AS cx, CAST("Sy" AS DOUBLE) / "S" AS cy, CAST("Sz" AS DOUBLE) / "S" AS cz FROM (' + o.features("labelled") + ")"))
def cca_centroid(spark, sf_dir):
    return features.centroids(pipeline.component_features(volumes.shipments(spark, sf_dir, distinct=False)))


# Comparisons and text


@query(o.cells(o.EV, "SELECT count(*) > 0 AS equal, CAST(0 AS BIGINT) AS n_differing FROM cells"))
def mat_compare(spark, sf_dir):
    seg = written(rle.segments(volumes.activity(spark, sf_dir, distinct=False)), "segments")
    band = pipeline.labelled_segments(seg)
    position = pipeline.labelled_segments(seg, "position", activity_dims(spark, sf_dir))
    return validate.compared(relabel.label_cells(band), relabel.label_cells(position))


@query(o.cells(o.EV, "SELECT count(*) = 0 AS equal, count(*) AS n_differing FROM cells WHERE label >= 5 OR col = 3"))
def mat_compare_changed(spark, sf_dir):
    # labels from the fifth on are one greater, and one hour is missing
    cells = written(relabel.label_cells(_activity_labelled(spark, sf_dir)), "cells")
    return validate.compared(cells, cells.where("col <> 3").withColumn("label", F.when(F.col("label") >= 5, F.col("label") + 1).otherwise(F.col("label"))))


@query(o.cells(o.EV, '''SELECT slice, "row", col, l.label AS "left", r.label AS "right" FROM cells l FULL JOIN turned r USING (slice, "row", col) WHERE l.label IS DISTINCT FROM r.label''',
    'turned AS (SELECT CAST((SELECT max(slice) FROM vox) - slice AS INTEGER) AS slice, "row", col, label FROM cells)'))
def mat_diff(spark, sf_dir):
    cells = written(relabel.label_cells(_activity_labelled(spark, sf_dir)), "cells")
    last = activity_dims(spark, sf_dir).depth - 1
    return validate.differences(cells, cells.withColumn("slice", F.lit(last) - F.col("slice")))


@query(o.cells(o.EV, 'SELECT slice, "row", col, label AS "left", label + 1 AS "right" FROM cells WHERE slice % 37 = 5 AND col = 3'))
def mat_diff_tiles(spark, sf_dir):
    # an image with a few changed cells; only their tiles are joined by cell
    cells = written(relabel.label_cells(_activity_labelled(spark, sf_dir)), "cells")
    return validate.differences_by_tiles(cells, cells.withColumn("label", F.when((F.col("slice") % 37 == 5) & (F.col("col") == 3), F.col("label") + 1).otherwise(F.col("label"))), 16)


@query(o.cells(o.SHIP, 'SELECT coalesce(bool_and(label = 1), true) AS ok FROM cells WHERE slice BETWEEN 0 AND 3 AND "row" BETWEEN 0 AND 5'))
def label_test_area(spark, sf_dir):
    return validate.area_has(relabel.label_cells(_ship_labelled(spark, sf_dir)), (0, 0, 0), (3, 5, 30), 1)


@query(o.cells(o.EV, '''SELECT g.slice, g."row", string_agg(lpad(CAST(coalesce(c.label, 0) AS VARCHAR), 6, ' '), ' ' ORDER BY g.col) AS line
FROM grid g LEFT JOIN cells c ON g.slice = c.slice AND g."row" = c."row" AND g.col = c.col GROUP BY g.slice, g."row"''', o.GRID))
def sink_render_rows(spark, sf_dir):
    return relabel.rendered(relabel.dense_labels(_activity_labelled(spark, sf_dir), activity_dims(spark, sf_dir)), 6)
