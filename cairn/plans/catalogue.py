"""Queries over the operators, one each or nearly, and their SQL for DuckDB.

Averages, medians and distances are cut to some places on both sides, as the order of a floating
sum is not fixed; counts, extremes, ids and labels are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import Dbscan, Labeling, Ransac, RegionGrowing
from cairn.functions.colours import LABEL_COLOURS, MAP_COLOURS, colorize
from cairn.functions.geometry import plane_distance, vector
from cairn.functions.lineage import shared_dir, stash
from cairn.operators import dbscan as density
from cairn.operators import evaluate as scores
from cairn.operators import labels, neighbours, normals, objects, outliers, ransac, region_growing, stats, summaries, voxel
from cairn.plans import geometry_sql as geo
from cairn.plans import views
from cairn.sinks import writers
from cairn.sources import synthetic, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VOXEL, LAYER, HEIGHT = 0.23, 0.3, 3.0
EPS, MIN_POINTS, K, RADIUS = 0.05, 5, 5, 0.08
RULES = Labeling()


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Added before cutting off: the views' values are short decimals, whose means are often
#: half way between two roundings, but never near this.
SHIFT = 0.1234567


def near(c: str | Column, places: int = 6) -> Column:
    """Cut to so many places."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * F.lit(float(10**places)) + F.lit(SHIFT)) / F.lit(float(10**places))


def _flat(name: str, out: tuple[str, ...], places: int | None = None) -> list[Column]:
    return [(near(F.col(name)[k], places) if places else F.col(name)[k]).alias(o) for k, o in enumerate(out)]


def _round(expr: str, places: int = 6) -> str:
    return f"floor(({expr}) * 1e{places}::DOUBLE + {SHIFT}::DOUBLE) / 1e{places}::DOUBLE"


# ---- statistics, floor, voxels

_BOX_SQL = ("count(*) AS n_points, false AS has_colors, false AS has_normals, " + ", ".join(
    f"min({c}) AS {c}_min, max({c}) AS {c}_max, max({c}) - min({c}) AS d{c}, {_round(f'avg({c})')} AS c{c}" for c in "xyz"))


def _stat_columns() -> list[Column]:
    return ["n_points", "has_colors", "has_normals", *_flat("bbox_min", ("x_min", "y_min", "z_min")), *_flat("bbox_max", ("x_max", "y_max", "z_max")),
            *_flat("scene_dims", ("dx", "dy", "dz")), *_flat("centroid", ("cx", "cy", "cz"), 6)]


@query(f"{views.with_views('room')} SELECT {_BOX_SQL} FROM room")
def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.total_stats(views.room(spark, sf_dir)).select(*_stat_columns())


@query(f"{views.with_views('room')} SELECT l_returnflag AS scene_id, {_BOX_SQL} FROM room GROUP BY l_returnflag")
def scene_stats_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scene_stats(views.room(spark, sf_dir, "l_returnflag")).select("scene_id", *_stat_columns())


@query(f"{views.with_views('room')} SELECT l_returnflag AS scene_id, max(z) - min(z) AS scene_height, "
       f"{_round('quantile_cont(z, 0.05)', 9)} AS z_floor FROM room GROUP BY l_returnflag")
def scene_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = views.room(spark, sf_dir, "l_returnflag")
    return stats.scene_height(room).join(stats.floor_height(room), "scene_id").select("scene_id", "scene_height", near("z_floor", 9).alias("z_floor"))


@query(f"{views.with_views('room')} SELECT point_id, x, y, {_round('z - (SELECT quantile_cont(z, 0.05) FROM room)', 9)} AS z FROM room")
def normalize_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalize_floor(views.room(spark, sf_dir)).select("point_id", "x", "y", near("z", 9).alias("z"))


_VOXELS = f"voxels AS (SELECT floor((x - x0) / {VOXEL}::DOUBLE)::BIGINT AS vx, floor((y - y0) / {VOXEL}::DOUBLE)::BIGINT AS vy, " \
          f"floor((z - z0) / {VOXEL}::DOUBLE)::BIGINT AS vz, min(point_id) AS point_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n_members " \
          "FROM room, (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM room) GROUP BY 1, 2, 3)"


@query(f"{views.with_views('room')}, {_VOXELS} SELECT vx, vy, vz, point_id, n_members, {_round('x')} AS x, {_round('y')} AS y, {_round('z')} AS z FROM voxels"
       )
def voxel_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voxel.voxel_downsample(views.room(spark, sf_dir), VOXEL)
    return found.select("vx", "vy", "vz", "point_id", "n_members", *[near(c).alias(c) for c in "xyz"])


# ---- planes

def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.room(spark, sf_dir).withColumn("plane_id", F.round(F.col("z") / LAYER).cast("int"))


@query(f"{views.with_views('room')} SELECT round(z / {LAYER}::DOUBLE)::INTEGER AS plane_id, count(*) AS inlier_count, {_round('median(z)')} AS centroid_z FROM room GROUP BY 1")
def plane_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.plane_summary(_layers(spark, sf_dir)).select("plane_id", "inlier_count", near("centroid_z").alias("centroid_z"))


def _plane_sql(nx: str, ny: str, nz: str, z: str, height: str) -> str:
    size = f"sqrt({nx}*{nx} + {ny}*{ny} + {nz}*{nz})"
    tilt = f"degrees(acos(least(abs({nz}) / {size}, 1.0::DOUBLE)))"
    return (f"CASE WHEN {size} < 1e-9 THEN 'unknown' WHEN {tilt} < {RULES.horizontal_angle_deg} THEN CASE WHEN {z} < {RULES.floor_z_threshold} THEN 'floor' "
            f"WHEN {z} > greatest({height}, 0.1::DOUBLE) * {RULES.ceiling_z_fraction}::DOUBLE THEN 'ceiling' ELSE 'horizontal_surface' END "
            f"WHEN {tilt} > {RULES.vertical_angle_deg} THEN 'wall' ELSE 'unknown' END")


@query(f"{views.with_views('embedded_planes')} SELECT plane_id, {_plane_sql('nx', 'ny', 'nz', 'centroid_z', f'{HEIGHT}::DOUBLE')} AS label FROM embedded_planes")
def plane_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_planes(views.embedded_planes(spark, sf_dir), HEIGHT).select("plane_id", "label")


@query(f"{views.with_views('room')}, moved AS (SELECT point_id, x, y, z - (SELECT quantile_cont(z, 0.05) FROM room) AS z FROM room), "
       f"{_VOXELS.replace('FROM room', 'FROM moved')}, layers AS (SELECT round(z / {LAYER}::DOUBLE)::INTEGER AS plane_id, "
       f"count(*) AS inlier_count, median(z) AS centroid_z FROM voxels GROUP BY 1) SELECT plane_id, inlier_count, {_round('centroid_z')} AS centroid_z, "
       f"{_plane_sql('0.0::DOUBLE', '0.0::DOUBLE', '1.0::DOUBLE', 'centroid_z', '(SELECT max(z) - min(z) FROM voxels)')} AS label FROM layers")
def plane_labels_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor to 0, voxels, a plane for each layer, labels."""
    small = voxel.voxel_downsample(stats.normalize_floor(views.room(spark, sf_dir)), VOXEL)
    layers = summaries.plane_summary(small.withColumn("plane_id", F.round(F.col("z") / LAYER).cast("int")))
    flat = layers.withColumn("normal", vector(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    found = labels.label_planes(flat, stats.scene_height(small))
    return found.select("plane_id", "inlier_count", near("centroid_z").alias("centroid_z"), "label")


# ---- objects

_DIMS = ("w", "d", "h")


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, n_points, x0, y0, x1, y1, z_min, z_max, w, d, h, footprint_m2, "
       f"{_round('cx')} AS cx, {_round('cy')} AS cy, {_round('cz')} AS cz FROM objects")
def object_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.cluster_summary(views.room(spark, sf_dir).withColumnRenamed("l_orderkey", "cluster_id"))
    return found.select("cluster_id", "n_points", *_flat("aabb_min", ("x0", "y0")), *_flat("aabb_max", ("x1", "y1")), "z_min", "z_max", *_flat("dims", _DIMS),
                        "footprint_m2", *_flat("centroid", ("cx", "cy", "cz"), 6))


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, n_points FROM objects WHERE n_points >= 3 AND w <= 3.0 AND d <= 3.0 AND h <= 3.0")
def object_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.small_enough(summaries.large_enough(views.objects(spark, sf_dir), 3), 3.0).select("cluster_id", "n_points")


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, n_points FROM objects ORDER BY n_points DESC, cluster_id LIMIT 100")
def object_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred largest objects (a top-k report)."""
    return summaries.by_size(views.objects(spark, sf_dir)).select("cluster_id", "n_points").limit(100)


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, n_points, row_number() OVER (ORDER BY n_points DESC, cluster_id) AS rank FROM objects")
def object_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects with their rank by size, ties to the smaller id."""
    return summaries.ranked_by_size(views.objects(spark, sf_dir)).select("cluster_id", "n_points", "rank")


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, x0, y0, z_min AS z0, x1, y1, z_max AS z1 FROM objects")
def aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.objects(spark, sf_dir).select("cluster_id", *_flat("aabb_min", ("x0", "y0", "z0")), *_flat("aabb_max", ("x1", "y1", "z1")))


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, footprint_m2 FROM objects")
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.objects(spark, sf_dir).select("cluster_id", "footprint_m2")


def _object_case(item: int) -> str:
    r = RULES
    aspect = "CASE WHEN least(w, d) > 1e-3 THEN greatest(w, d) / least(w, d) ELSE 1.0 END"
    rows = (
        (f"z_min < 0.2 AND h > {r.tall_furniture_min_h}", "'tall_furniture'", f"least(h / {r.tall_furniture_min_h}::DOUBLE, 1.0::DOUBLE)"),
        (f"z_min < 0.2 AND h BETWEEN 0.4 AND 1.1 AND footprint_m2 BETWEEN 0.3 AND 0.8 AND {aspect} < 1.5", "'chair'", "0.7::DOUBLE"),
        ("z_min < 0.2 AND h BETWEEN 0.4 AND 1.1 AND footprint_m2 > 0.8", "'table'", "0.8::DOUBLE"),
        ("z_min < 0.2 AND h BETWEEN 0.4 AND 1.1", "'furniture'", "0.4::DOUBLE"),
        ("z_min < 0.2 AND h < 0.4", "'small_object'", "0.6::DOUBLE"),
        ("z_min < 0.2", "'furniture'", "0.3::DOUBLE"),
        (f"z_min < {r.high_fixture_min_z} AND {aspect} > 3.0 AND w > 1.0", "'shelf'", "0.7::DOUBLE"),
        (f"z_min < {r.high_fixture_min_z} AND footprint_m2 < {r.small_object_max_footprint}", "'small_object'", f"1.0::DOUBLE - footprint_m2 / {r.small_object_max_footprint}::DOUBLE"),
        (f"z_min < {r.high_fixture_min_z}", "'furniture'", "0.5::DOUBLE"),
        (f"z_min >= {r.high_fixture_min_z}", "'high_fixture'", f"least(z_min / {r.high_fixture_min_z}::DOUBLE, 1.0::DOUBLE)"),
    )
    return "CASE " + " ".join(f"WHEN {row[0]} THEN {row[item]}" for row in rows) + (" ELSE 'furniture' END" if item == 1 else " ELSE 0.5::DOUBLE END")


_DENSITY = "round(n_points / greatest(w * d * h, 1e-6::DOUBLE), 1)"


def _labels_sql(source: str) -> str:
    sure = _object_case(2)
    return (f"SELECT cluster_id, {_object_case(1)} AS label, {_DENSITY} AS point_density, "
            f"round(CASE WHEN {_DENSITY} > 50000 THEN least({sure} + 0.1::DOUBLE, 1.0::DOUBLE) ELSE {sure} END, 2) AS confidence FROM {source}")


@query(f"{views.with_views('room', 'objects')} {_labels_sql('objects')}")
def object_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_clusters(views.objects(spark, sf_dir)).select("cluster_id", "label", "point_density", "confidence")


@query(f"{views.with_views('room', 'objects', 'objects_small')} {_labels_sql('objects_small')}")
def object_labels_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_clusters(views.objects(spark, sf_dir, 0.3)).select("cluster_id", "label", "point_density", "confidence")


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, {_DENSITY} AS point_density FROM objects")
def object_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_clusters(views.objects(spark, sf_dir)).select("cluster_id", "point_density")


@query(f"{views.with_views('room', 'objects')} SELECT label, count(*) AS n FROM ({_labels_sql('objects')}) GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(labels.label_clusters(views.objects(spark, sf_dir)))


_CHANNELS = ", ".join("CASE label " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in LABEL_COLOURS.items()) + f" ELSE {LABEL_COLOURS['unknown'][i]}::DOUBLE END AS {c}"
                      for i, c in enumerate("rgb"))


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, label, {_CHANNELS} FROM ({_labels_sql('objects')})")
def colorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return colorize(labels.label_clusters(views.objects(spark, sf_dir))).select("cluster_id", "label", "r", "g", "b")


@query(f"{views.with_views('room', 'objects')} SELECT cluster_id, CASE WHEN cluster_id % 7 = 0 THEN 'table' ELSE label END AS label FROM ({_labels_sql('objects')})")
def relabel_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = labels.label_clusters(views.objects(spark, sf_dir))
    chosen = clusters.where("cluster_id % 7 = 0").select("cluster_id", F.lit("table").alias("new_label"))
    return labels.override_labels(clusters, chosen).select("cluster_id", "label")


# ---- map

@query(f"{views.with_views('room')} SELECT min(x) - 0.5::DOUBLE AS x_min, min(y) - 0.5::DOUBLE AS y_min, max(x) + 0.5::DOUBLE AS x_max, max(y) + 0.5::DOUBLE AS y_max FROM room")
def topdown_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.map_extent(views.room(spark, sf_dir)).drop("scene_id")


@query(f"{views.with_views('room', 'objects')} SELECT o.cluster_id, x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS depth, {_round('cx')} AS text_x, {_round('cy')} AS text_y, label "
       f"FROM objects o JOIN ({_labels_sql('objects')}) l ON o.cluster_id = l.cluster_id")
def topdown_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = writers.map_rectangles(labels.label_clusters(views.objects(spark, sf_dir)))
    return found.select("cluster_id", "x", "y", "width", "depth", near("text_x").alias("text_x"), near("text_y").alias("text_y"), "label")


_MAP_CHANNELS = ", ".join("CASE label " + " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in MAP_COLOURS.items()) + f" ELSE {MAP_COLOURS['unknown'][i]}::DOUBLE END AS {c}"
                          for i, c in enumerate("rgb"))


@query(f"{views.with_views('pairs')} SELECT position AS cluster_id, true_label AS label, {_MAP_CHANNELS.replace('CASE label', 'CASE true_label')} FROM pairs")
def map_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the colours of the map, where walls are darker."""
    rows = views.label_pairs(spark, sf_dir).select(F.col("position").alias("cluster_id"), F.col("true_label").alias("label"))
    return colorize(rows, colours=MAP_COLOURS)


# ---- index sets and unions

def _near_plane(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cloud = views.embedded(spark, sf_dir)
    model = vector(F.lit(0.6), F.lit(0.0), F.lit(0.8), F.lit(0.01))
    return cloud, cloud.where(plane_distance(model) <= 0.05)


_IN = "abs(0.6::DOUBLE * x + 0.0::DOUBLE * y + 0.8::DOUBLE * z + 0.01::DOUBLE) <= 0.05"


@query(f"{views.with_views('embedded')} SELECT point_id, x, y, z FROM embedded WHERE {_IN}")
def inlier_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ransac.take(*_near_plane(spark, sf_dir)).select("point_id", "x", "y", "z")


@query(f"{views.with_views('embedded')} SELECT point_id, x, y, z FROM embedded WHERE NOT {_IN}")
def inlier_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ransac.take_rest(*_near_plane(spark, sf_dir)).select("point_id", "x", "y", "z")


@query(f"{views.with_views('room', 'embedded')}, all_points AS (SELECT 'plane' AS kind, point_id, x, y, z, 'floor' AS label FROM room UNION ALL "
       f"SELECT 'cluster' AS kind, point_id, x, y, z, 'chair' AS label FROM embedded) SELECT kind, point_id, x, y, z, label, {_CHANNELS} FROM all_points")
def merge_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = lambda key, label: spark.range(1).select(F.lit("0").alias("scene_id"), F.col("id").cast("int").alias(key), F.lit(label).alias("label"))
    room = views.room(spark, sf_dir).withColumn("plane_id", F.lit(0))
    cloud = views.embedded(spark, sf_dir).drop("label").withColumn("cluster_id", F.lit(0))
    merged = writers.merge_clouds(room, owner("plane_id", "floor"), cloud, owner("cluster_id", "chair"))
    return merged.select("kind", "point_id", "x", "y", "z", "label", "r", "g", "b")


# ---- scores

_LABELS = "labels AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in scores.SCORED) + "]) AS label)"
_KNOWN = "known AS (SELECT * FROM pairs WHERE true_label IN (SELECT label FROM labels) AND pred_label IN (SELECT label FROM labels))"


@query(f"{views.with_views('pairs')}, {_LABELS}, {_KNOWN} SELECT t.label AS true_label, p.label AS pred_label, count(k.position) AS n "
       "FROM labels t CROSS JOIN labels p LEFT JOIN known k ON k.true_label = t.label AND k.pred_label = p.label GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.confusion_matrix(views.label_pairs(spark, sf_dir))


@query(f"{views.with_views('pairs')}, {_LABELS}, {_KNOWN}, s AS (SELECT label, (SELECT count(*) FROM known WHERE true_label = label AND pred_label = label) AS tp, "
       "(SELECT count(*) FROM known WHERE true_label = label) AS support, (SELECT count(*) FROM known WHERE pred_label = label) AS predicted FROM labels), "
       "pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS r FROM s) "
       "SELECT label, round(p::DOUBLE, 4) AS precision, round(r::DOUBLE, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END::DOUBLE, 4) AS f1, support FROM pr")
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.per_class(views.label_pairs(spark, sf_dir)).drop("predicted")


@query(f"{views.with_views('pairs')} SELECT round(sum((true_label = pred_label)::BIGINT) / count(*)::DOUBLE, 4) AS accuracy FROM pairs")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.accuracy(views.label_pairs(spark, sf_dir))


@query(f"{views.with_views('pairs')}, {_LABELS}, {_KNOWN} SELECT label, (SELECT count(*) FROM known WHERE true_label = label) AS support FROM labels "
       "WHERE label IN (SELECT true_label FROM known UNION SELECT pred_label FROM known)")
def console_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.report(views.label_pairs(spark, sf_dir)).select("label", "support")


@query(f"{views.with_views('pairs')} SELECT position, true_label, pred_label FROM pairs WHERE position % 11 <> 0 AND position % 13 <> 0")
def zip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted labels of the positions that both tables have."""
    pairs = views.label_pairs(spark, sf_dir)
    side = lambda label, skip: pairs.where(F.col("position") % skip != 0).select("position", F.col(label).alias("label"))
    return scores.zip_labels(side("true_label", 11), side("pred_label", 13))


@query(f"{views.with_views('pairs')}, {_LABELS}, {_KNOWN}, s AS (SELECT label, (SELECT count(*) FROM known WHERE true_label = label AND pred_label = label) AS tp, "
       "(SELECT count(*) FROM known WHERE true_label = label) AS support, (SELECT count(*) FROM known WHERE pred_label = label) AS predicted FROM labels) "
       "SELECT 'accuracy' AS score, NULL AS label, NULL AS other, round(sum((true_label = pred_label)::BIGINT) / count(*)::DOUBLE, 4) AS value FROM pairs "
       "UNION ALL SELECT 'precision', label, NULL, round(CASE WHEN predicted > 0 THEN tp / predicted::DOUBLE ELSE 0.0 END::DOUBLE, 4) FROM s "
       "UNION ALL SELECT 'recall', label, NULL, round(CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END::DOUBLE, 4) FROM s "
       "UNION ALL SELECT 'pairs', t.label, p.label, count(k.position)::DOUBLE FROM labels t CROSS JOIN labels p LEFT JOIN known k ON k.true_label = t.label AND k.pred_label = p.label GROUP BY 2, 3")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bundle of scores as rows."""
    found = scores.evaluate(views.label_pairs(spark, sf_dir))
    none = F.lit(None).cast("string")
    row = lambda df, score, label, other, value: df.select(F.lit(score).alias("score"), label.alias("label"), other.alias("other"), value.cast("double").alias("value"))
    out = row(found["accuracy"], "accuracy", none, none, F.col("accuracy"))
    for name in ("precision", "recall"):
        out = out.union(row(found["per_class"], name, F.col("label"), none, F.col(name)))
    return out.union(row(found["confusion_matrix"], "pairs", F.col("true_label"), F.col("pred_label"), F.col("n")))


# ---- neighbourhoods

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_ALL_PAIRS = f"d AS (SELECT a.point_id AS point_id, b.point_id AS nbr_id, {_D2} AS d2 FROM embedded a, embedded b)"


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS} SELECT point_id, nbr_id, {_round('d2', 12)} AS d2 FROM d WHERE d2 <= {EPS}::DOUBLE * {EPS}::DOUBLE")
def eps_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.radius_pairs(views.embedded(spark, sf_dir), EPS).select("point_id", "nbr_id", near("d2", 12).alias("d2"))


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS} SELECT point_id, count(*) - 1 AS n_neighbours FROM d WHERE d2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE GROUP BY 1")
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.radius_count(views.embedded(spark, sf_dir), RADIUS).drop("scene_id")


def _ranked(where: str, most: int) -> str:
    return (f"(SELECT point_id, nbr_id, d2, row_number() OVER (PARTITION BY point_id ORDER BY d2, nbr_id <> point_id, nbr_id) AS rank FROM d WHERE {where}) WHERE rank <= {most}")


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS} SELECT point_id, nbr_id, {_round('d2', 12)} AS d2, rank::INTEGER AS rank FROM {_ranked('point_id <> nbr_id', K)}")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(views.embedded(spark, sf_dir), K).select("point_id", "nbr_id", near("d2", 12).alias("d2"), "rank")


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS} SELECT point_id, nbr_id, rank::INTEGER AS rank FROM {_ranked(f'd2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE', 10)}")
def hybrid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.hybrid_neighbours(views.embedded(spark, sf_dir), RADIUS, 10).select("point_id", "nbr_id", "rank")


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS}, n AS (SELECT point_id, count(*) - 1 AS n FROM d WHERE d2 <= {RADIUS}::DOUBLE * {RADIUS}::DOUBLE GROUP BY 1) "
       "SELECT point_id, n < 10 AS outlier FROM n")
def radius_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(*outliers.radius_outliers(views.embedded(spark, sf_dir), RADIUS, 10))


@query(f"{views.with_views('embedded')}, {_ALL_PAIRS}, m AS (SELECT point_id, avg(sqrt(d2)) AS m FROM {_ranked('point_id <> nbr_id', 20)} GROUP BY 1) "
       "SELECT point_id, m > (SELECT avg(m) + 2.0::DOUBLE * stddev_samp(m) FROM m) AS outlier FROM m")
def statistical_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(*outliers.statistical_outliers(views.embedded(spark, sf_dir), 20, 2.0))


def _marked(clean: DataFrame, removed: DataFrame) -> DataFrame:
    return clean.select("point_id", F.lit(False).alias("outlier")).union(removed.select("point_id", F.lit(True)))


# ---- clustering

_DBSCAN = (
    f"{views.with_views('embedded')}, {_ALL_PAIRS}, p AS (SELECT point_id, nbr_id FROM d WHERE d2 <= {EPS}::DOUBLE * {EPS}::DOUBLE), "
    f"core AS (SELECT point_id FROM p GROUP BY 1 HAVING count(*) >= {MIN_POINTS}), "
    "e AS (SELECT p.point_id AS a, p.nbr_id AS b FROM p JOIN core c ON c.point_id = p.point_id JOIN core q ON q.point_id = p.nbr_id), "
    "cc(id, root) AS (SELECT point_id, point_id FROM core UNION SELECT e.b, cc.root FROM cc JOIN e ON e.a = cc.id), "
    "roots AS (SELECT id AS point_id, min(root) AS root FROM cc GROUP BY 1), "
    "ids AS (SELECT root, (row_number() OVER (ORDER BY root) - 1)::INTEGER AS cluster_id FROM (SELECT DISTINCT root FROM roots)), "
    "cores AS (SELECT point_id, cluster_id FROM roots JOIN ids USING (root)), "
    "border AS (SELECT p.point_id, min(cluster_id) AS cluster_id FROM p JOIN cores c ON c.point_id = p.nbr_id WHERE p.point_id NOT IN (SELECT point_id FROM core) GROUP BY 1), "
    "known AS (SELECT * FROM cores UNION ALL SELECT * FROM border), "
    "labelled AS (SELECT m.point_id, x, y, z, coalesce(cluster_id, -1) AS cluster_id FROM embedded m LEFT JOIN known k ON k.point_id = m.point_id)")


@query(f"{_DBSCAN} SELECT point_id, cluster_id FROM labelled")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dbscan(views.embedded(spark, sf_dir), EPS, MIN_POINTS).drop("scene_id")


@query(f"{_DBSCAN} SELECT cluster_id, count(*) AS n_points, min(x) AS x0, max(x) AS x1, min(z) AS z_min, max(z) AS z_max, {_round('avg(y)')} AS cy FROM labelled "
       "WHERE cluster_id >= 0 GROUP BY 1 HAVING count(*) >= 8 AND max(x) - min(x) <= 1.5 AND max(y) - min(y) <= 1.5 AND max(z) - min(z) <= 1.5")
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = Dbscan(eps=EPS, min_points=MIN_POINTS, min_cluster_points=8, max_object_size=1.5)
    found = objects.object_clusters(views.embedded(spark, sf_dir), config)[0]
    return found.select("cluster_id", "n_points", F.col("aabb_min")[0].alias("x0"), F.col("aabb_max")[0].alias("x1"), "z_min", "z_max", near(F.col("centroid")[1]).alias("cy"))


@query(f"{_DBSCAN}, best AS (SELECT cluster_id FROM labelled WHERE cluster_id >= 0 GROUP BY 1 ORDER BY count(*) DESC, cluster_id LIMIT 1) "
       "SELECT point_id FROM labelled WHERE cluster_id IN (SELECT cluster_id FROM best)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.largest_component(views.embedded(spark, sf_dir), EPS, MIN_POINTS).select("point_id")


# ---- plane fitting

ITERATIONS, DISTANCE = 100, 0.02
_H = f"(point_id * {ransac.MULTIPLIER} + 0) % {ransac.MODULUS}"
_RANSAC = (
    f"{views.with_views('embedded')}, drawn AS (SELECT *, row_number() OVER (ORDER BY (({_H}) * ({_H}) + point_id) % {ransac.MODULUS}, point_id) - 1 AS rn FROM embedded), "
    + "t AS (SELECT (rn // 3)::INTEGER AS h, " + ", ".join(f"max(CASE WHEN rn % 3 = {k} THEN {c} END) AS {c}{k}" for k in range(3) for c in "xyz")
    + f" FROM drawn WHERE rn < {3 * ITERATIONS} GROUP BY 1 HAVING count(*) = 3), "
    "n AS (SELECT *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS a, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS b, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS c FROM t), "
    "u AS (SELECT *, sqrt(a*a + b*b + c*c) AS size FROM n WHERE sqrt(a*a + b*b + c*c) >= 1e-9), "
    "s AS (SELECT *, CASE WHEN c/size < 0 OR (c/size = 0 AND (b/size < 0 OR (b/size = 0 AND a/size < 0))) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM u), "
    "m AS (SELECT h, sign*(a/size) AS a, sign*(b/size) AS b, sign*(c/size) AS c, x0, y0, z0 FROM s), "
    "planes AS (SELECT h, a, b, c, -(a*x0 + b*y0 + c*z0) AS d FROM m)")


@query(f"{_RANSAC} SELECT h AS hypothesis, count(*) AS n_inliers, {_round('any_value(a)')} AS a, {_round('any_value(b)')} AS b, {_round('any_value(c)')} AS c, "
       f"{_round('any_value(d)')} AS d FROM planes, embedded WHERE abs(a*x + b*y + c*z + d) <= {DISTANCE}::DOUBLE GROUP BY h ORDER BY n_inliers DESC, h LIMIT 1")
def ransac_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ransac.best_planes(views.embedded(spark, sf_dir), DISTANCE, ITERATIONS)
    return best.select("hypothesis", "n_inliers", *_flat("model", ("a", "b", "c", "d"), 6))


_PLANES = Ransac(distance_threshold=DISTANCE, min_plane_size=50, remaining_points_min=50)


@query(f"{views.with_views('room')}, {_VOXELS}, cells AS (SELECT vx * 1000000 + vy * 1000 + vz AS point_id, x, y, z FROM voxels), "
       + geo.planes_of("cells", _PLANES.max_planes, _PLANES.num_iterations, DISTANCE, _PLANES.min_plane_size, _PLANES.remaining_points_min, _PLANES.seed,
                       ransac.MODULUS, ransac.MULTIPLIER, ransac.AGAIN)
       + f" SELECT plane_id, inlier_count, n_dropped, {_round('centroid_z')} AS centroid_z, " + ", ".join(f"{_round(c)} AS {c}" for c in "abcd") + " FROM planes")
def iterative_ransac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of the voxelised room, with the default rounds and hypotheses."""
    small = voxel.voxel_downsample(views.room(spark, sf_dir), VOXEL)
    unique = small.withColumn("point_id", F.col("vx") * 1_000_000 + F.col("vy") * 1000 + F.col("vz"))
    planes = ransac.extract_planes(unique, _PLANES)[0]
    return planes.select("plane_id", "inlier_count", "n_dropped", near("centroid_z").alias("centroid_z"), *_flat("plane_model", ("a", "b", "c", "d"), 6))


# ---- normals, boxes, regions

NORMAL_RADIUS, NORMAL_MOST, BEND_K = 0.15, 30, 10
_NORMALS = f"{views.with_views('embedded')}, {geo.normals('embedded', NORMAL_RADIUS, NORMAL_MOST)}"


def _with_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normals.estimate_normals(views.embedded(spark, sf_dir), NORMAL_RADIUS, NORMAL_MOST)


@query(f"{_NORMALS} SELECT point_id, " + ", ".join(f"{_round(f'n{c}', 5)} AS n{c}" for c in "xyz") + " FROM normals")
def surface_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_normals(spark, sf_dir).select("point_id", *[near(f"n{c}", 5).alias(f"n{c}") for c in "xyz"])


@query(f"{_NORMALS}, {geo.nearest(BEND_K - 1)}, {geo.curvature('embedded')} SELECT point_id, {_round('curvature', 5)} AS curvature FROM bent")
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normals.curvature(_with_normals(spark, sf_dir), BEND_K).select("point_id", near("curvature", 5).alias("curvature"))


def _boxes_sql() -> str:
    def turned(k: int, out: str) -> str:
        x, y, z = (f"v{k}{c}" for c in "xyz")
        lead = f"CASE WHEN abs({x}) >= abs({y}) AND abs({x}) >= abs({z}) THEN {x} WHEN abs({y}) >= abs({z}) THEN {y} ELSE {z} END"
        return ", ".join(f"CASE WHEN {lead} < 0 THEN -{v} ELSE {v} END AS {out}{c}" for v, c in zip((x, y, z), "xyz"))

    along = lambda n: f"m.x * {n}x + m.y * {n}y + m.z * {n}z"
    span = lambda n: f"max({along(n)}) - min({along(n)})"
    plain = lambda c: f"max(m.{c}) - min(m.{c})"
    return (f"{views.with_views('embedded')}, spread AS (SELECT label, count(*) AS n, {geo.covariances('x', 'y', 'z')} FROM embedded GROUP BY label), {geo.eigenvectors('spread', 'frame')}, "
            f"two AS (SELECT label, n, {turned(2, 'a')}, {turned(1, 'b')} FROM frame), "
            "three AS (SELECT *, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz FROM (SELECT * RENAME (\"by\" AS by_) FROM two)) "
            "SELECT label AS cluster_id, " + ", ".join(f"{_round(f'CASE WHEN any_value(n) >= 4 THEN {span(n)} ELSE {plain(c)} END', 5)} AS e{k}"
                                                       for k, (n, c) in enumerate((("a", "x"), ("b", "y"), ("c", "z"))))
            + f", {_round('CASE WHEN any_value(n) >= 4 THEN degrees(atan2(any_value(ay), any_value(ax))) ELSE 0 END', 3)} AS yaw FROM embedded m JOIN three USING (label) GROUP BY label"
            ).replace("m.y * by +", "m.y * by_ +")


@query(_boxes_sql())
def oriented_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summaries.oriented_boxes(views.embedded(spark, sf_dir).withColumnRenamed("label", "cluster_id"))
    return found.select("cluster_id", *_flat("obb_extent", ("e0", "e1", "e2"), 5), near("obb_rotation_deg", 3).alias("yaw"))


_GROWING = RegionGrowing(angle_threshold_deg=20.0, curvature_threshold=0.2, min_region_size=5, k_neighbours=10)
_BENT = f"{_NORMALS}, {geo.nearest(_GROWING.k_neighbours - 1)}, {geo.curvature('embedded')}"


@query(f"{_BENT}, {geo.fill(_GROWING.angle_threshold_deg, _GROWING.curvature_threshold, _GROWING.min_region_size, _GROWING.max_regions)} "
       f"SELECT region_id, count(*) AS n_points, {_round('median(z)')} AS centroid_z, "
       + ", ".join(f"{_round(f'max({c}) - min({c})')} AS {d}" for c, d in zip("xyz", _DIMS)) + " FROM filled JOIN embedded USING (point_id) GROUP BY region_id")
def region_growing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = stash(_with_normals(spark, sf_dir))
    grown = region_growing.grow_regions(cloud, _GROWING).where("region_id >= 0")
    members = stash(cloud.join(grown, ["scene_id", "point_id"]))  # read by every round of the summary's median
    found = summaries.region_summary(members)
    return found.select("region_id", "n_points", near("centroid_z").alias("centroid_z"), *_flat("dims", _DIMS, 6))


@query(f"{_NORMALS}, {geo.nearest(_GROWING.k_neighbours - 1)}, smooth AS (SELECT point_id AS a, nbr_id AS b FROM nearest WHERE alike >= cos(radians({_GROWING.angle_threshold_deg}::DOUBLE))), "
       f"{geo.components('smooth', 'embedded')} SELECT root, count(*) AS n_points FROM roots GROUP BY root")
def smooth_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_growing.smooth_regions(_with_normals(spark, sf_dir), _GROWING).groupBy("root").agg(F.count("*").alias("n_points"))


# ---- synthetic rooms: random, so counts, and that all points lie in the room (noise: in its cube), are fixed

_ROOM, _DENSITY_OF_ROOM, _STRAY = (5.0, 6.0, 3.0), 10_000, 500


def _room_sql(surfaces: dict[str, int]) -> str:
    parts = surfaces | {name: n for name, n, *_ in (*synthetic.FURNITURE, synthetic.LAMP)} | {"noise": _STRAY}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}::BIGINT, {n}::BIGINT)" for p, n in parts.items()) + ") t(part, n_points, n_inside)"


def _room_parts(room: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for c, size in zip("xyz", _ROOM):
        inside = inside & F.col(c).between(-0.1, F.when(F.col("part") == "noise", max(_ROOM)).otherwise(size) + 0.1)
    return room.groupBy("part").agg(F.count("*").alias("n_points"), F.count_if(inside).alias("n_inside"))


@query(_room_sql({"floor": _DENSITY_OF_ROOM, "ceiling": _DENSITY_OF_ROOM, "wall": 4 * _DENSITY_OF_ROOM}))
def synthetic_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each part of a generated room."""
    return _room_parts(synthetic.synthetic_room(spark))


@query(_room_sql({"floor": 3 * _DENSITY_OF_ROOM // 2, "ceiling": 3 * _DENSITY_OF_ROOM // 2, "wall": 3 * _DENSITY_OF_ROOM + 3 * _DENSITY_OF_ROOM // 2}))
def synthetic_l_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each part of a generated L-shaped room."""
    return _room_parts(synthetic.synthetic_room(spark, layout="l-shaped"))


# ---- files

@query(f"{views.with_views('embedded')} SELECT x, y, z FROM embedded")
def text_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud written as lines of an .xyz file in the shared folder, and read back."""
    path = f"{shared_dir(spark)}/cairn-{spark.sparkContext.applicationId}/text_cloud.xyz"
    lines = views.embedded(spark, sf_dir).select(F.concat_ws(" ", "x", "y", "z").alias("value"))
    lines.write.mode("overwrite").text(path)
    return text.read_text_cloud(spark, path).select("x", "y", "z")


_REPORT = ("structural_planes array<struct<plane_id:int,label:string,inlier_count:bigint,centroid_z:double>>, "
           "objects array<struct<cluster_id:int,label:string,confidence:double,n_points:bigint,z_min:double>>")


@query(f"{views.with_views('room', 'objects')}, layers AS (SELECT round(z / {LAYER}::DOUBLE)::INTEGER AS plane_id, count(*) AS inlier_count, median(z) AS centroid_z FROM room GROUP BY 1), "
       f"named AS ({_labels_sql('objects')}) SELECT 'plane' AS kind, row_number() OVER (ORDER BY plane_id)::INTEGER - 1 AS place, plane_id AS id, "
       f"{_plane_sql('0.0::DOUBLE', '0.0::DOUBLE', '1.0::DOUBLE', 'centroid_z', f'{HEIGHT}::DOUBLE')} AS label, inlier_count AS n, {_round('centroid_z')} AS z, NULL::DOUBLE AS confidence FROM layers "
       "UNION ALL SELECT 'object', row_number() OVER (ORDER BY n_points DESC, cluster_id)::INTEGER - 1, cluster_id::INTEGER, label, n_points, "
       f"{_round('z_min')}, confidence FROM objects JOIN named USING (cluster_id) WHERE n_points >= 8")
def segmentation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JSON report of a labelled room says, read back from it."""
    flat = summaries.plane_summary(_layers(spark, sf_dir)).withColumns({"normal": vector(F.lit(0.0), F.lit(0.0), F.lit(1.0))})
    planes = labels.label_planes(flat.withColumn("plane_model", vector(F.lit(0.0), F.lit(0.0), F.lit(1.0), -F.col("centroid_z"))), HEIGHT)
    found = summaries.large_enough(views.objects(spark, sf_dir), 8).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    none = {"obb_extent": F.lit(None).cast("array<double>"), "obb_rotation_deg": F.lit(None).cast("double")}
    told = writers.segmentation_report(planes, labels.label_clusters(found).withColumns(none)).select(F.from_json("report", _REPORT).alias("r"))
    rows = lambda c: told.select(F.posexplode(f"r.{c}").alias("place", "row")).select("place", "row.*")
    first = rows("structural_planes").select(F.lit("plane").alias("kind"), "place", F.col("plane_id").alias("id"), "label", F.col("inlier_count").alias("n"),
                                             near("centroid_z").alias("z"), F.lit(None).cast("double").alias("confidence"))
    second = rows("objects").select(F.lit("object"), "place", "cluster_id", "label", "n_points", near("z_min"), "confidence")
    return first.union(second)
