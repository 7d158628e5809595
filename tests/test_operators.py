"""Operators against brute force, and the invariants that every scene keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.config import Dbscan, Labeling, Ransac, RegionGrowing
from cairn.operators import dbscan, labels, neighbours, normals, objects, outliers, ransac, region_growing, stats, summaries, voxel
from cairn.schemas import points


def cloud(spark, xyz, scene="0", start=0):
    rows = [(scene, start + i, *map(float, p)) for i, p in enumerate(xyz)]
    return points(spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double"))


def two_scenes(spark, n=150, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 1, (n, 3)), rng.uniform(-3, 3, (n // 2, 3))
    return cloud(spark, a, "a").unionByName(cloud(spark, b, "b")), {"a": a, "b": b}


def square(p):
    return ((p[:, None] - p[None]) ** 2).sum(-1)


def test_points_drops_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, float("nan"), 0.0, 0.0), (3, None, 0.0, 0.0)], "point_id long, x double, y double, z double")
    assert [r.point_id for r in points(df).collect()] == [1]


def test_stats_of_scenes_and_of_nothing(spark):
    df, xyz = two_scenes(spark)
    for r in stats.scene_stats(df).collect():
        p = xyz[r.scene_id]
        assert r.n_points == len(p) and not r.has_colors and not r.has_normals
        assert r.bbox_min == pytest.approx(p.min(0)) and r.scene_dims == pytest.approx(np.ptp(p, axis=0)) and r.centroid == pytest.approx(p.mean(0))
    none = stats.total_stats(df.limit(0)).first()
    assert none.n_points == 0 and none.bbox_min == [0, 0, 0] and none.centroid == [0, 0, 0] and not none.has_colors


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.999, 1.0])
def test_grouped_percentile(spark, share):
    from cairn.functions.ranks import grouped_percentile

    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=3000), "b": np.repeat([1.0, 2.0, 7.5], [5, 900, 3]), "c": np.array([4.25]), "d": np.r_[rng.uniform(0, 1e-9, 50), 1e9], "e": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("none", None)]
    got = {r.k: r.p for r in grouped_percentile(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", share, "p").collect()}
    assert got == {k: pytest.approx(np.percentile(v, 100 * share), rel=1e-12, abs=1e-15) for k, v in groups.items()}


def test_normalize_floor(spark):
    df, xyz = two_scenes(spark)
    for scene, p in xyz.items():
        z = sorted(r.z for r in stats.normalize_floor(df).where(F.col("scene_id") == scene).collect())
        assert z == pytest.approx(sorted(p[:, 2] - np.percentile(p[:, 2], 5)))
    assert stats.normalize_floor(df.limit(0)).count() == 0


def test_voxels(spark):
    df, xyz = two_scenes(spark)
    sizes = []
    for size in (0.2, 0.5, 100.0):
        got = voxel.voxel_downsample(df, size).collect()
        want = {}
        for s, p in xyz.items():
            for i, q in enumerate(p):
                want.setdefault((s, *np.floor((q - p.min(0)) / size).astype(int)), []).append(i)
        assert len(got) == len(want)
        for r in got:
            members = want[(r.scene_id, r.vx, r.vy, r.vz)]
            assert r.n_members == len(members) and r.point_id == min(members)
            assert (r.x, r.y, r.z) == pytest.approx(xyz[r.scene_id][members].mean(0))
        sizes.append(len(got))
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 2
    for bad in (0, -1):
        with pytest.raises(ValueError):
            voxel.voxel_downsample(df, bad)


@pytest.mark.parametrize("n", [10, 647, 5000])
def test_means_of_equal_members_are_their_value(spark, n):
    """647 heights of 2.4 had a mean beyond 2.4, and their layer the label of what lies above 0.8 of 3 m."""
    assert np.cumsum([2.4] * 647)[-1] / 647 > 0.8 * 3.0
    for parts in (1, 3):
        rows = spark.range(n).repartition(parts).select(F.lit("0").alias("scene_id"), F.col("id").alias("point_id"), F.lit(0.1).alias("x"), F.lit(0.7).alias("y"), F.lit(2.4).alias("z"))
        found = voxel.voxel_downsample(rows, 0.23).collect()
        assert [(r.x, r.y, r.z, r.n_members) for r in found] == [(0.1, 0.7, 2.4, n)]


@pytest.mark.parametrize("radius", [0.15, 0.6])
def test_radius_pairs_match_brute_force(spark, radius):
    df, xyz = two_scenes(spark)
    got = {(r.scene_id, r.point_id, r.nbr_id) for r in neighbours.radius_pairs(df, radius).collect()}
    want = {(s, i, j) for s, p in xyz.items() for i, j in zip(*np.nonzero(square(p) <= radius * radius))}
    assert got == want


@pytest.mark.parametrize("k", [1, 7, 200])
def test_nearest_neighbours_match_brute_force(spark, k):
    df, xyz = two_scenes(spark, 80)
    df = df.unionByName(cloud(spark, [(0, 0, 0), (0, 0, 0), (0, 0, 0), (50, 0, 0)], "copies")).unionByName(cloud(spark, [(1, 1, 1)], "one"))
    xyz |= {"copies": np.array([(0, 0, 0), (0, 0, 0), (0, 0, 0), (50, 0, 0)], float), "one": np.ones((1, 3))}
    got = {}
    for r in neighbours.nearest_neighbours(df, k).collect():
        got.setdefault((r.scene_id, r.point_id), []).append((r["rank"], r.nbr_id))
    for s, p in xyz.items():
        d = square(p)
        for i in range(len(p)):
            order = [j for j in np.lexsort((np.arange(len(p)), d[i])) if j != i][:k]
            assert [j for _, j in sorted(got.get((s, i), []))] == order


def test_outliers_part_the_points(spark):
    rng = np.random.default_rng(3)
    xyz = np.vstack([rng.uniform(0, 1, (200, 3)), rng.uniform(100, 200, (10, 3))])
    df = cloud(spark, xyz)
    clean, gone = outliers.statistical_outliers(df, 10, 1.5)
    mean = np.sort(np.sqrt(square(xyz)), axis=1)[:, 1:11].mean(1)
    want = {int(i) for i in np.flatnonzero(mean > mean.mean() + 1.5 * mean.std(ddof=1))}
    assert {r.point_id for r in gone.collect()} == want and want
    assert clean.count() + gone.count() == len(xyz) and clean.columns == df.columns
    few, none = outliers.statistical_outliers(df.limit(10), 10)
    assert few.count() == 10 and none.count() == 0
    clean, gone = outliers.radius_outliers(df, 0.3, 3)
    assert {r.point_id for r in gone.collect()} == {int(i) for i in np.flatnonzero((square(xyz) <= 0.3 * 0.3).sum(1) - 1 < 3)}
    clean, gone = outliers.radius_outliers(cloud(spark, [(0, 0, 0), (9, 9, 9)]), 0.1, 1)
    assert clean.count() == 2 and gone.count() == 2  # a scene never loses all of its points


def plain_dbscan(p, eps, least):
    near = square(p) <= eps * eps
    core = near.sum(1) >= least
    label, ids = np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = ids
            while stack:
                k = stack.pop()
                for j in np.flatnonzero(near[k] & core):
                    if label[j] < 0:
                        label[j] = ids
                        stack.append(j)
            ids += 1
    for i in np.flatnonzero(~core):
        reach = label[np.flatnonzero(near[i] & core)]
        label[i] = reach.min() if len(reach) else -1
    return label


@pytest.mark.parametrize("gather", [0, 100_000])
def test_dbscan_matches_brute_force(spark, monkeypatch, gather):
    monkeypatch.setattr(dbscan, "SMALL_GRAPH", gather)
    df, xyz = two_scenes(spark, 300, 5)
    got = {(r.scene_id, r.point_id): r.cluster_id for r in dbscan.dbscan(df, 0.14, 4).collect()}
    for s, p in xyz.items():
        assert [got[(s, i)] for i in range(len(p))] == plain_dbscan(p, 0.14, 4).tolist()
    assert dbscan.dbscan(df.limit(0), 0.1, 3).count() == 0


def test_largest_component_and_objects(spark):
    rng = np.random.default_rng(20)
    xyz = np.vstack([rng.uniform(0, 0.4, (120, 3)), rng.uniform(0, 0.4, (80, 3)) + [3, 0, 0], [[50, 50, 50]]])
    df = cloud(spark, xyz)
    assert {r.point_id for r in dbscan.largest_component(df, 0.3, 5).collect()} == set(range(120))
    assert dbscan.largest_component(df.limit(4), 0.01, 5).count() == 4  # too few: whole
    assert dbscan.largest_component(df, 1e-6, 5).count() == len(xyz)  # all noise: whole
    config = Dbscan(eps=0.3, min_points=5, min_cluster_points=50, max_object_size=1.0)
    clusters, members = objects.object_clusters(df, config)
    rows = summaries.by_size(clusters).collect()
    assert [r.n_points for r in rows] == [120, 80] and members.count() == 200
    for r in rows:
        assert all(a <= c <= b for a, c, b in zip(r.aabb_min, r.centroid, r.aabb_max)) and r.z_min <= r.z_max
    for bad in (Dbscan(0.3, 5, 10_000, 1.0), Dbscan(0.3, 5, 50, 0.01), Dbscan(1e-6, 5, 1, 1.0)):
        assert objects.object_clusters(df, bad)[0].count() == 0
    assert objects.object_clusters(df.limit(1), config)[0].count() == 0


def test_normals_and_curvature(spark):
    rng = np.random.default_rng(1)
    flat = np.c_[rng.uniform(0, 1, (200, 2)), np.zeros(200)]
    wall = np.c_[np.zeros(200), rng.uniform(0, 1, (200, 2))]
    df = cloud(spark, flat, "flat").unionByName(cloud(spark, wall, "wall")).unionByName(cloud(spark, [(0, 0, 0), (9, 9, 9)], "far"))
    found = normals.estimate_normals(df, 0.4, 30).cache()
    for r in found.collect():
        n = np.array([r.nx, r.ny, r.nz])
        assert np.linalg.norm(n) == pytest.approx(1)
        assert np.abs(n[0 if r.scene_id == "wall" else 2]) == pytest.approx(1, abs=1e-6)
    bent = {r.scene_id: r.c for r in normals.curvature(found, 10).groupBy("scene_id").agg(F.max("curvature").alias("c")).collect()}
    assert bent["flat"] == pytest.approx(0, abs=1e-9)
    assert normals.estimate_normals(df.limit(0)).count() == 0
    alone = normals.curvature(cloud(spark, [(0, 0, 0)]).withColumns({"nx": F.lit(0.0), "ny": F.lit(0.0), "nz": F.lit(1.0)}), 5)
    assert alone.first().curvature == 1.0


def test_oriented_boxes(spark):
    rng = np.random.default_rng(2)
    angle = np.radians(30)
    turn = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    box = rng.uniform(-0.5, 0.5, (3000, 3)) * [4, 2, 1]
    df = cloud(spark, box @ turn.T).withColumn("cluster_id", F.lit(0))
    few = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], start=9000).withColumn("cluster_id", F.lit(1))
    rows = {r.cluster_id: r for r in summaries.oriented_boxes(df.unionByName(few)).collect()}
    assert rows[0].obb_extent == pytest.approx([4, 2, 1], rel=0.05) and rows[0].obb_rotation_deg % 180 == pytest.approx(30, abs=2)
    assert rows[1].obb_extent == [1, 1, 0] and rows[1].obb_rotation_deg == 0 and rows[1].obb_axes is None


def layers(n=400, seed=11):
    rng = np.random.default_rng(seed)
    make = lambda z: np.c_[rng.uniform(0, 1, n), rng.uniform(0, 1.2, n), z + rng.normal(0, 0.003, n)]
    return np.vstack([make(0.0), make(3.0)[: n // 2]])


def test_best_plane_is_the_largest_layer(spark):
    df = cloud(spark, layers(), "a").unionByName(cloud(spark, layers(seed=12) + [0, 0, 1], "b"))
    for r in ransac.best_planes(df, 0.02, 200).collect():
        assert abs(r.model[2]) > 0.99 and r.n_inliers >= 390 and np.linalg.norm(r.model[:3]) == pytest.approx(1)
    line = cloud(spark, [(i, i, i) for i in range(9)])
    assert ransac.best_planes(line, 0.1, 3).count() == 0  # collinear triples make no plane


def test_iterative_planes(spark):
    df = cloud(spark, layers(), "a").unionByName(cloud(spark, [(0, 0, 0), (1, 1, 1)], "tiny"))
    config = Ransac(distance_threshold=0.05, num_iterations=200, min_plane_size=100, max_planes=5, remaining_points_min=50)
    planes, members, residual = ransac.extract_planes(df, config)
    rows = planes.orderBy("plane_id").collect()
    assert [r.plane_id for r in rows] == [0, 1] and rows[0].inlier_count > rows[1].inlier_count
    assert abs(rows[0].centroid_z) < 0.1 and rows[1].centroid_z == pytest.approx(3, abs=0.1)
    dropped = sum(r.n_dropped for r in rows)
    assert members.count() + residual.count() + dropped == 602 and residual.where("scene_id = 'tiny'").count() == 2
    assert ransac.extract_planes(df, Ransac(0.05, num_iterations=50, min_plane_size=5000))[0].count() == 0
    one = Ransac(0.05, num_iterations=100, min_plane_size=100, max_planes=1, remaining_points_min=50)
    assert ransac.extract_planes(df, one)[0].count() == 1
    assert [t.count() for t in ransac.extract_planes(df.limit(0))] == [0, 0, 0]


def test_take_and_rest(spark):
    df, _ = two_scenes(spark, 20)
    index = df.where("point_id % 3 = 0")
    assert ransac.take(df, index).count() + ransac.take_rest(df, index).count() == df.count()


def plain_fill(normal, near, bent, config):
    order = sorted(range(len(bent)), key=lambda i: (bent[i], i))
    limit, taken, regions = np.cos(np.radians(config.angle_threshold_deg)), set(), []
    for s in order:
        if s in taken:
            continue
        if len(regions) >= config.max_regions:
            break
        taken.add(s)
        queue, region = [s], {s}
        while queue:
            k = queue.pop(0)
            for q in near[k]:
                if q not in taken and abs(normal[k] @ normal[q]) >= limit:
                    taken.add(q)
                    region.add(q)
                    if bent[q] < config.curvature_threshold:
                        queue.append(q)
        if len(region) >= config.min_region_size:
            regions.append(region)
    return regions


def test_region_growing_matches_plain_fill(spark):
    rng = np.random.default_rng(8)
    xyz = np.vstack([np.c_[rng.uniform(0, 1, (60, 2)), np.zeros(60)], np.c_[np.zeros(40), rng.uniform(0, 1, (40, 2))]])
    config = RegionGrowing(angle_threshold_deg=15, curvature_threshold=0.1, min_region_size=10, k_neighbours=8)
    df = normals.estimate_normals(cloud(spark, xyz), 0.3, 12).cache()
    normal = np.array([(r.nx, r.ny, r.nz) for r in df.orderBy("point_id").collect()])
    d = square(xyz)
    near = [[j for j in np.lexsort((np.arange(100), d[i])) if j != i][:7] for i in range(100)]
    bent = [r.curvature for r in normals.curvature(df, 8).orderBy("point_id").collect()]
    got = {}
    for r in region_growing.grow_regions(df, config).where("region_id >= 0").collect():
        got.setdefault(r.region_id, set()).add(r.point_id)
    assert [got[k] for k in sorted(got)] == plain_fill(normal, near, bent, config) and len(got) >= 2
    assert region_growing.smooth_regions(df, config).select("root").distinct().count() >= 2
    assert region_growing.grow_regions(df.limit(5), config).where("region_id >= 0").count() == 0


@pytest.mark.parametrize("normal,z,height,want", [
    ((0, 0, 1), 0.0, 3, "floor"), ((0, 0, -2), 0.1499, 3, "floor"), ((0, 0, 1), 0.15, 3, "horizontal_surface"), ((0, 0, 1), 2.41, 3, "ceiling"),
    ((0, 0, 1), 2.4, 3, "horizontal_surface"), ((1, 0, 0), 1, 3, "wall"), ((0, 1, 1), 1, 3, "unknown"), ((0, 0, 0), 1, 3, "unknown"), ((0, 0, 1), 0.5, 0, "ceiling")])
def test_plane_rules(spark, normal, z, height, want):
    df = spark.createDataFrame([("0", list(map(float, normal)), float(z))], "scene_id string, normal array<double>, centroid_z double")
    assert labels.label_planes(df, float(height)).first().label == want


@pytest.mark.parametrize("dims,z,want,sure", [
    ((1, 1, 1.6), 0, "tall_furniture", 1.0), ((0.6, 0.6, 0.9), 0, "chair", 0.7), ((1, 1, 0.75), 0.1, "table", 0.8), ((0.3, 0.3, 0.5), 0, "furniture", 0.4),
    ((0.2, 0.2, 0.2), 0, "small_object", 0.6), ((1, 1, 1.3), 0, "furniture", 0.3), ((2, 0.3, 0.2), 1.0, "shelf", 0.7), ((0.3, 2, 0.2), 1.0, "furniture", 0.5),
    ((0.5, 0.5, 0.3), 0.8, "small_object", 0.5), ((1, 1, 0.3), 0.2, "furniture", 0.5), ((0.6, 0.6, 0.2), 2.8, "high_fixture", 1.0), ((1.2, 0.0005, 0.2), 1.0, "small_object", 1.0),
    ((1, 1, 1.5), 0, "furniture", 0.3), ((1, 1, 0.4), 0.1999, "table", 0.8), ((1, 1, 1), float("nan"), "furniture", 0.5)])
def test_cluster_rules(spark, dims, z, want, sure):
    row = ([float(d) for d in dims], float(z), float(dims[0] * dims[1]), 10)
    df = spark.createDataFrame([row], "dims array<double>, z_min double, footprint_m2 double, n_points long")
    r = labels.label_clusters(df).first()
    if z == z:
        assert (r.label, r.confidence) == (want, pytest.approx(sure))
    dense = labels.label_clusters(df.withColumn("n_points", F.lit(10_000_000))).first()
    assert dense.confidence == pytest.approx(min(r.confidence + 0.1, 1)) or z != z


def test_overrides_and_counts(spark):
    df = spark.createDataFrame([(1, "chair"), (2, "table"), (3, "table")], "cluster_id int, label string")
    new = spark.createDataFrame([(2, "shelf"), (9, "wall")], "cluster_id int, new_label string")
    assert {r.cluster_id: r.label for r in labels.override_labels(df, new).collect()} == {1: "chair", 2: "shelf", 3: "table"}
    assert {r.label: r.n for r in labels.label_counts(df).collect()} == {"chair": 1, "table": 2}
    assert Labeling().tall_furniture_min_h == 1.5


def test_hybrid_search_of_a_dense_cloud_is_by_the_neighbours_asked_for(spark, monkeypatch):
    """all pairs within the radius were made and sorted, with the square of the points in a fixed room."""
    rng, n, most = np.random.default_rng(3), 1200, 6
    xyz = np.r_[rng.uniform(0, 1, (n, 3)), np.repeat(rng.uniform(0, 1, (1, 3)), 9, 0), [[9.0, 9, 9], [9.5, 9, 9]]]
    made, near = [], neighbours._near
    monkeypatch.setattr(neighbours, "_near", lambda *a: (made.append(near(*a).count()), near(*a))[1])
    got = {}
    for r in neighbours.hybrid_neighbours(cloud(spark, xyz), 2.0, most).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = r.nbr_id
    d2 = square(xyz)
    for i in range(len(xyz)):
        order = sorted(np.flatnonzero(d2[i] <= 4.0), key=lambda k: (d2[i, k], k != i, k))[:most]
        assert [got[i][k + 1] for k in range(len(got[i]))] == order
    assert sum(made) < n * n / 5
