"""Files in and out, settings, schemas, scores, and the scene pipeline."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import config
from cairn.functions.colours import LABEL_COLOURS, colorize
from cairn.functions.components import connected_components
from cairn.operators import evaluate
from cairn.plans.scene import run, segment
from cairn.schemas import POINT, require_valid, violations
from cairn.sinks import writers
from cairn.sources import synthetic
from cairn.sources.load import load_cloud
from cairn.sources.reports import evaluate_files, read_labels
from cairn.sources.text import read_annotated_room
from cairn.streaming.scenes import segment_stream, watch_points


def test_formats(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("0 0 0\n1.5 2 3\n\n# comment\n")
    (tmp_path / "a.xyzrgb").write_text("0,0,0,0.5,0.25,1\n")
    (tmp_path / "a.pts").write_text("2\n0 0 0 7 255 0 51\n1 1 1 7 0 255 0\n")
    (tmp_path / "a.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\n"
                                     b"property uchar green\nproperty uchar blue\nend_header\n0 0 0 255 0 0\n1 2 3 0 51 0\n")
    head = b"ply\nformat binary_%s_endian 1.0\nelement vertex 1\nproperty double x\nproperty double y\nproperty double z\nproperty float nx\nproperty float ny\nproperty float nz\nend_header\n"
    (tmp_path / "l.ply").write_bytes(head % b"little" + struct.pack("<dddfff", 1, 2, 3, 0, 0, 1))
    (tmp_path / "b.ply").write_bytes(head % b"big" + struct.pack(">dddfff", 1, 2, 3, 0, 0, 1))
    (tmp_path / "a.pcd").write_bytes(b"VERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F U\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA binary\n" + struct.pack("<fffI", 1, 2, 3, 0xFF0033))
    (tmp_path / "t.pcd").write_text("VERSION .7\nFIELDS x y z normal_x\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n1 2 3 0.5\n")
    rows = lambda name: load_cloud(spark, str(tmp_path / name)).orderBy("x").collect()
    assert [(r.x, r.y, r.z) for r in rows("a.xyz")] == [(0, 0, 0), (1.5, 2, 3)]
    assert (rows("a.xyzrgb")[0].r, rows("a.xyzrgb")[0].b) == (0.5, 1)
    assert [r.r for r in rows("a.pts")] == [1, 0] and rows("a.pts")[0].b == pytest.approx(0.2)
    assert [r.r for r in rows("a.ply")] == [1, 0] and rows("a.ply")[1].g == pytest.approx(0.2)
    for name in ("l.ply", "b.ply"):
        assert (rows(name)[0].z, rows(name)[0].nz, rows(name)[0].r) == (3, 1, None)
    assert rows("a.pcd")[0].b == pytest.approx(0.2) and rows("t.pcd")[0].nx == 0.5
    with pytest.raises(ValueError):
        load_cloud(spark, "no/such.obj")  # the suffix is looked at first
    with pytest.raises(FileNotFoundError):
        load_cloud(spark, str(tmp_path / "none.PLY"))
    (tmp_path / "empty.xyz").write_text("")
    with pytest.raises(ValueError):
        load_cloud(spark, str(tmp_path / "empty.xyz"))


def test_annotated_room(spark, tmp_path):
    room = tmp_path / "room"
    (room / "Annotations").mkdir(parents=True)
    (room / "Annotations" / "b.txt").write_text("1 1 1 255 0 51\n2 2 2 255 0 51\n")
    (room / "Annotations" / "a.txt").write_text("0 0 0\n")
    (room / "Annotations" / "bad.txt").write_text("5 5 5 1 1 1\nnot a row\n")
    rows = read_annotated_room(spark, str(room)).orderBy("x").collect()
    assert [r.x for r in rows] == [0, 1, 2] and rows[0].r == pytest.approx(128 / 255) and rows[1].b == pytest.approx(0.2)
    with pytest.raises(RuntimeError):
        read_annotated_room(spark, str(tmp_path))


def test_ply_round_trip_and_limits(spark, tmp_path):
    df = synthetic.box(spark, 50, (0, 1), (0, 1), (0, 1)).selectExpr("'0' scene_id", "n point_id", "x", "y", "z", "0.2 r", "1.0 g", "cast(null as double) b")
    path = writers.write_ply(df, str(tmp_path / "deep" / "out.ply"))
    back = load_cloud(spark, path).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z) for r in back] == [(r.x, r.y, r.z) for r in df.orderBy("point_id").collect()]
    assert back[0].r == pytest.approx(0.2, abs=1e-9) and back[0].b == pytest.approx(128 / 255)
    with pytest.raises(ValueError):
        writers.write_ply(df.limit(0), path)


def test_settings(tmp_path):
    assert config.PipelineConfig().ransac.num_iterations == 2000
    (tmp_path / "c.yaml").write_text("preprocessing:\n  voxel_size: 0.03\n  denoising_method: sor\n  sor: {nb_neighbors: 10}\nransac: {distance_threshold: 0.01}\n")
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert (c.preprocessing.voxel_size, c.preprocessing.sor.nb_neighbors, c.preprocessing.sor.std_ratio, c.ransac.distance_threshold) == (0.03, 10, 2.0, 0.01)
    for bad in ({"dbscan": {"eps": 0}}, {"ransac": {"ransac_n": 2}}, {"labeling": {"ceiling_z_fraction": 1.5}}, {"ransac": {"max_planes": 1.5}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)


def test_row_checks(spark):
    good = ("0", 0, "floor", 5, 0.0, [0.0, 0.0, 1.0], [0.0, 0.0, 1.0, 0.0])
    kind = "scene_id string, plane_id int, label string, inlier_count long, centroid_z double, normal array<double>, plane_model array<double>"
    bad = [("0", 1, "sofa", 5, 0.0, [0.0, 0.0, 0.0], [0.0]), ("0", 2, "wall", -1, 0.0, [1.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0])]
    assert require_valid(spark.createDataFrame([good], kind), "plane").count() == 1
    found = {r.plane_id: r.faults for r in violations(spark.createDataFrame([good, *bad], kind), "plane").collect()}
    assert len(found[1]) == 3 and found[2] == ["inlier_count is negative"]
    with pytest.raises(ValueError):
        require_valid(spark.createDataFrame(bad, kind), "plane")


def test_colours(spark):
    rows = colorize(spark.createDataFrame([(k,) for k in [*LABEL_COLOURS, "sofa", None]], "label string")).collect()
    for r in rows:
        assert (r.r, r.g, r.b) == LABEL_COLOURS.get(r.label, LABEL_COLOURS["unknown"])


def test_scores(spark):
    rows = [(0, "floor", "floor"), (1, "floor", "wall"), (2, "wall", "wall"), (3, "chair", "chair"), (4, "wall", "sofa")]
    pairs = spark.createDataFrame(rows, "position int, true_label string, pred_label string")
    matrix = {(r.true_label, r.pred_label): r.n for r in evaluate.confusion_matrix(pairs).collect()}
    assert len(matrix) == 100 and sum(matrix.values()) == 3 and matrix[("floor", "wall")] == 1
    by = {r.label: r for r in evaluate.per_class(pairs).collect()}
    assert (by["floor"].precision, by["floor"].recall, by["floor"].f1, by["floor"].support) == (1.0, 0.5, 0.6667, 2)
    assert by["wall"].precision == 0.5 and by["ceiling"].f1 == 0 and evaluate.accuracy(pairs).first()[0] == 0.6
    assert evaluate.accuracy(pairs, 10).first()[0] == 0.3 and evaluate.accuracy(pairs.limit(0)).first()[0] == 0
    assert {r.label for r in evaluate.report(pairs).collect()} == {"floor", "wall"}


def test_scores_of_files(spark, tmp_path):
    told = lambda *x: json.dumps({"structural_planes": [{"label": x[0], "normal": [0, 0, 1]}], "objects": [{"label": k} for k in x[1:]]})
    (tmp_path / "p.json").write_text(told("floor", "chair", "shelf"))
    (tmp_path / "t.json").write_text(told("floor", "table", "shelf", "wall"))
    assert [r.label for r in read_labels(spark, str(tmp_path / "t.json")).orderBy("position").collect()] == ["floor", "table", "shelf", "wall"]
    assert evaluate_files(spark, str(tmp_path / "p.json"), str(tmp_path / "t.json"))["accuracy"].first()[0] == 0.5  # over the true labels


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {500: 500, 501: 500}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_written_tables_and_their_folder(spark, monkeypatch):
    from cairn.functions import lineage

    df = lineage.stash(spark.range(5))
    assert df.count() == 5 and df.columns == ["id"]
    monkeypatch.setattr(lineage, "SETTING", "spark.cairn.unset")  # where the cluster names no folder
    assert lineage.shared_dir(spark) == lineage.shared_dir(spark) and lineage.shared_dir(spark).startswith("file:///")
    assert lineage.stash(spark.range(3)).count() == 3


def test_synthetic_rooms(spark):
    room = synthetic.synthetic_room(spark, density=200, share=0.1)
    counts = {r.part: r["count"] for r in room.groupBy("part").count().collect()}
    assert counts["floor"] == 200 and counts["wall"] == 800 and counts["desk"] == 500 and counts["noise"] == 500
    assert synthetic.l_shaped_room(spark, 5, 6, 3, 100).count() == 750
    assert synthetic.furniture(spark).count() == 28_500
    assert room.where("part = 'floor'").agg(F.max(F.abs("z"))).first()[0] < 0.1
    again = synthetic.synthetic_room(spark, density=200, share=0.1)
    assert room.where("part = 'desk'").agg(F.sum("x")).first() == again.where("part = 'desk'").agg(F.sum("x")).first()


def small_room(spark):
    rng = np.random.default_rng(99)
    flat = lambda n, z: np.c_[rng.uniform(0, 2, n), rng.uniform(0, 2, n), np.full(n, z)]
    wall = np.c_[np.zeros(350), rng.uniform(0, 2, 350), rng.uniform(0, 2, 350)]
    desk = rng.uniform(0, 1, (260, 3)) * [0.6, 0.6, 0.5] + [0.9, 0.9, 0.25]
    rows = [("0", i, *map(float, p)) for i, p in enumerate(np.vstack([flat(500, 0.0), flat(450, 2.0), wall, desk]))]
    return spark.createDataFrame(rows, "scene_id string, point_id long, x double, y double, z double")


SETTINGS = {
    "preprocessing": {"voxel_size": 0.01, "sor": {"nb_neighbors": 10, "std_ratio": 3.0}, "normal_estimation": {"radius": 0.3, "max_nn": 20}},
    "ransac": {"distance_threshold": 0.04, "num_iterations": 150, "min_plane_size": 200, "max_planes": 4, "remaining_points_min": 50},
    "dbscan": {"eps": 0.2, "min_points": 6, "min_cluster_points": 50, "max_object_size": 3.0},
}


def test_scene_from_file_to_files(spark, tmp_path):
    source = str(tmp_path / "room.xyz")
    with open(source, "w") as f:
        f.writelines(f"{r.x} {r.y} {r.z}\n" for r in small_room(spark).collect())
    out = {"ply": str(tmp_path / "o/room.ply"), "report": str(tmp_path / "o/report.json"), "topdown": str(tmp_path / "o/map")}
    found = run(spark, source, config.from_dict(SETTINGS | {"output": out}))
    assert {r.label for r in found.planes.collect()} >= {"floor", "ceiling", "wall"}
    objects = found.clusters.collect()
    assert len(objects) >= 1 and objects[0].obb_extent is not None and 0 <= objects[0].confidence <= 1
    told = json.load(open(out["report"]))
    assert len(told["structural_planes"]) == found.planes.count() and len(told["objects"]) == len(objects)
    assert "aabb_min" not in told["objects"][0]
    merged = load_cloud(spark, out["ply"])
    assert merged.count() == found.plane_members.count() + found.cluster_members.count()
    assert spark.read.parquet(out["topdown"] + "/walls").count() > 0
    assert set(found.seconds) == {"statistics", "voxels", "outliers", "normals", "planes", "objects", "labels"}
    kept = found.clean.count()
    dropped = found.planes.agg(F.sum("n_dropped")).first()[0]
    assert found.plane_members.count() + dropped + found.residual.count() == kept
    labels = writers.write_labels(found.clusters, str(tmp_path / "o/labels.json"))
    assert [r["id"] for r in json.load(open(labels))] == list(range(len(objects)))


def test_nothing_found(spark, tmp_path):
    found = segment(small_room(spark).limit(30).select("*"), config.from_dict({"preprocessing": {"voxel_size": 0.01}}), normals=False)
    assert found.planes.count() == 0 and found.clusters.count() == 0
    assert writers.topdown_layers(found.plane_members, found.planes, found.cluster_members, found.clusters) is None
    path = writers.write_report(found.planes, found.clusters, str(tmp_path / "r.json"))
    assert json.load(open(path)) == {"structural_planes": [], "objects": []}


def test_scenes_as_they_arrive(spark, tmp_path):
    from cairn.schemas import points

    points(small_room(spark)).write.parquet(str(tmp_path / "in"))
    seen = []
    query = segment_stream(watch_points(spark, str(tmp_path / "in")), lambda found, n: seen.append((n, found.planes.count())), str(tmp_path / "ck"),
                           config.from_dict(SETTINGS))
    query.awaitTermination(200)
    assert query.exception() is None and seen and seen[0][1] >= 3
    assert POINT.startswith("scene_id")
