"""Odd inputs that once hung, overflowed, or lost rows: stray points, repeated ids, large ids, several files, shared folders."""

import struct
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from cairn.functions import bounded, lineage
from cairn.functions.names import prefix
from cairn.operators.neighbours import nearest_neighbours
from cairn.operators.outliers import statistical_outliers
from cairn.operators.ransac import best_planes, hypotheses
from cairn.sources.binary import FILE_IDS, parse_pcd, read_binary_cloud, unpacked
from cairn.sources.text import read_annotated_room, read_text_cloud


def cloud(spark, xyz, ids=None):
    ids = range(len(xyz)) if ids is None else ids
    return spark.createDataFrame([("0", int(i), *map(float, p)) for i, p in zip(ids, xyz)], "scene_id string, point_id long, x double, y double, z double")


def plain_nearest(xyz, k):
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(xyz)), d2[i]))[:k]] for i in range(len(xyz))}


def test_neighbours_with_stray_points(spark):
    rng = np.random.default_rng(3)
    xyz = np.r_[rng.random((400, 3)), 100 + 100 * rng.random((40, 3))]
    got = {}
    for r in nearest_neighbours(cloud(spark, xyz), 5).collect():
        got.setdefault(r.point_id, {})[r["rank"]] = r.nbr_id
    assert {i: [g[k] for k in sorted(g)] for i, g in got.items()} == plain_nearest(xyz, 5)
    outliers = statistical_outliers(cloud(spark, xyz), 20, 2.0)[1]
    assert {r.point_id for r in outliers.collect()} <= set(range(400, 440))


def test_neighbours_of_repeated_ids_end(spark):
    xyz = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 9)]
    assert nearest_neighbours(cloud(spark, xyz[:2], [7, 7]), 1).count() == 0
    rows = nearest_neighbours(cloud(spark, xyz, [7, 7, 8, 9]), 3).collect()
    assert {(r.point_id, r.nbr_id) for r in rows} == {(7, 8), (7, 9), (8, 7), (8, 9), (9, 7), (9, 8)}


def test_large_ids_and_small_scenes_get_all_hypotheses(spark):
    rng = np.random.default_rng(0)
    xyz = np.c_[rng.random((40, 2)), np.zeros(40)]
    far = cloud(spark, xyz, [(1 << 62) + 12345 * k for k in range(40)])
    found = [r.hypothesis for r in hypotheses(far, 100).collect()]
    assert sorted(found) == list(range(100))
    assert best_planes(far, 0.01, 100).first().n_inliers == 40


def test_planes_through_more_points(spark):
    rng = np.random.default_rng(1)
    flat = np.c_[rng.random((300, 2)), 1 + rng.normal(0, 0.002, 300)]
    best = best_planes(cloud(spark, np.r_[flat, rng.random((40, 3))]), 0.02, 200, samples=5).first()
    assert best.n_inliers >= 300 and abs(best.model[2]) > 0.99
    line = cloud(spark, [(k, 2 * k, 3 * k) for k in range(12)])
    assert hypotheses(line, 5, samples=4).count() == 0


def test_ids_of_text_files_follow_names_and_lines(spark, tmp_path):
    (tmp_path / "Annotations").mkdir()
    for name, rows in (("b_1", 3), ("a_2", 2), ("c_1", 4)):
        (tmp_path / "Annotations" / f"{name}.txt").write_text("".join(f"{ord(name[0])} {k} 0 1 2 3\n" for k in range(rows)))
    got = [(r.point_id, r.x, r.y) for r in read_annotated_room(spark, str(tmp_path)).orderBy("point_id").collect()]
    assert got == [(i, float(x), float(y)) for i, (x, y) in enumerate([(97, 0), (97, 1), (98, 0), (98, 1), (98, 2), (99, 0), (99, 1), (99, 2), (99, 3)])]
    (tmp_path / "t.xyz").write_text("".join(f"{k} 0 0\n" for k in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        df = read_text_cloud(spark, f"{tmp_path}/t.xyz", dense=True)
        assert df.rdd.getNumPartitions() > 1 and df.where("point_id = x").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_command_line(spark, tmp_path, capsys):
    from cairn.__main__ import main

    main(["generate", "--output", f"{tmp_path}/room.ply", "--density", "50"])
    (tmp_path / "c.yaml").write_text(f"output: {{ply: {tmp_path}/o.ply, report: {tmp_path}/r.json, topdown: {tmp_path}/map}}\n"
                                     "preprocessing: {voxel_size: 0.3}\nransac: {min_plane_size: 50, num_iterations: 50, max_planes: 2}\n")
    main(["segment", "--input", f"{tmp_path}/room.ply", "--config", f"{tmp_path}/c.yaml", "--no-topdown"])
    assert (tmp_path / "r.json").exists()
    (tmp_path / "t.json").write_text('{"structural_planes": [{"label": "floor"}, {"label": "wall"}], "objects": [{"label": "furniture"}]}')
    main(["evaluate", "--predicted", f"{tmp_path}/t.json", "--truth", f"{tmp_path}/t.json"])
    told = capsys.readouterr().out
    assert " planes, " in told and "accuracy 1.0000" in told and "furniture" in told


def lzf(data):
    """Literals, and one copy of a run of zeros."""
    out, at = b"", 0
    while at < len(data):
        run = len(data) - len(data[at:].lstrip(b"\0")) - at
        if run > 12:
            n = min(run - 1, 260)
            out += bytes([0, 0, 7 << 5 | 0, n - 9, 0])
            at += 1 + n
        else:
            part = data[at : at + min(32, 12)]
            out += bytes([len(part) - 1]) + part
            at += len(part)
    return out


def test_pcd_compressed_and_fields_of_several_values():
    n = 50
    xyz = np.arange(3 * n, dtype="<f4").reshape(n, 3) % 7
    head = "VERSION .7\nFIELDS x y z hist\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 3\nPOINTS %d\nDATA %s\n"
    hist = np.zeros((n, 3), "<f4")
    rows = np.concatenate([xyz, hist], 1).astype("<f4")
    by_field = b"".join(xyz[:, k].tobytes() for k in range(3)) + hist.tobytes()
    packed = lzf(by_field)
    assert len(packed) < len(by_field) and unpacked(packed, len(by_field)) == by_field
    for form, body in (("binary", rows.tobytes()), ("binary_compressed", struct.pack("<II", len(packed), len(by_field)) + packed),
                       ("ascii", "\n".join(" ".join(map(str, r)) for r in rows).encode())):
        df = parse_pcd((head % (n, form)).encode() + body)
        assert list(df.columns) == ["x", "y", "z"] and np.array_equal(df.to_numpy(), xyz)
    with pytest.raises(ValueError):
        unpacked(packed, 3)


def test_ids_of_several_files_are_unique(spark, tmp_path):
    for name, points in (("b", 2), ("a", 3)):
        body = "\n".join(f"{k} 0 0" for k in range(points))
        (tmp_path / f"{name}.pcd").write_text(f"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nPOINTS {points}\nDATA ascii\n{body}\n")
    rows = read_binary_cloud(spark, f"{tmp_path}/*.pcd", ".pcd").collect()
    assert sorted((r.point_id, r.x) for r in rows) == [(0, 0.0), (1, 1.0), (2, 2.0), (FILE_IDS, 0.0), (FILE_IDS + 1, 1.0)]


def test_no_local_folder_off_this_machine(spark):
    def session(master):
        conf = SimpleNamespace(get=lambda *a: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="x", getConf=lambda: conf))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            lineage.shared_dir(session(master))
    assert lineage.shared_dir(spark)


def test_settled_tables_leave_nothing_on_the_way(spark):
    made = []

    def make():
        made.append(lineage.stash(spark.range(5)))
        return lineage.settle(spark, lambda: made[0].where("id > 1"))

    table = lineage.settle(spark, make)
    assert sorted(r.id for r in table.collect()) == [2, 3, 4]
    with pytest.raises(Exception):
        spark.read.parquet(*made[0].inputFiles()).count()
    lineage.discard(table)
    with pytest.raises(Exception):
        table.collect()


def test_broadcasts_are_bounded_in_bytes(spark):
    wide = spark.range(100).selectExpr("repeat('x', 1000) as s", "array(id) as a")
    assert bounded.is_small(wide) and not bounded.is_small(wide, most_bytes=50_000) and not bounded.is_small(wide, most_rows=99)
    assert bounded.is_small(wide.limit(0))


def test_prefix_clashes_with_nothing(spark):
    df = spark.createDataFrame(pd.DataFrame({"__T": [1], "___x": [2], "a": [3]}))
    assert not any(c.lower().startswith(prefix(df)) for c in df.columns)
