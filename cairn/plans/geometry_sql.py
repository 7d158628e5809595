"""SQL for DuckDB of local frames, fills and plane extraction, as common table expressions.

They restate the operators' meaning by plain means: closed forms for the eigenvectors
of symmetric 3 x 3 matrices, all pairs, and recursion a step at a time.
"""

from __future__ import annotations

SQUARED = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


def _cross(u: tuple[str, ...], v: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i, j in ((1, 2), (2, 0), (0, 1)))


def eigenvectors(source: str, out: str) -> str:
    """CTEs that end in ``out``: the columns of ``source`` (xx xy xz yy yz zz among them) and unit
    eigenvectors (v0x, v0y, v0z) of the least, v1 of the middle, v2 of the largest eigenvalue.

    Shifted and scaled the matrix has the characteristic polynomial l^3 - 3 l - 2 r, whose
    roots are cosines; two Newton steps sharpen them.  The eigenvector is the longest
    cross product of two rows of the matrix less l.
    """
    scaled = {"a": "xx - q", "b": "yy - q", "c": "zz - q", "d": "xy", "e": "xz", "f": "yz"}
    newton = lambda x: f"{x} - CASE WHEN abs({x} * {x} - 1) > 1e-9 THEN ({x} * {x} * {x} - 3 * {x} - 2 * r) / (3 * {x} * {x} - 3) ELSE 0 END"
    parts = [
        f"{out}_q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM {source})",
        f"{out}_p AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM {out}_q)",
        f"{out}_s AS (SELECT *, " + ", ".join(f"CASE WHEN p > 0 THEN ({e}) / p ELSE 0 END AS s{n}" for n, e in scaled.items()) + f" FROM {out}_p)",
        f"{out}_r AS (SELECT *, greatest(-1, least(1, (sa * sb * sc + 2 * sd * se * sf - sa * sf * sf - sb * se * se - sc * sd * sd) / 2)) AS r FROM {out}_s)",
        f"{out}_l AS (SELECT *, 2 * cos(acos(r) / 3 + 2 * pi() / 3) AS l0, 2 * cos(acos(r) / 3 + 4 * pi() / 3) AS l1, 2 * cos(acos(r) / 3) AS l2 FROM {out}_r)",
    ]
    before = f"{out}_l"
    for turn in range(2):
        parts.append(f"{out}_n{turn} AS (SELECT * REPLACE (" + ", ".join(f"{newton(f'l{k}')} AS l{k}" for k in range(3)) + f") FROM {before})")
        before = f"{out}_n{turn}"
    crosses = []
    for k in range(3):
        rows = [(f"sa - l{k}", "sd", "se"), ("sd", f"sb - l{k}", "sf"), ("se", "sf", f"sc - l{k}")]
        for m, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
            crosses += [f"{e} AS c{k}{m}{axis}" for axis, e in zip("xyz", _cross(rows[i], rows[j]))]
    parts.append(f"{out}_c AS (SELECT *, {', '.join(crosses)} FROM {before})")
    size = lambda k, m: " + ".join(f"c{k}{m}{x} * c{k}{m}{x}" for x in "xyz")
    parts.append(f"{out}_d AS (SELECT *, " + ", ".join(f"{size(k, m)} AS d{k}{m}" for k in range(3) for m in range(3)) + f" FROM {out}_c)")
    chosen = lambda k, x: (f"CASE WHEN d{k}0 >= d{k}1 AND d{k}0 >= d{k}2 THEN c{k}0{x} / sqrt(d{k}0) WHEN d{k}1 >= d{k}2 THEN c{k}1{x} / sqrt(d{k}1) "  # noqa: E731
                           f"ELSE c{k}2{x} / sqrt(d{k}2) END AS v{k}{x}")
    parts.append(f"{out} AS MATERIALIZED (SELECT *, " + ", ".join(chosen(k, x) for k in range(3) for x in "xyz") + f" FROM {out}_d)")
    return ", ".join(parts)


def covariances(x: str, y: str, z: str) -> str:
    by = {"x": x, "y": y, "z": z}
    return ", ".join(f"covar_pop({by[n[0]]}, {by[n[1]]}) AS {n}" for n in ("xx", "xy", "xz", "yy", "yz", "zz"))


def normals(cloud: str, radius: float, most: int) -> str:
    """CTEs that end in ``normals`` (point_id, nx, ny, nz)."""
    turn = "CASE WHEN v0z < 0 OR (v0z = 0 AND (v0y < 0 OR (v0y = 0 AND v0x < 0))) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"
    return (
        f"pairs AS MATERIALIZED (SELECT a.point_id, b.point_id AS nbr_id, {SQUARED} AS d2, b.x AS px, b.y AS py, b.z AS pz FROM {cloud} a, {cloud} b), "
        f"within AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, nbr_id <> point_id, nbr_id) AS rank FROM pairs WHERE d2 <= {radius}::DOUBLE * {radius}::DOUBLE), "
        f"local AS (SELECT point_id, count(*) AS members, {covariances('px', 'py', 'pz')} FROM within WHERE rank <= {most} GROUP BY point_id), {eigenvectors('local', 'frame')}, "
        "normals AS MATERIALIZED (SELECT point_id, " + ", ".join(f"CASE WHEN members < 3 THEN {flat}::DOUBLE ELSE {turn} * v0{x} END AS n{x}" for x, flat in (("x", 0.0), ("y", 0.0), ("z", 1.0))) + " FROM frame)")


def nearest(k: int) -> str:
    """CTE ``nearest``: the k nearest other points, after ``normals``; and the absolute cosine of the normals."""
    return (f"nearest AS MATERIALIZED (SELECT t.point_id, t.nbr_id, t.rank, abs(m.nx * n.nx + m.ny * n.ny + m.nz * n.nz) AS alike FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY point_id ORDER BY d2, nbr_id) AS rank FROM pairs WHERE point_id <> nbr_id) t JOIN normals m ON m.point_id = t.point_id "
            f"JOIN normals n ON n.point_id = t.nbr_id WHERE t.rank <= {k})")


def curvature(cloud: str) -> str:
    return (f"bent AS MATERIALIZED (SELECT c.point_id, coalesce(1 - avg(alike), 1.0::DOUBLE) AS curvature FROM {cloud} c LEFT JOIN nearest USING (point_id) GROUP BY c.point_id)")


def components(edges: str, nodes: str) -> str:
    """CTEs that end in ``roots`` (point_id, root): the least point that edges (a, b) reach either way."""
    return (f"ways AS MATERIALIZED (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}), "
            f"reach(id, root) AS (SELECT point_id, point_id FROM {nodes} UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.id WHERE reach.root < ways.b), "
            "roots AS (SELECT id AS point_id, min(root) AS root FROM reach GROUP BY id)")


def fill(angle: float, bend: float, least: int, most: int) -> str:
    """CTEs that end in ``filled`` (region_id, point_id), after ``nearest`` and ``bent``: one step of the greedy fill at a time.

    A state holds the queue, the places taken, the open region's members and the regions
    done; places are ranks by (curvature, point_id).
    """
    return (
        "placed AS MATERIALIZED (SELECT point_id, curvature, row_number() OVER (ORDER BY curvature, point_id)::INTEGER AS i FROM bent), "
        "near_of AS (SELECT p.i, list(q.i ORDER BY t.rank) AS near FROM nearest t JOIN placed p ON p.point_id = t.point_id JOIN placed q ON q.point_id = t.nbr_id "
        f"WHERE t.alike >= cos(radians({angle}::DOUBLE)) GROUP BY p.i), "
        f"whole AS MATERIALIZED (SELECT list(coalesce(near, []::INTEGER[]) ORDER BY p.i) AS near, list(p.curvature < {bend}::DOUBLE ORDER BY p.i) AS flat, count(*)::INTEGER AS n "
        "FROM placed p LEFT JOIN near_of USING (i)), "
        "state(queue, taken, members, done, ended) AS (SELECT []::INTEGER[], []::INTEGER[], []::INTEGER[], []::INTEGER[][], false "
        "UNION ALL SELECT CASE WHEN ended_now THEN [] WHEN start IS NOT NULL THEN [start] ELSE list_concat(queue[2:], list_filter(fresh, lambda x: flat[x])) END, "
        "CASE WHEN start IS NOT NULL THEN list_append(taken, start) ELSE list_concat(taken, fresh) END, "
        "CASE WHEN start IS NOT NULL THEN [start] ELSE list_concat(members, fresh) END, closed, ended_now FROM ("
        f"SELECT *, len(queue) = 0 AND (start IS NULL OR len(closed) >= {most}) AS ended_now FROM ("
        f"SELECT s.*, w.flat, CASE WHEN len(queue) = 0 AND len(members) >= {least} THEN list_append(done, members) ELSE done END AS closed, "
        "CASE WHEN len(queue) = 0 THEN list_filter(range(1, w.n + 1), lambda x: NOT list_contains(s.taken, x::INTEGER))[1]::INTEGER END AS start, "
        "CASE WHEN len(queue) > 0 THEN list_filter(w.near[queue[1]], lambda x: NOT list_contains(s.taken, x)) ELSE []::INTEGER[] END AS fresh "
        "FROM state s, whole w WHERE NOT s.ended))), "
        "regions AS (SELECT done, unnest(range(1, len(done) + 1)) AS k FROM state WHERE ended), "
        "filled AS (SELECT (k - 1)::INTEGER AS region_id, p.point_id FROM (SELECT k, unnest(done[k]) AS i FROM regions) r JOIN placed p USING (i))")


def planes_of(points: str, rounds: int, iterations: int, distance: float, least_plane: int, least_points: int, seed: int,
              modulus: int, multiplier: int, again: int) -> str:
    """CTEs that end in ``planes`` (plane_id, inlier_count, n_dropped, centroid_z, a, b, c, d) of a cloud, round after round."""
    least = max(least_points, 3)
    point, hash_ = f"((p.point_id % {modulus} + {modulus}) % {modulus})", "h"
    hit = f"abs(a * x + b * y + c * z + d) <= {distance}::DOUBLE"
    out = [f"p0 AS MATERIALIZED (SELECT point_id, x, y, z FROM {points})"]
    for k in range(rounds):
        hash_ = f"(({point} * {multiplier} + {seed + k} + turn * {again}) % {modulus})"
        corners = ", ".join(f"max(CASE WHEN rn % 3 = {i} THEN {c} END) AS {c}{i}" for i in range(3) for c in "xyz")
        out += [
            f"t{k} AS MATERIALIZED (SELECT count(*) AS n, count(*) // 3 AS triples FROM p{k})",
            f"o{k} AS (SELECT p.*, turn, triples, row_number() OVER (PARTITION BY turn ORDER BY ({hash_} * {hash_} + {point}) % {modulus}, p.point_id) - 1 AS rn "
            f"FROM p{k} p, (SELECT triples, unnest(range(0, least(ceil({iterations} / nullif(triples, 0)), {iterations})::BIGINT)) AS turn FROM t{k} WHERE n >= {least}) u)",
            f"c{k} AS (SELECT turn * triples + rn // 3 AS h, {corners} FROM o{k} WHERE rn < 3 * triples AND turn * triples + rn // 3 < {iterations} GROUP BY 1 HAVING count(*) = 3)",
            f"n{k} AS (SELECT *, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS na, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS nb, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS nc FROM c{k})",
            f"u{k} AS (SELECT *, sqrt(na*na + nb*nb + nc*nc) AS size FROM n{k} WHERE sqrt(na*na + nb*nb + nc*nc) >= 1e-9)",
            f"s{k} AS (SELECT *, CASE WHEN nc/size < 0 OR (nc/size = 0 AND (nb/size < 0 OR (nb/size = 0 AND na/size < 0))) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM u{k})",
            f"m{k} AS (SELECT h, sign*(na/size) AS a, sign*(nb/size) AS b, sign*(nc/size) AS c, x0, y0, z0 FROM s{k})",
            f"h{k} AS MATERIALIZED (SELECT h, a, b, c, -(a*x0 + b*y0 + c*z0) AS d FROM m{k})",
            f"b{k} AS MATERIALIZED (SELECT * FROM (SELECT h, count(*) AS n_inliers, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d "
            f"FROM h{k}, p{k} WHERE {hit} GROUP BY h ORDER BY n_inliers DESC, h LIMIT 1) WHERE n_inliers >= {least_plane})",
            f"i{k} AS MATERIALIZED (SELECT {k} AS plane_id, p.* FROM p{k} p, b{k} WHERE {hit})",
            f"p{k + 1} AS MATERIALIZED (SELECT p.* FROM p{k} p, b{k} WHERE NOT ({hit}))",
        ]
    eps = 5 * distance
    out += [
        "hits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM i{k}" for k in range(rounds)) + ")",
        "best AS (" + " UNION ALL ".join(f"SELECT {k} AS plane_id, * FROM b{k}" for k in range(rounds)) + ")",
        f"close AS MATERIALIZED (SELECT a.plane_id, a.point_id AS a, b.point_id AS b FROM hits a JOIN hits b ON a.plane_id = b.plane_id WHERE {SQUARED} <= {eps}::DOUBLE * {eps}::DOUBLE)",
        "cores AS MATERIALIZED (SELECT plane_id, a AS point_id FROM close GROUP BY 1, 2 HAVING count(*) >= 10)",
        "links AS MATERIALIZED (SELECT close.* FROM close JOIN cores q ON q.plane_id = close.plane_id AND q.point_id = a JOIN cores r ON r.plane_id = close.plane_id AND r.point_id = b)",
        "spread(plane_id, id, root) AS (SELECT plane_id, point_id, point_id FROM cores UNION SELECT l.plane_id, l.b, s.root FROM spread s JOIN links l "
        "ON l.plane_id = s.plane_id AND l.a = s.id WHERE s.root < l.b)",
        "core_root AS MATERIALIZED (SELECT plane_id, id AS point_id, min(root) AS root FROM spread GROUP BY 1, 2)",
        "edge_root AS (SELECT close.plane_id, a AS point_id, min(root) AS root FROM close JOIN core_root r ON r.plane_id = close.plane_id AND r.point_id = b "
        "WHERE (close.plane_id, a) NOT IN (SELECT (plane_id, point_id) FROM cores) GROUP BY 1, 2)",
        "rooted AS MATERIALIZED (SELECT * FROM core_root UNION ALL SELECT * FROM edge_root)",
        "largest AS (SELECT plane_id, arg_min(root, (-n, root)) AS root FROM (SELECT plane_id, root, count(*) AS n FROM rooted GROUP BY 1, 2) GROUP BY 1)",
        "members AS (SELECT i.* FROM hits i LEFT JOIN rooted r ON r.plane_id = i.plane_id AND r.point_id = i.point_id LEFT JOIN largest g ON g.plane_id = i.plane_id "
        "JOIN best ON best.plane_id = i.plane_id WHERE n_inliers < 10 OR g.root IS NULL OR r.root = g.root)",
        "planes AS (SELECT plane_id, count(*) AS inlier_count, any_value(n_inliers) - count(*) AS n_dropped, median(z) AS centroid_z, any_value(a) AS a, any_value(b) AS b, "
        "any_value(c) AS c, any_value(d) AS d FROM members JOIN best USING (plane_id) GROUP BY plane_id)",
    ]
    return ", ".join(out)
