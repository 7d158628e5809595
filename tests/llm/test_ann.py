"""Neighbours against brute force: recall, verified share, exact scores, ties, and odd vectors."""

import numpy as np
import pandas as pd
import pytest

from cairn.llm import ann


def cosines(x, q):
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def brute(ids, x, q, k):
    s = cosines(x, x[q])
    order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def measured(got, ids, x, queries):
    """Recall of {query_id: rows} and the share of all vectors that a query verified."""
    hits = sum(len({r.vec_id for r in got[int(ids[q])]} & {i for i, _ in brute(ids, x, q, 5)}) for q in queries)
    return hits / 5 / len(queries), np.mean([got[int(ids[q])][0].n_verified for q in queries]) / len(x)


def found(df, is_query):
    got = {}
    for r in ann.nearest(df, is_query).collect():
        got.setdefault(r.query_id, []).append(r)
    return got


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1000, 32)).astype(np.float32)
    x[500:520] = x[0]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, id int")
    got = found(df, "id % 50 = 0")
    assert sorted(got) == list(range(0, 1000, 50))
    x = x.astype(np.float64)
    for q, rows in got.items():
        assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
        exact = dict(brute(np.arange(1000), x, q, 999))
        assert all(exact[r.vec_id] == r.score for r in rows)
    assert measured(got, np.arange(1000), x, list(got))[0] >= 0.9
    assert [r.vec_id for r in sorted(got[0], key=lambda r: r["rank"])] == [500, 501, 502, 503, 504]


def test_recall_and_verified_share_of_a_table(spark):
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").sort_values("vec_id")
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(np.float64)
    got = found(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "id % 50 = 0")
    recall, verified = measured(got, ids, x, np.flatnonzero(ids % 50 == 0))
    assert recall >= 0.9 and verified < 0.2, (recall, verified)


@pytest.mark.parametrize("clusters", [0, 500])
def test_recall_and_verified_share_of_many(spark, tmp_path, clusters):
    """50,000 vectors, all directions alike or in clusters; the latter reach few shards."""
    n, rng = 50_000, np.random.default_rng(8)
    x = rng.standard_normal((n, 64))
    if clusters:
        x = 0.25 * x + rng.standard_normal((clusters, 64))[rng.integers(0, clusters, n)]
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x)}).to_parquet(f"{tmp_path}/t.parquet")
    got = found(spark.read.parquet(f"{tmp_path}/t.parquet"), "id % 500 = 0")
    recall, verified = measured(got, np.arange(n), x, range(0, n, 500))
    assert recall >= 0.9 and verified < (0.02 if clusters else 0.2), (recall, verified)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.95, 0.05]), (50, [1.0, 0.1]), (50, [1.0, 0.1]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, "id = 0")
    want = sorted(((round(float(cosines(np.array([v]), np.array(rows[0][1]))[0]), 9), i) for i, v in rows[1:]), key=lambda t: (-t[0], t[1]))
    assert [(round(r.score, 9), r.vec_id) for r in sorted(got[0], key=lambda r: r["rank"])] == want
    twice = found(df, "id = 50")[50]  # each row with ranks of its own, the others among its candidates
    assert sorted(r["rank"] for r in twice) == sorted([1, 2, 3, 4, 5] * 3)
    assert sum(r.vec_id == 50 and abs(r.score - 1) < 1e-12 for r in twice) == 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, None), (7, []),
            (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (1, [2.0, 0.1]), (50, [0.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, "id % 50 = 0").collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 50), (50, 1, 1), (50, 2, 1), (50, 3, 0)]
    assert ann.nearest(df.limit(0), "id % 50 = 0").count() == 0
