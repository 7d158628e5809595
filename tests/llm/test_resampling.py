"""Importance resampling: weights against a plain count, draws, and held-out accuracy."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.functions.ranks import kth_largest
from cairn.llm import resampling as r


def buckets(*texts):
    return [b.tolist() for b in r.ngram_buckets(pa.array(texts, pa.string()))]


def test_ngrams_of_whole_texts():
    assert [len(b) for b in buckets("one two, three", None, " \n", "w " * 50_000, "", "x")] == [4 + 3, 0, 0, 99_999, 0, 1]
    assert buckets("a b", "b c")[1] == buckets("b c")[0] and buckets(" One\u3000two ") == buckets("one two")


def corpus(n=400):
    rng = random.Random(2)
    good = [f"{a}{b}" for a in "bdfgklm" for b in "aeiou"]
    docs = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(w + "%%" for w in words) if i % 5 == 0 else " ".join(words)))
    return docs


def test_weights_and_top_k(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(2, 1, 0), (None, 1, 0), (4, None, None)],
                                   "doc_id long, quality int, toxic int")
    rows = r.resample(df, labels).collect()
    kept = [x for x in rows if x.kept]
    assert sum(x.doc_id % 5 > 0 for x in kept) >= 0.97 * 320
    assert sum(x.doc_id % 5 == 0 for x in kept) <= 8  # held-out accuracy
    assert min(x.draw for x in kept) > max(x.draw for x in rows if not x.kept)
    raw = np.zeros(r.BUCKETS)
    for _, t in docs:
        np.add.at(raw, buckets(t)[0], 1)
    assert all(math.isfinite(x.log_weight) for x in rows) and raw.sum() > 0


def plain_buckets(text):
    """The buckets by arithmetic on whole numbers: tokens of the lower-cased text, singly and in pairs."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return x ^ (x >> 32)

    h = [xxhash.xxh3_64_intdigest(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    return [mixed(x) % r.BUCKETS for x in h] + [mixed((x * 0x9E3779B97F4A7C15 + y) & mask) % r.BUCKETS for x, y in zip(h, h[1:])]


def test_weights_against_a_plain_count(spark):
    docs = [*corpus(150), (150, None), (151, ""), (152, "One, TWO... three-four? \u00dcber"), (153, "one two " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 150, 2)] + [(7, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    good = [x.doc_id for x in labels.where("quality = 1 and toxic = 0").where(F.pmod(F.xxhash64("doc_id", F.lit(r.SEED)), F.lit(2)) == 0).collect()]
    raw, target = [0] * r.BUCKETS, [0] * r.BUCKETS
    for d, t in docs:
        for b in plain_buckets(t):
            raw[b] += 1
            target[b] += d in good
    n, m, k = sum(raw), sum(target), r.BUCKETS
    p_raw = [(c + 1) / (n + k) for c in raw]
    ratio = [math.log((c + k * p) / (m + k) / p) for c, p in zip(target, p_raw)]
    rows = r.resample(df, labels).collect()
    assert m > 0 and len(rows) == len(docs)
    for x in rows:
        assert x.log_weight == pytest.approx(sum(ratio[b] for b in plain_buckets(dict(docs)[x.doc_id])), rel=1e-9, abs=1e-9)
    # ties: rows alike in id and text draw alike
    twice = r.resample(df.union(df), labels).groupBy("doc_id").agg(F.count_distinct("draw").alias("n"), F.count("*").alias("of"))
    assert {(x.n, x.of) for x in twice.collect()} == {(1, 2)}


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, 3)], ["doc_id", "text", "__row", "__key", "__ROW_"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert r.keep_sampled(df, none).collect() == df.collect()


def test_accuracy_on_the_held_out_half(spark):
    """Of a table's labelled documents those that the target was not fitted on."""
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = r.resample(spark.read.parquet(f"{path}/documents.parquet"), labels)
    fitted = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(r.SEED)), F.lit(2)) == 0
    told = rows.join(labels, "doc_id").where("quality = 0 or toxic = 0").withColumn("good", F.expr("quality = 1")).where(~(fitted & F.col("good")))
    found = {x.good: (x.kept, x.n) for x in told.groupBy("good").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert found[True][0] >= 0.99 * found[True][1] > 1000, found
    assert found[False][0] <= 0.2 * found[False][1], found


def test_log_ratio_is_zero_where_target_is_raw():
    raw = np.array([5.0, 0, 3])
    assert r.log_ratio(raw, np.zeros(3)).tolist() == [0, 0, 0]
    assert r.log_ratio(np.array([9.0, 1]), np.array([9.0, 0]))[1] < 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.kept for x in r.resample(df, none).collect()] == [True] * 4
    assert r.keep_sampled(df, none).columns == df.columns and r.keep_sampled(df, none).count() == 4
    assert r.resample(df.limit(0), none).count() == 0


@pytest.mark.parametrize("k", [1, 2, 777, 29_999, 30_000])
def test_kth_largest(spark, k):
    df = spark.range(30_000).selectExpr("cast(pmod(hash(id), 5000) as double) / 7 as x", "id")
    assert kth_largest(df, "x", k) == sorted((v[0] for v in df.select("x").collect()), reverse=True)[k - 1]
    assert kth_largest(df, "x", 30_001) is None


def test_floor_is_over_all_held_out(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    held = {x.doc_id for x in labels.where(F.pmod(F.xxhash64("doc_id", F.lit(r.SEED)), F.lit(2)) == 1).collect() if x.doc_id % 5}
    for share in (0.0, 0.05, 0.3):
        rows = r.resample(df, labels, most_labelled=10, miss=share).collect()
        floor = np.percentile([x.log_weight for x in rows if x.doc_id in held], 100 * share)
        k = sum(x.log_weight >= floor - 1e-9 for x in rows)
        assert len(held) > 100 and sum(x.kept for x in rows) == k
