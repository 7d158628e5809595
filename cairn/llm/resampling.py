"""Quality classification by importance resampling.

Two bags of hashed n-grams (words and punctuation runs, and pairs of them) are
counted: *raw* over all documents, *target* over labelled good ones.  A document's
log weight is the sum over its n-grams of log p_target - log p_raw.  Adding Gumbel
noise and keeping the k largest samples k documents without replacement in proportion
to their weights; those not drawn are rejected.  k comes from labelled good documents
held out from the target: it is the number of documents that weigh at least as much
as all but a ``miss`` share of them.

Texts are taken apart once; a table of their buckets (two bytes an n-gram) is counted
and then weighed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.bounded import small_table
from cairn.functions.lineage import settle, stash
from cairn.functions.names import prefix
from cairn.functions.ranks import kth_largest
from cairn.llm.shingles import coded_words, mix, slices
from cairn.llm.workers import arrow_batches, tidy

#: Hash buckets; most labelled rows used for the target.
BUCKETS, MOST_LABELLED = 8192, 20_000
MISS, SEED = 0.0005, 11
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """For each whole text, the bucket of every unigram and bigram.

    A slice's different words are taken apart into tokens once; a text's tokens are
    those of its words, in order.
    """
    for part in slices(texts):
        words, codes, offsets = coded_words(pc.utf8_split_whitespace(pc.utf8_lower(part)))
        tokens = [[xxhash.xxh3_64_intdigest(t) for t in map(str.encode, _TOKEN.findall(w.decode()))] for w in words]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        pool, first = np.fromiter(chain.from_iterable(tokens), np.uint64, int(size.sum())), np.cumsum(size) - size
        each = size[codes]
        ends = np.r_[0, np.cumsum(each)]
        h = pool[np.repeat(first[codes] - ends[:-1], each) + np.arange(ends[-1])]
        single, pairs = mix(h) % np.uint64(buckets), mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) % np.uint64(buckets)
        cut = ends[offsets].tolist()
        for a, b in zip(cut[:-1], cut[1:]):
            yield np.concatenate([single[a:b], pairs[a : max(a, b - 1)]]).astype(np.int64)


_GRAMS = "doc_id long, row_key long, grams binary"


def _take_apart(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [g.astype("<u2").tobytes() for g in ngram_buckets(batch.column(2), buckets)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], names=["doc_id", "row_key", "grams"])

    return tidy(run)


def _read(column: pa.Array) -> Iterator[np.ndarray]:
    for grams in column:
        yield np.frombuffer(grams.as_buffer(), "<u2")


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for grams, good in zip(_read(batch.column(0)), batch.column(1).to_pylist()):
                n = np.bincount(grams, minlength=buckets)
                raw += n
                if good:
                    target += n
        at = np.flatnonzero(raw)
        yield pa.record_batch([at, raw[at], target[at]], names=["bucket", "raw", "target"])

    return tidy(run)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket; the target leans on raw by one count a bucket."""
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + len(raw) * p_raw) / (target.sum() + len(raw)) / p_raw)


def gumbel(seed: int, key: int) -> float:
    u = (xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def _weigh(ratio: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [float(ratio[grams].sum()) for grams in _read(batch.column(2))]
            g = [x + gumbel(seed, k) for x, k in zip(w, batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(w, pa.float64()), pa.array(g, pa.float64())],
                                  names=["doc_id", "row_key", "log_weight", "draw"])

    return tidy(run)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_key"), text.alias("text"))


def _percentile(df: DataFrame, column: str, share: float) -> float | None:
    """Exact percentile of a written column, with linear interpolation; None of no rows."""
    n = df.count()
    if not n:
        return None
    at = (n - 1) * share
    first = int(at)
    low = kth_largest(df, column, n - first)
    return low if at == first else low + (kth_largest(df, column, n - first - 1) - low) * (at - first)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
             most_labelled: int = MOST_LABELLED, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, row_key, log_weight, draw, kept``.

    ``labels`` has ``doc_id, quality, toxic``; good is quality 1 and not toxic, null
    labels are not good, an id labelled twice counts once.  Null and empty texts weigh
    0.  Rows alike in id and text draw alike; rows that tie with the k-th are all kept.
    Without good labels there is no target, all weigh 0 and all are kept.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")
    spark = docs.sparkSession
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    half = F.pmod(F.xxhash64("good_id", F.lit(seed)), F.lit(2))
    order = F.xxhash64("good_id", F.lit(seed + 1))
    fit, held = good.where(half == 0).orderBy(order).limit(most_labelled), good.where(half == 1)

    def weighing() -> DataFrame:
        apart = stash(_keyed(docs, id_col, text_col).mapInArrow(_take_apart(buckets), _GRAMS))
        marked = apart.join(F.broadcast(fit), F.col("doc_id") == F.col("good_id"), "left")  # at most most_labelled ids
        counts = marked.select("grams", F.col("good_id").isNotNull().alias("good")).mapInArrow(_count(buckets), "bucket long, raw long, target long")
        raw, target = np.zeros(buckets), np.zeros(buckets)
        for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most buckets rows
            raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
        return apart.mapInArrow(_weigh(log_ratio(raw, target), seed), "doc_id long, row_key long, log_weight double, draw double")

    with arrow_batches(spark):
        weighed = settle(spark, weighing)
    floor = _percentile(stash(weighed.join(small_table(held), F.col("doc_id") == F.col("good_id")).select("log_weight")), "log_weight", miss)
    lowest = None
    if floor is not None:
        lowest = kth_largest(weighed, "draw", weighed.where(F.col("log_weight") >= floor).count())
    return weighed.withColumn("kept", F.lit(True) if lowest is None else F.col("draw") >= F.lit(lowest))


def keep_sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that resampling keeps, all their columns unchanged, whatever their names."""
    p = prefix(docs)
    gone = resample(docs, labels, id_col, text_col, **how).where("not kept").select(F.col("row_key").alias(f"{p}key")).distinct()
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return docs.withColumn(f"{p}row", key).join(gone, F.col(f"{p}row") == F.col(f"{p}key"), "left_anti").drop(f"{p}row")
