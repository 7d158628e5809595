"""Substring deduplication over sliding spans of sentences.

Every run of at least ``least`` consecutive sentences is a span (with ``words``, only
runs of so many words).  It is enough to hash, for each sentence, the shortest run from
it on and the shortest up to it: any sentence of a longer repeated run lies in one of
these within it, so they cover what all runs cover.  Spans are hashed and joined
globally; in order of (doc_id, position) the first of equal spans stays, and sentences
covered by any other are removed.

Counting and finding the first of each hash is an aggregation, which sums up copies
before its shuffle; only hashes found twice are joined back, and AQE can split that
join where a span is very common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.lineage import stash
from cairn.llm.shingles import mix
from cairn.llm.workers import arrow_batches, tidy

SENTENCES = 2
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def segments(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences, with the white space after them; together the whole text."""
    text = text or ""
    out, start = [], 0
    for m in _END.finditer(text):
        if text[start : m.end()].strip():
            out.append((start, m.end()))
            start = m.end()
    if start < len(text):
        if text[start:].strip() or not out:
            out.append((start, len(text)))
        else:
            out[-1] = (out[-1][0], len(text))
    return out


def spans(text: str | None, least: int = SENTENCES, words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and end sentence (exclusive) of every span of a text."""
    parts = [text[a:b].strip() for a, b in segments(text)] if text else []
    n = len(parts)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    h = np.fromiter((xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts), np.uint64, n)
    size = np.r_[0, np.cumsum([p.count(" ") + 1 for p in parts])]
    start = np.arange(n)
    end = np.maximum(np.searchsorted(size, size[:-1] + words), start + least)
    until = np.arange(1, n + 1)
    since = np.minimum(np.searchsorted(size, size[1:] - words, "right") - 1, until - least)
    # those that are the shortest from their start are there already
    new = (since >= 0) & (end[np.maximum(since, 0)] != until)
    ok = end <= n
    start, end = np.r_[start[ok], since[new]], np.r_[end[ok], until[new]]
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(mix(h) * _powers(_BASE, n - 1), dtype=np.uint64)]
        value = mix((total[end] - total[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    return value.view(np.int64), start, end


_FOUND = "hash long, doc_id long, text_key long, first int, last int"


def _find(least: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            hashes, rows, first, last = [], [], [], []
            for k, text in enumerate(batch.column(2)):
                h, a, b = spans(text.as_py(), least, words)
                hashes.append(h)
                first.append(a)
                last.append(b)
                rows.append(np.full(len(h), k))
            at = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64), pa.int64())
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
            yield pa.record_batch([cat(hashes, pa.int64()), ids.take(at), keys.take(at), cat(first, pa.int32()), cat(last, pa.int32())],
                                  names=["hash", "doc_id", "text_key", "first", "last"])

    return tidy(run)


_OUT = "doc_id long, text_key long, n_sentences int, n_removed int, removed_chars long, text string, first_doc_ids array<long>"
_OUT_PA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()),
                     ("removed_chars", pa.int64()), ("text", pa.string()), ("first_doc_ids", pa.list_(pa.int64()))])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, key, text, covered, sources in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "covered", "sources"))):
            parts = segments(text)
            gone = np.zeros(len(parts), bool)
            for c in covered or ():
                gone[c["first"] : c["last"]] = True
            kept = text
            if gone.any():
                kept = "".join(text[a:b] for (a, b), g in zip(parts, gone) if not g)
            rows.append((doc, key, len(parts), int(gone.sum()), len(text or "") - len(kept or ""), kept, sorted(sources or ())))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT_PA)] if rows else
                              [pa.array([], f.type) for f in _OUT_PA], schema=_OUT_PA)


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SENTENCES,
                          words: int = 0) -> DataFrame:
    """Texts without the sentences that a non-first repeated span covers.

    One row per input row: ``doc_id, text_key, n_sentences, n_removed, removed_chars,
    text, first_doc_ids`` (where the removed spans stand first).  The first of equal
    spans is that of the smallest (doc_id, text_key, position), null ids last; a span
    that a text repeats itself counts too.  Rows alike in id and text are one document
    and come out alike.  Null stays null, a text of fewer sentences or words has no spans;
    other columns are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    with arrow_batches(docs.sparkSession):
        found = stash(rows.select("doc_id", "text_key", "text").mapInArrow(_find(least, words), _FOUND))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "first")
    # written, so that the join below has a plain shuffle on either side and AQE can split it
    first = stash(found.groupBy("hash").agg(F.min(place).alias("of"), F.max(place).alias("to")).where("of != to").select("hash", "of"))
    again = found.join(first, "hash").where(place != F.col("of"))
    covered = again.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("first", "last")).alias("covered"), F.collect_set("of.doc_id").alias("sources"))
    covered = covered.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "covered", "sources")
    whole = rows.join(covered, rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key")), "left")
    return whole.select("doc_id", "text_key", "text", "covered", "sources").mapInArrow(tidy(_remove), _OUT)
