"""Packing token sequences into windows by best-fit decreasing.

A document's ids are cut into full windows and a remainder.  A task gathers remainders
up to ``BUFFER`` tokens and packs them by best-fit decreasing: pieces of one length are
alike, so it needs the count of each length only, at most as many as a window has
tokens; a segment tree over remaining capacities finds the tightest open window, and a
run of equal pieces fills a run of equal windows at a time, just as one by one.
Windows at least ``FULL`` full are done; the pieces of the others go into the next
buffer.  What is left when a task ends, or when too little fits together, is strung
together and cut into full windows, the end of it into powers of two, which need no
padding.

So packing is one pass over the texts without a shuffle, and a task holds a buffer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.lineage import stash
from cairn.llm.shingles import slices
from cairn.llm.workers import arrow_batches, tidy

CAPACITY, END_ID = 4096, 2
#: Tokens that a task gathers before it packs them, and how full a finished window is.
BUFFER, FULL = 1 << 21, 0.995
CACHE_WORDS, SLICE_BYTES = 150_000, 4 << 20
#: White space to Python that is none to the tokenizer.
_ODD = "[\x1c-\x1f]"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level pre-tokenization puts for each byte: itself where it
    prints, else the next free one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


#: The normaliser and pre-tokenizer of a file whose words can be taken one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_word(tokenizer: str) -> bool:
    """Whether a tokenizer's file (JSON) is known to give a text's words their ids one by one.

    Its normaliser and pre-tokenizer are those above, its model is without dropout, and
    no added token holds white space, strips it, or consists of letters.
    """
    told = json.loads(tokenizer)
    parts = [(told.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"])
                and re.search(r"[^\w]", t["content"]) for t in told.get("added_tokens") or ())
    return parts == [NORMALIZERS, PRE_TOKENIZERS] and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and plain


class Words:
    """Ids of white-space separated words as bytes, little-endian unsigned 32 bits.

    Where the tokenizer drops white space and never joins or compares across it
    (``by_word``), a text's ids are its words' ids in order.  Words of letters, with or
    without a full stop or comma, go straight to the tokenizer's model; any other word
    goes through all of it.  Of two generations of words the older is forgotten when the
    younger is full, so that frequent words stay.  With any other tokenizer whole texts
    go through all of it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.by_word = by_word(self.tokenizer.to_str())

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, word: str) -> bytes:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        low = word.lower()
        stem, tail = (low[:-1], low[-1]) if low[-1:] in (".", ",") else (low, "")
        if not stem.isalpha() or "\u03a3" in word:  # capital sigma: lower case by context or not
            return self.whole(word)
        if not stem.isascii():
            stem = stem.encode("utf-8").decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.model(stem)])
        if tail:
            ids.extend([t.id for t in self.model(tail)])
        return ids.tobytes()

    def __getitem__(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._encode(word)
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            if len(word) <= 64:
                self.young[word] = ids
        return ids

    def of(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls); each different word is looked up once."""
        if not self.by_word:
            return [self.whole(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        split = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        coded = split.flatten().dictionary_encode()
        known = [self[w] for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        pool, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size, dtype=np.int32) - size
        codes = coded.indices.to_numpy()
        each = size[codes]
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int32)), dtype=np.int32)  # a slice has far fewer than 2^31 ids
        at = np.repeat(first[codes] - ends[:-1], each)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = pool[at].tobytes()
        cut = (4 * ends.astype(np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()]).tolist()
        return [self.whole(texts[k].as_py()) if odd[k] else ids[cut[k] : cut[k + 1]] for k in range(len(texts))]


@lru_cache(maxsize=1)
def _words(path: str | None) -> Words:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Words(path)


def _each(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a batch, some megabytes of texts at a time."""
    docs, start = batch.column(0), 0
    for texts in slices(batch.column(1), SLICE_BYTES):
        yield from zip(docs[start : start + len(texts)].to_pylist(), words.of(texts))
        start += len(texts)


class CapacityTree:
    """Segment tree over capacities 0..most: which have an open window."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, open_: bool) -> None:
        k = capacity + self.size
        self.any[k] = open_
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        k = least + self.size
        if self.any[k]:
            return least
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``.

    Rows (length, lo, hi, per, window, offset): the pieces of that length with rank r in
    [lo, hi) go to window + (r - lo) // per, at offset + (r - lo) % per * length.
    """
    tree, blocks, runs, opened = CapacityTree(capacity), {}, [], 0

    def put(cap: int, first: int, n: int) -> None:
        if cap > 0 and n > 0:
            blocks.setdefault(cap, []).append((first, n))
            tree.set(cap, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            cap = tree.tightest(length)
            if cap is None:
                cap, per = capacity, capacity // length
                first, n = opened, -(-left // per)
                opened += n
            else:
                per = cap // length
                first, n = blocks[cap].pop()
                used = min(n, -(-left // per))
                if used < n:
                    blocks[cap].append((first + used, n - used))
                elif not blocks[cap]:
                    tree.set(cap, False)
                n = used
            whole = min(n, left // per)
            if whole:
                runs.append((length, rank, rank + whole * per, per, first, capacity - cap))
                put(cap - per * length, first, whole)
                rank, left = rank + whole * per, left - whole * per
            if n > whole:  # the last window takes what is left
                runs.append((length, rank, rank + left, left, first + whole, capacity - cap))
                put(cap - left * length, first + whole, 1)
                rank, left = rank + left, 0
    return runs


#: A piece: doc_id, start, tokens of its document, ids.
Piece = tuple[int | None, int, int, bytes]


def fitted(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of whole pieces, each of at most ``capacity`` tokens, by best-fit decreasing."""
    of_length: dict[int, list[Piece]] = defaultdict(list)
    for p in pieces:
        of_length[len(p[3]) // 4].append(p)
    windows: dict[int, list[Piece]] = defaultdict(list)
    for length, lo, hi, per, window, _ in best_fit_runs({k: len(v) for k, v in of_length.items()}, capacity):
        for rank in range(lo, hi):
            windows[window + (rank - lo) // per].append(of_length[length][rank])
    return list(windows.values())


def strung(pieces: list[Piece], sizes: Iterator[int]) -> Iterator[list[Piece]]:
    """Pieces in order, cut into windows of just those sizes; the last may be short."""
    window, room = [], next(sizes)
    for doc, start, n, ids in pieces:
        while ids:
            part, ids = ids[: 4 * room], ids[4 * room :]
            window.append((doc, start, n, part))
            start, room = start + len(part) // 4, room - len(part) // 4
            if not room:
                yield window
                window, room = [], next(sizes)
    if window:
        yield window


def _sizes(tokens: int, capacity: int) -> Iterator[int]:
    """Full windows, then powers of two that add up to the rest."""
    while tokens >= capacity:
        yield capacity
        tokens -= capacity
    while tokens:
        size = 1 << (tokens.bit_length() - 1)
        yield size
        tokens -= size
    yield capacity


def _tokens(pieces: list[Piece]) -> int:
    return sum(len(p[3]) for p in pieces) // 4


def windows_of(documents: Iterator[tuple[int | None, bytes]], capacity: int, buffer: int, full: float = FULL) -> Iterator[list[Piece]]:
    """The windows of (doc_id, ids), holding about ``buffer`` tokens at a time."""
    held: list[Piece] = []
    size = 0
    for doc, ids in documents:
        n = len(ids) // 4
        for start in range(0, n, capacity):
            piece = (doc, start, n, ids[4 * start : 4 * (start + capacity)])
            if len(piece[3]) == 4 * capacity:
                yield [piece]
            else:
                held.append(piece)
                size += n - start
        if size >= buffer:
            windows = fitted(held, capacity)
            held = [p for w in windows if _tokens(w) < full * capacity for p in w]
            yield from (w for w in windows if _tokens(w) >= full * capacity)
            size = _tokens(held)
            if size > buffer // 2:  # too little fits together: cut it, but for the end
                whole = list(strung(held, _sizes(size, capacity)))
                yield from (w for w in whole if _tokens(w) == capacity)
                held = [p for w in whole if _tokens(w) < capacity for p in w]
                size = _tokens(held)
    windows = fitted(held, capacity)
    yield from (w for w in windows if _tokens(w) >= full * capacity)
    held = [p for w in windows if _tokens(w) < full * capacity for p in w]
    yield from strung(held, _sizes(_tokens(held), capacity))


_PACKED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
_PACKED_PA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_BATCH_BYTES = 4 << 20


def _pack(path: str | None, capacity: int, end_id: int, buffer: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = _words(path), TaskContext.get().partitionId() << 33
        documents = ((doc, ids + end) for batch in batches for doc, ids in _each(batch, words))
        rows: list[tuple] = []
        size = 0
        try:
            for window in windows_of(documents, capacity, buffer):
                offset = 0
                for doc, start, n, ids in window:
                    length = len(ids) // 4
                    rows.append((doc, start, length, n, ids, sequence, offset))
                    offset += length
                sequence += 1
                size += 4 * offset
                if size >= _BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED_PA)], schema=_PACKED_PA)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED_PA)], schema=_PACKED_PA)
        finally:
            words.forget()  # the worker goes on to other work

    return tidy(run)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer: str | None = None, buffer: int = BUFFER) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, ids, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit ids.  Every document ends with ``end_id``;
    a null text counts as empty, so it is that id alone.  Rows are independent: repeated
    ids and rows without id are packed as they come; other columns are not read; an empty
    table gives no rows.  ``sequence_id`` tells the task and counts its windows, so ids
    are unique but not gapless.  The result is written once, in the shared folder, so
    that a lost executor cannot place a piece twice.  ``tokenizer`` is the path of a
    ``tokenizers`` file, by default the public word_bpe_49k.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(docs.sparkSession):
        return stash(rows.mapInArrow(_pack(tokenizer, capacity, end_id, buffer), _PACKED))
