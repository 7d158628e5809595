"""Packing: exact round trip of the ids, and best-fit decreasing piece by piece."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import packing


def plain_best_fit(lengths, capacity):
    """Every piece by itself into the tightest open window: used tokens of each window."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(capacity - n)
    return sorted(capacity - r for r in room)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 64):
        for size in (0, 1, 5, 60, 400):
            lengths = [rng.randint(1, capacity) if rng.random() < 0.6 else max(1, capacity // 3) for _ in range(size)]
            counts = {n: lengths.count(n) for n in set(lengths)}
            used, placed = {}, {n: set() for n in counts}
            for n, lo, hi, per, window, at in packing.best_fit_runs(counts, capacity):
                for r in range(lo, hi):
                    assert r not in placed[n]
                    placed[n].add(r)
                    w = window + (r - lo) // per
                    used.setdefault(w, set())
                    cells = set(range(at + (r - lo) % per * n, at + (r - lo) % per * n + n))
                    assert not cells & used[w] and max(cells) < capacity
                    used[w] |= cells
            assert all(len(placed[n]) == k for n, k in counts.items())
            assert all(c == set(range(len(c))) for c in used.values())
            assert sorted(len(c) for c in used.values()) == plain_best_fit(lengths, capacity)


TEXTS = [None, "", " \n", "Hello, world's end 123", "<|endoftext|> x<|startoftext|>y", "a\x1cb !\x1d! c", "\x02 a\x02b \x02\x02", " lead  trail ", "ΣΑΣ. Straße, e\u0301t\u0301 İı ŉ ﬁn. ªº ǅ ʰ 中文, й.", "Ünï,cödé.. ,. . , don't. it's, THE'LL x\u00ad\u200b\u2028y\u3000z", "É́ é ﬁ ΑΣ İ x y",
         "word " * 30_000, "x" * 5000, "same text", "same text"]


def test_ids_and_layout(spark):
    df = spark.createDataFrame([(None if i == 2 else i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(df, capacity=512).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(TEXTS):
        want = whole.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r.doc_id == (None if i == 2 else i)), key=lambda r: r.start)
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in mine), []) == want
        assert {r.doc_tokens for r in mine} == {len(want)} and all(r.length * 4 == len(r.ids) <= 2048 for r in mine)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end >= packing.FULL * 512 and end <= 512 or end & (end - 1) == 0


def test_windows_hold_all_with_little_padding():
    rng = random.Random(4)
    ids = lambda n: np.array([rng.randrange(9) for _ in range(n)], "<u4").tobytes()
    cases = [[rng.randint(1, 40) for _ in range(300)], [33] * 200, [64] * 5, [200, 1, 63, 640], [1] * 1000, [], [5]]
    for lengths in cases:
        docs = [(k, ids(n)) for k, n in enumerate(lengths)]
        for buffer in (1, 200, 5000):
            windows = list(packing.windows_of(iter(docs), 64, buffer))
            size = [packing._tokens(w) for w in windows]
            assert all(64 >= n >= packing.FULL * 64 or n & (n - 1) == 0 for n in size)
            assert sum(64 - n for n in size if n & (n - 1)) <= (1 - packing.FULL) * sum(size)
            back = {}
            for doc, start, n, part in sorted((p for w in windows for p in w), key=lambda p: p[:2]):
                assert start == len(back.setdefault(doc, b"")) // 4 and n == lengths[doc]
                back[doc] += part
            assert back == dict(docs)
            if buffer == 5000:  # few documents are cut: those longer than a window, and at a task's end
                cut = [p[0] for w in windows for p in w if len(p[3]) < len(docs[p[0]][1]) <= 256]
                assert len(set(cut)) <= 16 or lengths == [33] * 200


def test_another_tokenizer_goes_whole(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    told = json.load(open(path))
    assert packing.by_word(json.dumps(told))
    told["normalizer"]["normalizers"].pop()  # keeps upper case
    other = tmp_path / "other.json"
    other.write_text(json.dumps(told))
    assert not packing.by_word(other.read_text()) and not packing.Words(str(other)).by_word
    df = spark.createDataFrame(list(enumerate(TEXTS[3:10])), "doc_id long, text string")
    whole = Tokenizer.from_file(str(other))
    back = {}
    for r in sorted(packing.pack(df, tokenizer=str(other)).collect(), key=lambda r: r.start):
        back.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert back == {k: whole.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(TEXTS[3:10])}
    for token in ("word", "a b"):
        told = json.load(open(path))
        told["added_tokens"][0]["content"] = token
        assert not packing.by_word(json.dumps(told))


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
