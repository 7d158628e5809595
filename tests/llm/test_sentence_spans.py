"""Repeated sentence spans against brute force over all spans."""

import random

from cairn.llm import sentence_spans as s


def brute(docs, least=2, words=0):
    """{doc: kept text}: every run of enough sentences and words is a span, the first in (doc, position) stays."""
    seen, every = {}, []
    for d, t in sorted(docs):
        clean = [(t or "")[a:b].strip() for a, b in s.segments(t)]
        n = [c.count(" ") + 1 for c in clean]
        every += [(d, i, j, tuple(clean[i:j])) for i in range(len(n)) for j in range(i + least, len(n) + 1) if sum(n[i:j]) >= words]
    for d, i, _, key in every:
        seen.setdefault(key, (d, i))
    out = {}
    for d, t in docs:
        gone = {k for x, i, j, key in every if x == d and seen[key] != (d, i) for k in range(i, j)}
        out[d] = None if t is None else "".join(t[a:b] for k, (a, b) in enumerate(s.segments(t)) if k not in gone)
    return out


def test_segments_cover_the_text():
    for t in ("", " ", "\n\n", "a", "A b. C d!\n\nE? f", "x. y.  ", " \n lead. x", "v 1.2 e.g. ok..."):
        assert "".join(t[a:b] for a, b in s.segments(t)) == t


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 4))) + "." for _ in range(12)]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, docs[3][1]), (63, "\n".join([docs[3][1]] * 2))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, first int")
    got = {r.doc_id: r for r in s.remove_repeated_spans(df).collect()}
    want = brute(docs)
    assert {d: r.text for d, r in got.items()} == want
    assert all((r.n_removed > 0) == (r.text != dict(docs)[d]) for d, r in got.items())
    assert 3 in got[63].first_doc_ids or got[3].n_removed


def test_repeated_rows_and_null_ids(spark):
    text = "One two three. Four five six. Seven eight nine."
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    rows = s.remove_repeated_spans(df).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (0, 3), (1, 0), (1, 0)]
    assert s.remove_repeated_spans(df.limit(0)).count() == 0


def words_of(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n)) + ". "


def kept(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: r.text for r in s.remove_repeated_spans(df, **how).collect()}


def test_all_runs(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 5))) + "." for _ in range(30)]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 12)))) for i in range(80)]
    docs += [(100 + i, " ".join(rng.choices(pool, k=2)) + " " + docs[i][1] + " " + " ".join(rng.choices(pool, k=2))) for i in range(40)]
    for least, words in ((2, 0), (2, 6), (3, 0), (3, 9), (1, 0), (1, 4)):
        assert kept(spark, docs, least=least, words=words) == brute(docs, least, words)


def test_whole_passages_go(spark):
    for passage in ("".join(words_of(t, n) for t, n in (("a", 25), ("b", 25), ("c", 5), ("d", 5))), words_of("a", 15) + words_of("b", 10) + words_of("c", 5),
                    words_of("a", 9) + words_of("b", 9), words_of("a", 60) + words_of("b", 30)):
        docs = [(k, f"Head of text {k}. {passage}{words_of(f'tail{k}x', 30)}") for k in (1, 2)]
        for words in (0, 16):
            assert kept(spark, docs, words=words) == {1: docs[0][1], 2: f"Head of text 2. {words_of('tail2x', 30)}"}
    # one sentence is no run
    docs = [(k, words_of("a", 60) + words_of(f"tail{k}x", 30)) for k in (1, 2)]
    assert kept(spark, docs) == dict(docs)
