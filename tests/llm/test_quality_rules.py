"""Quality measurements against plain Python, policies and ablations."""

import re

from cairn.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e", "a b c d e f a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx ", "é😀 #* <b> 100% ü",
         "a b c d e " * 40, "THE CAT SAT ON THE MAT AND THE HAT FELL", "k\u00a0l \u2003m", "w%d " * 3 + " ".join(f"w{i}" for i in range(20000)) + " w1 w2 w3 w4 w5 w6"]


def test_measurements(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    for r in q.quality_verdicts(df).collect():
        want = plain(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    df = spark.createDataFrame([(1, "short"), (2, " ".join(f"a{i}" for i in range(30))), (3, " ".join(f"a{i}***" for i in range(30))), (None, "short"), (1, "short")],
                               "doc_id long, text string")
    book = q.ledger(df)
    assert book.where(q.passes("base")).count() == 2 and book.where(q.passes("v2")).count() == 1
    found = {r.rule: (r.n_failed, r.n_regained) for r in q.ablation(book).collect()}
    assert found == {"few_words": (3, 3), "symbol_heavy": (1, 1)}
    every = {(r.policy, r.rule): (r.n_failed, r.n_regained, r.also_failed) for r in q.ablation(book, tuple(q.POLICIES)).collect()}
    assert every == {("base", "few_words"): (3, 3, 0), ("v1", "few_words"): (3, 3, 0), ("v2", "few_words"): (3, 3, 0), ("v1", "symbol_heavy"): (1, 1, 0), ("v2", "symbol_heavy"): (1, 1, 0)}
    assert q.ablation(book.limit(0)).count() == 0 and q.quality_verdicts(df.limit(0)).count() == 0
    alone = [(r.doc_id, r.kept, r.sole_rule) for r in q.quality_verdicts(df).collect()]
    assert sorted(alone, key=str) == sorted([(1, False, "few_words"), (2, True, None), (3, False, "symbol_heavy"), (None, False, "few_words"), (1, False, "few_words")], key=str)


def test_clashing_names(spark):
    names = ["__t", "__w", "__l", "__h", "__s", "__a", "__m"]
    df = spark.createDataFrame([(1, "a b", *range(len(names)))], ["doc_id", "text", *names])
    row = q.ledger(df).first()
    assert [row[n] for n in names] == list(range(len(names))) and row.n_words == 2
