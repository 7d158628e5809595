"""Mixing against a recursive budget and a plain walk through the epochs."""

import hashlib

import pytest

from cairn.llm import mixing


def plain_split(given, children):
    """(name, weight, cap) to budgets: fill the full ones, share the rest, repeat."""
    out, open_ = {}, list(children)
    while open_:
        total = sum(w for _, w, _ in open_)
        full = [(n, w, c) for n, w, c in open_ if c <= given * w / total + 1e-9]
        if not full:
            out |= {n: given * w / total for n, w, _ in open_}
            break
        for n, w, c in full:
            out[n] = c
        given -= sum(c for _, _, c in full)
        open_ = [x for x in open_ if x not in full]
    return out


@pytest.mark.parametrize("given", [0.0, 10.0, 60.0, 100.0, 163.0])
def test_split_redistributes_shortages(spark, given):
    children = [("a", 0.5, 10), ("b", 0.25, 100), ("c", 0.125, 3), ("d", 0.125, 50), ("e", 0.0625, 0)]
    df = spark.createDataFrame([(*c, given, "p") for c in children], "name string, weight double, cap long, given double, up string")
    got = {r.name: r.budget for r in mixing.split_budget(df, ["up"]).collect()}
    assert got == pytest.approx(plain_split(given, children))


def order(seed, epoch, key):
    return int(hashlib.md5(f"{seed}:{epoch}:{key}".encode()).hexdigest()[:15], 16), key


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 3), (2.5, 3), (9.0, 2)])
def test_prefix_of_seeded_epochs(spark, share, epochs):
    docs = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "en" if i % 3 else "de", f"src{i % 4}", i) for i in range(400)]
    docs += [(400, None, None, None, 0), (7, docs[7][1], docs[7][2], docs[7][3], 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, budget int")
    mix = mixing.Mix(share=share, epochs=epochs)
    got = {}
    for r in mixing.mixed_documents(df, mix).collect():
        got.setdefault((r.domain, r.lang, r.source), []).append((r.doc_id, r.epoch))
    plan = {(r.domain, r.lang, r.source): r for r in mixing.mix_plan(df, mix)[1].collect()}
    total = sum(len((t or "").split()) for _, t, *_ in docs)
    assert sum(p.budget for p in plan.values()) == pytest.approx(min(int(total * share), total * epochs), abs=len(plan))
    for leaf, p in plan.items():
        mine = [(d, len((t or "").split())) for d, t, lang, source, _ in docs if (lang or "", source or "") == leaf[1:]]
        assert p.tokens == sum(n for _, n in mine) and p.budget <= p.tokens * epochs
        want = [(d, e) for d, n in mine for e in range(min(p.full, epochs))]
        left = p.budget - p.full * p.tokens
        if p.full < epochs and left > 0:
            for d in sorted({d for d, _ in mine}, key=lambda d: order(mix.seed, p.full, d)):
                n = sum(k for x, k in mine if x == d)
                if n > left:
                    break
                left -= n
                want += [(d, p.full)] * sum(x == d for x, _ in mine)
        assert sorted(got.get(leaf, [])) == sorted(want), leaf


def test_rows_as_read_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "src1", 5), (None, "d e", "en", "src1", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(df, mixing.Mix(share=2.0, epochs=2))
    assert out.columns == df.columns and out.count() == 4
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_weights(spark):
    docs = [(i, "a b c", "en" if i % 2 else "de", f"src{i % 3}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    none = mixing.Mix(domain_weights={"crawl": 0.0, "reference": 1.0}, lang_weights={"en": 1.0, "de": 0.0}, other_weight=0.0, share=0.2)
    rows = mixing.mixed_documents(df, none).collect()
    assert {(r.domain, r.lang) for r in rows} == {("reference", "en")} and 33 <= sum(r.n_tokens for r in rows) <= 36
    all_out = mixing.Mix(domain_weights={}, lang_weights={}, other_weight=0.0)
    assert mixing.mixed_documents(df, all_out).count() == 0
    for wrong in ({"other_weight": -1.0}, {"domain_weights": {"web": float("nan")}}, {"share": -0.1}, {"epochs": -1}, {"domains": {"a": ("x",), "b": ("x",)}}):
        with pytest.raises(ValueError):
            mixing.Mix(**wrong)
