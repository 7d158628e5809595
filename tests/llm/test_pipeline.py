"""The pipeline end to end on a small corpus."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(0)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = [" ".join(rng.choice(vocab, 60)) for _ in range(120)]
    text[7] = text[3] + " extra"
    text[9] = text[9] + " token=abcdefgh1"
    for k in range(100, 110):
        text[k] = " ".join(w + "%%%" for w in text[k].split())
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t)) for i, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not 100 <= i < 110), 0) for i in range(0, 120)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got, now = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        got.append({r.doc_id: r.text for r in now.collect()})
    clean = set(range(120)) - set(range(100, 110))
    assert len(clean - got[0].keys()) <= 3 and len(got[0].keys() - clean) <= 2
    assert got[0].keys() - got[1].keys() <= {7} and (7 not in got[1] or 3 not in got[1])
    assert got[2].keys() == got[1].keys() and all("token=" not in t for t in got[2].values())
    assert got[3].keys() <= got[2].keys() and len(got[3]) >= 0.5 * len(got[2])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r.doc_id for r in pieces} == got[3].keys()
    back = {}
    for r in sorted(pieces, key=lambda r: r.start):
        back.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert back == {d: whole.encode(t, add_special_tokens=False).ids + [2] for d, t in got[3].items()}


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and columns with the operators' own names."""
    names = ["__t", "__row", "__key", "_id", "__id", "row", "kept"]
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "src0", 35), (1, "alpha beta gamma delta epsilon zeta", "en", "src0", 35),
            (2, None, None, None, None), (None, "eta theta iota kappa lambda mu", "de", None, 30), (3, "", "en", "src1", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now.count(), stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and all(tuple(r)[5:] == tuple(range(len(names))) for r in now.collect()), name
        assert now.count() == (before - 1 if name == "n-gram Jaccard join" else before) or name.startswith("mixing")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in now.collect()}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
