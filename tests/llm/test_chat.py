"""Chat formatting: exact round trip, and the loss mask."""

import hashlib

from pyspark.sql import functions as F

from cairn.llm import chat

ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 3, "user", None), (1, 3, "user", None),
    (2, 0, "assistant", "\\### Assistant: </turn> ok <part> \\\\ \\"), (2, 1, "assistant", "####\\<part</turn</turn>\n### user: x"), (2, None, None, ""),
    (None, 0, "we:ird \\</turn>: ", "é😀\n"), (3, 5, "assistant", ""), (3, 4, "assistant", "x" * 100_000 + "<part>"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in {r[0] for r in ROWS}:
        mine = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert [tuple(t) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[conv].loss == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert got[1].formatted.count("###") == 3  # adjacent turns of a role are merged


def test_digest(spark):
    df = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    r = chat.chat_digest(df).first()
    assert (r.n_turns, r.loss_chars) == (3, 2)
    assert r.turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nc\n").hexdigest()
    assert r.loss_sha256 == hashlib.sha256(b"bc").hexdigest()


def test_rows_without_conversation_and_many_turns(spark):
    many = [(5, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), *many], "conv_id long, turn long, role string, text string")
    rows = chat.chat_digest(df).collect()
    assert sorted(r.n_turns for r in rows) == [1, 1, 1, 3000] and sorted(r.loss_chars for r in rows)[:3] == [0, 1, 1]
    long = next(r for r in rows if r.n_turns == 3000)
    assert long.loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(1, 3000, 2)).encode()).hexdigest()


def test_empty_table(spark):
    assert chat.chat_digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
