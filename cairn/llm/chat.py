"""Chat formatting in column expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged, and the whole is concatenated::

    ### <role>: <text><part><text></turn>\\n

Control strings inside texts are escaped with backslashes, so that they never occur
in an escaped text; ``parse`` reads the turns back exactly as they were, merged ones
one by one.  The loss mask covers the assistant's texts and none of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.spans import running_sums

HEAD, PART, END = "###", "<part>", "</turn>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """Backslashes doubled, control strings broken up by backslashes; see ``unescape``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(HEAD), F.lit("\\#\\#\\#"))
    out = F.replace(out, F.lit(PART), F.lit("\\<part\\>"))
    return F.replace(out, F.lit(END), F.lit("\\</turn\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    Turns are in order of (turn, role, text), nulls first; null roles and texts count
    as empty; repeated rows are turns of their own; a row without conv_id is a
    conversation by itself; a table without rows has no result; other columns are not
    read.  ``loss_spans`` are (start, end) code points in ``formatted``, end exclusive,
    one for each text of the learnt role (its escaped form), in order.

    A conversation is one value, so one task holds it: that bounds one to the 2 GB of a
    Spark string, however many there are.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    df = turns.select(F.col(conv_col).alias("conv_id"), alone.alias("alone"), row.alias("t")).groupBy("conv_id", "alone").agg(F.collect_list("t").alias("t"))
    df = df.withColumn("t", F.sort_array("t"))
    first = F.filter(F.transform("t", lambda t, i: F.when((i > 0) & (F.get("t", i - 1)["role"] == t["role"]), F.lit(None)).otherwise(i)),
                     lambda i: i.isNotNull())
    df = df.withColumn("first", first)
    # one piece per text: what stands before it, its escaped form, and what follows
    runs = F.transform("first", lambda i, k: F.slice("t", i + 1, F.coalesce(F.get("first", k + 1), F.size("t")) - i))

    def pieces(run: Column) -> Column:
        role = F.replace(escape(F.get(run, F.lit(0))["role"]), F.lit(":"), F.lit("\\:"))
        return F.transform(run, lambda t, j: F.struct(
            F.when(j == 0, F.concat(F.lit(HEAD + " "), role, F.lit(": "))).otherwise(F.lit(PART)).alias("before"),
            escape(t["text"]).alias("text"),
            F.when(j == F.size(run) - 1, F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            (t["role"] == LEARNT).alias("learnt")))

    df = df.withColumn("pieces", F.flatten(F.transform(runs, pieces)))
    df = df.withColumn("steps", F.transform("pieces", lambda p: F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])))
    spans = F.zip_with(running_sums("steps"), "pieces", lambda end, p: F.struct(
        (end - F.length(p["after"]) - F.length(p["text"])).alias("start"), (end - F.length(p["after"])).alias("end"), p["learnt"].alias("learnt")))
    learnt = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"), learnt.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text)."""
    runs = F.split(formatted, END + "\n", -1)

    def turns(run: Column) -> Column:
        head = F.regexp_extract(run, r"(?s)^### (?:\\.|[^:\\])*+: ", 0)
        role = unescape(F.substring(head, F.lit(5), F.length(head) - 6))
        body = F.substring(run, F.length(head) + 1, F.length(run))
        return F.transform(F.split(body, PART, -1), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: turns, loss, sizes."""
    df = format_chats(turns).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
