"""Secret scans: assignments, access keys, hex runs, and sliding-window entropy.

Candidate strings are runs of one character class.  A window of fixed width slides
over each; its Shannon entropy comes from incremental counts: one character enters,
one leaves, and the sum of c log2 c changes by those two alone.  The counts are a
string with one character for each letter of the class, touched at these two places.
Windows at or over the class's threshold are joined into spans.  A span is suppressed
if it, or the whole run that it lies in, has a form of the allow list, or if it
touches a base span.  Every step is a column expression over one row: no shuffle, no
Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import prefix
from cairn.llm.spans import find_spans, merged, redacted, tagged, written

# The base kinds and their patterns, in order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

RANGES = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class CharClass:
    """Runs of at least ``window`` characters of ``alphabet``; ``floor`` in bits."""

    name: str
    pattern: str
    alphabet: str
    window: int
    floor: float


CLASSES = (
    CharClass("hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", "0123456789ABCDEFabcdef", 24, 3.0),
    CharClass("base64", r"[A-Za-z0-9+/_=-]{24,}",
              "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 3.9),
)

#: Whole forms that are no secrets: names and paths made of words, with short numbers
#: between them; numbers and rulers; UUIDs.  A word is of one case but for its first
#: letter and has at most 20 letters, so that random letters are none.  (A possessive
#: loop changes no match; others go as deep as a candidate has words.)
ALLOWED = (
    r"^[-_/=+]*(?:(?:[A-Z]?[a-z]{2,20}|[A-Z]{2,12}|[A-Za-z]|[0-9]{1,4})[-_/=+]+)*+(?:[A-Z]?[a-z]{2,20}|[A-Z]{2,12}|[A-Za-z]|[0-9]{1,4})?$",
    r"^[a-z]{2,20}(?:[A-Z][a-z]{2,20}){1,8}$", r"^(?:[A-Z][a-z]{2,20}){2,8}$", r"^[0-9_=/+-]+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
#: A span that is a piece of one of these is an alphabet in order.
IN_ORDER = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdef",
            "abcdefghijklmnopqrstuvwxyz0123456789abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF0123456789ABCDEF0123456789ABCDEF", "0123456789abcdef0123456789abcdef0123456789abcdef")


def _x_log_x(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


#: A count of n is the character with code _ZERO + n.
_ZERO = 48


def entropy_spans(candidate: Column, cls: CharClass) -> Column:
    """Within a candidate string: joined windows of high entropy, (start, end)."""
    w, k = cls.window, len(cls.alphabet)
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(cls.alphabet), c))
    start = F.struct(
        F.lit(chr(_ZERO) * k).alias("counts"), F.lit(0.0).cast("double").alias("sum"),
        F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(RANGES).alias("done"))
    # (entering, leaving, position): the window ends at the entering character; places count from 1
    leaving = F.concat(F.array_repeat(F.lit(0), w), F.slice(codes, F.lit(1), F.length(candidate) - w))
    pairs = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("enter"), b.alias("leave")))
    moves = F.transform(pairs, lambda x, i: F.struct(x["enter"].alias("enter"), x["leave"].alias("leave"), i.alias("i")))
    count = lambda acc, place: F.ascii(F.substring(acc["counts"], place, F.lit(1))) - _ZERO
    put = lambda counts, place, n: F.overlay(counts, F.char(n + _ZERO), place, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        a, lost = count(acc, x["enter"]), count(acc, x["leave"])
        same, out = x["enter"] == x["leave"], x["leave"] > 0
        total = acc["sum"] + F.when(same, F.lit(0.0)).otherwise(
            _x_log_x(a + 1) - _x_log_x(a) + F.when(out, _x_log_x(lost - 1) - _x_log_x(lost)).otherwise(F.lit(0.0)))
        grown = put(acc["counts"], x["enter"], a + 1)
        counts = F.when(same, acc["counts"]).when(out, put(grown, x["leave"], lost - 1)).otherwise(grown)
        high = (x["i"] >= w - 1) & (F.lit(float(w)) * F.log2(F.lit(float(w))) - total >= F.lit(cls.floor * w))
        begin = x["i"] - (w - 1)
        joins = high & (acc["to"] >= begin)
        closed = F.concat(acc["done"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(high & ~joins, begin).otherwise(acc["from"]).alias("from"),
            F.when(high, x["i"] + 1).otherwise(acc["to"]).alias("to"),
            F.when(high & ~joins & (acc["to"] >= 0), closed).otherwise(acc["done"]).alias("done"))

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end")))
        return F.when(acc["to"] >= 0, F.concat(acc["done"], last)).otherwise(acc["done"])

    return F.aggregate(moves, start, step, finish)


def _allowed(string: Column) -> Column:
    test = F.lit(False)
    for pattern in ALLOWED:
        test = test | string.rlike(pattern)
    for alphabet in IN_ORDER:
        test = test | F.contains(F.lit(alphabet), string)
    return test


def _judge(cls: CharClass):
    """A candidate (start, end, match) to its high-entropy ranges in the text."""

    def judge(s: Column) -> Column:
        found = F.when(_allowed(s["match"]), F.array().cast(RANGES)).otherwise(entropy_spans(s["match"], cls))
        found = F.filter(found, lambda x: ~_allowed(F.substring(s["match"], x["start"] + 1, x["end"] - x["start"])))
        return F.transform(found, lambda x: F.struct(
            (s["start"] + x["start"]).alias("start"), (s["start"] + x["end"]).alias("end")))

    return judge


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secret") -> DataFrame:
    """``docs`` with ``<out>_base`` and ``<out>_spans``: sorted (start, rank, end, kind).

    ``<out>_base`` holds the pattern kinds, ``<out>_spans`` those and ``entropy``
    spans, by start, then by kind.  Positions are code points, ends exclusive.  A null
    text counts as empty and has no spans; rows are independent, so repeated rows,
    null ids and other columns change nothing (columns of those two names are
    replaced).  Texts of any length are scanned whole; an empty table gives no rows.
    """
    base_col, p = f"{out}_base", prefix(docs)
    t = f"{p}t"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = find_spans(df, f"{p}assign", t, ASSIGN)
    df = find_spans(df, f"{p}access", t, ACCESS, F.contains(F.col(t), F.lit("AKIA")))
    df = find_spans(df, f"{p}hex", t, HEX)
    long_enough = F.filter(f"{p}assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6)
    base = F.concat(tagged(long_enough, "assign", 0, False), tagged(F.col(f"{p}access"), "access", 1, False), tagged(F.col(f"{p}hex"), "hex", 2, False))
    df = df.withColumn(base_col, F.sort_array(base)).drop(f"{p}assign", f"{p}access", f"{p}hex")
    for cls in CLASSES:
        df = find_spans(df, f"{p}c", t, cls.pattern)
        df = df.withColumn(f"{p}in_{cls.name}", F.when(F.size(f"{p}c") > 0, F.flatten(F.transform(f"{p}c", _judge(cls))))
                           .otherwise(F.array().cast(RANGES))).drop(f"{p}c")
    names = [f"{p}in_{c.name}" for c in CLASSES]
    df = df.withColumn(f"{p}e", F.when(F.size(F.concat(*names)) > 0, merged(F.concat(*names)))
                       .otherwise(F.array().cast(RANGES))).drop(*names)
    apart = F.filter(f"{p}e", lambda e: ~F.exists(base_col, lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    spans = F.sort_array(F.concat(base_col, tagged(apart, "entropy", 3, False)))
    return df.withColumn(f"{out}_spans", spans).drop(f"{p}e", t)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, their digest, and all spans written out."""
    df = scan_secrets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(F.col("secret_base")), 256).alias("base_sha256"), written(F.col("secret_spans")).alias("spans"),
        F.size("secret_spans").cast("long").alias("n_spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; other columns, whatever their names, and rows stay.

    A column ``n_chars``, where there is one, follows the new text.  Null stays null.
    """
    p = prefix(docs)
    df = scan_secrets(docs, text_col, f"{p}secret")
    text, spans, new = F.col(text_col).cast("string"), f"{p}secret_spans", f"{p}new"
    df = df.withColumn(new, F.when(F.size(spans) > 0, redacted(text, merged(F.col(spans)), mark)).otherwise(text))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.withColumn(text_col, F.col(new)).select(*docs.columns)
