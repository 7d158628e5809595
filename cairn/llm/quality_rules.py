"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document and sets one bit where it fails; the ledger
keeps the bits beside the measurements.  A policy is a versioned mask over the rules:
applying one, comparing two, or asking what a rule alone costs needs the ledger only,
never the texts again.  All steps are column expressions over one row; the ablation
is a bitwise aggregation over at most 2^rules counted masks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import prefix

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbol_heavy", "100 * n_symbols > 25 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "shouting", "100 * n_upper > 60 * word_chars"),
)
BASE = ("few_words", "repeated_windows")
#: Policies by version: the rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbol_heavy", "repeated_lines"),
    "v2": (*BASE, "symbol_heavy", "repeated_lines", "short_words", "long_words", "shouting"),
}
PRODUCTION = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << r.bit for r in RULES if r.name in rules)


def _less(text: Column, pattern: str) -> Column:
    """Characters of a class: what the text loses with them, in code points."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _repeat_words(df: DataFrame, p: str) -> DataFrame:
    """Words in windows of WINDOW words that the text holds twice or more; words are in column ``<p>w``."""
    w, h, s, at = (f"{p}{n}" for n in "whsa")
    size = F.size(w)
    hashes = F.when(size > WINDOW, F.transform(
        F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    df = df.withColumn(h, hashes)
    again = F.size(F.array_distinct(h)) < F.size(h)
    df = df.withColumn(s, F.when(again, F.sort_array(F.transform(h, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
    df = df.withColumn(at, F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    steps = F.zip_with(F.slice(at, F.lit(2), F.size(at) - 1), F.slice(at, F.lit(1), F.size(at) - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.when(F.size(at) > 0, covered).otherwise(0).cast("long")).drop(h, s, at)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements that the rules read (they replace columns so named, no others).

    A null text counts as one without words; all of its measurements are 0.
    """
    p = prefix(docs)
    t, w, lines = f"{p}t", f"{p}w", f"{p}l"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    df = df.withColumn(w, F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    df = (
        df.withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", _less(F.col(t), r"[#*$%&|<>]"))
        .withColumn("n_upper", _less(F.col(t), r"[A-Z]"))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    )
    return _repeat_words(df, p).drop(t, w, lines)


def ledger(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``fail_bits``: bit r.bit is set where rule r fails.

    One row per input row, repeated rows and null ids included.
    """
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policies: tuple[str, ...] = (PRODUCTION,)) -> DataFrame:
    """Per policy and rule of it: documents that fail it, and that only it rejects.

    ``n_failed`` counts rows with the rule's bit; ``n_regained`` those that the policy
    without the rule would keep; ``also_failed`` is the union of the policy's other bits
    seen with it.  A rule that nothing fails has no row.  The ledger is first counted by
    its bits, at most 2^rules of them, so what is exploded is bounded.
    """
    rules = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask_of(POLICIES[p])).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                      for p in policies for r in RULES if r.name in POLICIES[p]])
    counted = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    each = counted.withColumn("r", F.explode(rules)).where("fail_bits & r.bit != 0").withColumn("bits", F.expr("fail_bits & r.mask"))
    return each.groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_regained"),
        F.bit_or(F.expr("bits & ~r.bit")).alias("also_failed"))


def sole_rule(policy: str) -> Column:
    """The rule of a policy that alone rejects a ledger row, null if none or several do."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long"))
    out = F.lit(None).cast("string")
    for r in RULES:
        if r.name in POLICIES[policy]:
            out = F.when(bits == 1 << r.bit, F.lit(r.name)).otherwise(out)
    return out


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = PRODUCTION) -> DataFrame:
    """Per row: id, measurements, ``base_failed``, the policy's ``kept``, ``fail_bits``, the policy's
    version, and the rule that alone rejects the row.  Rows are independent; an empty table gives none."""
    book = ledger(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"), "fail_bits", F.lit(policy).alias("policy"), sole_rule(policy).alias("sole_rule"))
