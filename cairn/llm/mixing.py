"""Mixing sources to target weights by hierarchical budgeting.

A tree (domain, language, source) gets a token budget from its root.  Each node
splits its budget among its children by weight; a child that lacks tokens takes what
it has, and its shortage goes to its siblings first.  A node never gets more than its
leaves hold, so what the siblings cannot use has gone to the ancestors' other children.
Each leaf then reads its documents in seeded epochs: whole epochs while the budget
lasts, then the longest prefix of one more epoch's permutation that fits.

Only one scan reads texts, to count tokens.  The permutation is an order by hash; its
prefix is found in steps, sums by hash bucket, then by bucket within one bucket, then
the rows of one of those of each leaf, so a leaf may hold any share of all rows.
DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.bounded import broadcast_if_small
from cairn.functions.lineage import stash

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the order hash by which a leaf is narrowed down at a time, and in all.
STEP_BITS, BUCKET_BITS = 8, 16


@dataclass(frozen=True)
class Mix:
    """Targets: sources by domain, weights by domain and by language, equal by source.

    ``share`` of all available tokens is the budget; ``epochs`` bounds the copies of a
    document; what no rule names gets ``other_domain`` and ``other_weight``.  A weight of
    0 leaves a node out; weights are not negative, and finite.
    """

    domains: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "crawl": ("src0",), "reference": ("src1", "src2", "src3", "src4"), "books": ("src5", "src6", "src7", "src8", "src9")})
    other_domain: str = "web"
    domain_weights: dict[str, float] = field(default_factory=lambda: {"crawl": 0.25, "reference": 0.375, "books": 0.125, "web": 0.25})
    lang_weights: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.25, "fr": 0.125, "es": 0.125})
    other_weight: float = 0.0625
    share: float = 0.75
    epochs: int = 2
    seed: int = 1

    def __post_init__(self) -> None:
        weights = [*self.domain_weights.values(), *self.lang_weights.values(), self.other_weight]
        if not all(0 <= w < float("inf") for w in weights):
            raise ValueError("weights must be finite and not negative")
        if not 0 <= self.share < float("inf") or self.epochs < 0 or self.epochs != int(self.epochs):
            raise ValueError("share and epochs must not be negative, epochs whole")
        named = [s for group in self.domains.values() for s in group]
        if len(named) != len(set(named)):
            raise ValueError("a source belongs to one domain")


def _case(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, weight in table.items():
        out = F.when(value == name, F.lit(weight)).otherwise(out)
    return out


def _leaf(docs: DataFrame, mix: Mix) -> list[Column]:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    domain = F.lit(mix.other_domain)
    for name, sources in mix.domains.items():
        domain = F.when(source.isin(*sources), F.lit(name)).otherwise(domain)
    return [domain.alias("domain"), lang.alias("lang"), source.alias("source")]


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    """60 bits that order one epoch's permutation; md5, so that SQL elsewhere agrees."""
    told = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("long")


def split_budget(children: DataFrame, parent: list[str]) -> DataFrame:
    """Add ``budget``: each parent's ``given`` split by ``weight`` under ``cap``.

    In order of cap / weight the first children are full as long as their cap is at
    most their share of what is left; the others split the rest by weight.  A child of
    weight 0 must have cap 0.
    """
    mine = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))
    by_need = mine.orderBy(ratio(F.col("cap"), F.col("weight")), "name")
    before = F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing))
    df = children.withColumn("before", before).withColumn("rest", rest).withColumn("level", ratio(F.col("given") - F.col("before"), F.col("rest")))
    df = df.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(mine)
    return df.withColumn("budget", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))).drop("level", "full", "before", "rest")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with ``budget`` in whole tokens."""
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(mix.share)).cast("double").alias("given"))
    weight = {"domain": lambda c: _case(c, mix.domain_weights, mix.other_weight),
              "lang": lambda c: _case(c, mix.lang_weights, mix.other_weight), "source": lambda c: F.lit(1.0)}
    counts = F.lit(True)
    for level in LEVELS:
        counts = counts & (weight[level](F.col(level)) > 0)
    usable = F.when(counts, F.col("tokens") * mix.epochs).otherwise(0)
    above: DataFrame | None = None
    for k, level in enumerate(LEVELS):
        keys, parent = list(LEVELS[: k + 1]), list(LEVELS[:k])
        nodes = leaves.groupBy(*keys).agg(F.sum(usable).alias("cap"))
        nodes = nodes.withColumn("name", F.col(level)).withColumn("weight", weight[level](F.col(level)))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(total))  # one row: the budget
        above = split_budget(nodes, parent).select(*keys, F.col("budget").alias("given"))
    return leaves.join(above, list(LEVELS)).withColumn("budget", F.floor("given").cast("long")).drop("given")


def _bucket(bits: int) -> Column:
    return F.shiftright("h", 60 - bits)


def _edges(hashed: DataFrame) -> DataFrame:
    """(leaf, edge, before): the bucket in which each leaf's prefix ends, and the tokens ahead of it."""
    found: DataFrame | None = None
    for bits in range(STEP_BITS, BUCKET_BITS + 1, STEP_BITS):
        part = hashed.withColumn("ahead", F.lit(0).cast("long"))
        if found is not None:
            part = hashed.join(broadcast_if_small(found.withColumnRenamed("before", "ahead")), list(LEVELS)).where(_bucket(bits - STEP_BITS) == F.col("edge"))
        sums = part.groupBy(*LEVELS, "left", "ahead", _bucket(bits).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        earlier = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))  # at most 2^STEP_BITS rows
        ends = sums.withColumn("before", F.col("ahead") + F.coalesce(earlier, F.lit(0))).where("before <= left and before + n > left")
        found = stash(ends.groupBy(*LEVELS).agg(F.min("bucket").alias("edge"), F.min_by("before", "bucket").alias("before")))
    return found


def mix_plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counted rows (leaf, key, doc_id, n_tokens), and the leaves with what each reads:
    ``full`` whole epochs, then documents up to bucket ``edge`` and ``cut`` in it."""
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    n = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stash(docs.select(*_leaf(docs, mix), key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), n.alias("n_tokens")))
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(leaves, mix).withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.expr("budget div tokens"))).otherwise(0).cast("long"))
    leaves = stash(leaves.withColumn("left", F.col("budget") - F.col("full") * F.col("tokens")))

    small = broadcast_if_small(leaves.select(*LEVELS, "full", "left"))
    hashed = rows.join(small, list(LEVELS)).withColumn("h", order_hash(mix.seed, F.col("full"), F.col("key")))
    edges = _edges(hashed)
    so_far = F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("h", "key")) + F.col("before")
    at_edge = hashed.join(broadcast_if_small(edges), list(LEVELS)).where(_bucket(BUCKET_BITS) == F.col("edge"))
    cuts = at_edge.withColumn("so_far", so_far).where("so_far <= left").groupBy(*LEVELS).agg(F.max(F.struct("h", "key")).alias("cut"))
    plan = leaves.join(edges.drop("before"), list(LEVELS), "left").join(cuts, list(LEVELS), "left")
    return rows, stash(plan)


def _copies(mix: Mix, key: Column) -> Column:
    """Whole epochs and, if the document is in the last one's prefix, one more."""
    h = order_hash(mix.seed, F.col("full"), key)
    bucket = F.shiftright(h, 60 - BUCKET_BITS)  # as _bucket, of this row's own hash
    inside = F.col("edge").isNull() | (bucket < F.col("edge")) | (
        (bucket == F.col("edge")) & F.col("cut").isNotNull() & (F.struct(h.alias("h"), key.alias("key")) <= F.col("cut")))
    return F.least(F.col("full") + F.when(inside & (F.col("left") > 0), 1).otherwise(0), F.lit(mix.epochs)).cast("int")


def mixed_documents(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and epoch that reads it: leaf, ``doc_id``, ``n_tokens``, ``epoch``.

    Tokens are words.  Null languages and sources count as "", null texts have no
    tokens.  Rows that repeat an id within a leaf are read together or not at all;
    rows without id go by their text.  An empty table gives no rows.
    """
    mix = mix or Mix()
    rows, plan = mix_plan(docs, mix, id_col, text_col)
    small = broadcast_if_small(plan.select(*LEVELS, "full", "left", "edge", "cut"))
    taken = rows.join(small, list(LEVELS)).withColumn("copies", _copies(mix, F.col("key"))).where("copies > 0")
    return taken.select("doc_id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))


def mix_sources(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the mix reads them: rows once per epoch, columns unchanged."""
    mix = mix or Mix()
    _, plan = mix_plan(docs, mix, id_col, text_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    row = docs.select(F.struct(*docs.columns).alias("row"), *_leaf(docs, mix), key.alias("key"))
    small = broadcast_if_small(plan.select(*LEVELS, "full", "left", "edge", "cut"))
    out = row.join(small, list(LEVELS)).withColumn("copies", _copies(mix, F.col("key"))).where("copies > 0")
    if mix.epochs > 1:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")
