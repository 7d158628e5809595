"""Personal data: pattern kinds, and boosted selection among loose candidates.

Generators of high recall propose spans, which may overlap, of forms that the strict
patterns miss: phone numbers without a country code, masked mail addresses, social
security numbers, IBANs, card numbers with or without a right check digit.  Boosted
trees score each by its format and context.  They are trained here, on ``EXAMPLES``
seeded synthetic lines, in which context is missing or misleads at times; as many
lines of layouts and context words that the trees have not seen calibrate a threshold
for each generator: the lowest score from which on ``PRECISION`` of those lines'
candidates are personal.  The forest is applied as a column expression, and so is all
else: one pass over each row, no shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.names import prefix
from cairn.llm.boosting import Forest, boost, threshold
from cairn.llm.spans import find_spans, merged, redacted, tagged, written

# The base kinds' patterns, in order.  Possessive quantifiers and the
# look-behind change no match (\G: also where the last match ended); they keep the
# time linear on long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: Generators, in order after the base kinds.
GENERATORS = (
    ("local_phone", r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,2}(?![0-9A-Za-z]|[.,][0-9])"),
    ("masked_email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?[\[({<]\x20?at\x20?[\])}>]\x20?[a-z0-9-]{1,63}"
                     r"(?:\x20?(?:\.|[\[({<]\x20?dot\x20?[\])}>])\x20?[a-z]{2,24}){1,4}"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("loose_card", r"(?<![0-9.,-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]|[.,-][0-9])"),
)
MASKED_GATE = r"(?i)[\[({<]\x20?at\x20?[\])}>]"
CONTEXT_BEFORE, CONTEXT_AFTER = 32, 16
#: Words whose presence near a candidate is a feature.
CONTEXTS = {
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "identity": r"(?i)\b(?:ssn|social security|tax id|national id|passport|iban|account|konto|compte|cuenta)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel)\b",
    "noise": r"(?i)\b(?:order|invoice|version|isbn|issn|ref|sku|part|serial|model|page|pages|score|total|price|build|id|no|nr|date|room|batch)\b",
}
EXAMPLES, PRECISION, SEED = 3000, 0.95, 23
#: Shares of example lines whose context is missing, or that of another kind.
BARE, ASTRAY = 0.1, 0.05


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    doubled = lambda c: F.translate(c, "0123456789", "0246813579").cast("int")
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c)).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10 == 0


FEATURES = ("generator", "length", "digits", "separators", "distinct", "luhn", *CONTEXTS, "marked", "percent", "year", "zero")


def _features(text: Column, s: Column, generator: int) -> list[Column]:
    """Format and context of a candidate, all as doubles."""
    m = s["match"]
    d = _digits(m)
    before = F.substring(text, F.greatest(s["start"] - CONTEXT_BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_BEFORE)))
    after = F.substring(text, s["end"] + 1, F.lit(CONTEXT_AFTER))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.lit(float(generator)), F.length(m).cast("double"), F.length(d).cast("double"),
        F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")).cast("double"),
        F.size(F.array_distinct(F.split(d, ""))).cast("double"), flag((F.length(d) > 1) & luhn(d)),
        *[flag(F.concat(before, F.lit(" "), after).rlike(p)) for p in CONTEXTS.values()],
        flag(before.rlike(r"[#$€£=_]\x20?$")), flag(after.rlike(r"^\x20?[%€$]|^\x20?(?i:mm|cm|kg|usd|eur)\b")),
        flag(m.rlike(r"^(?:19|20)[0-9]{2}[./-]|[./-](?:19|20)[0-9]{2}$")), flag(d.startswith("0")),
    ]


def _described(text: Column, spans: str, generator: int) -> Column:
    """A generator's candidates with their features."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*_features(text, s, generator)).alias("x")))


def _candidates(df: DataFrame, text: str, out: str) -> tuple[DataFrame, list[str]]:
    """A column of spans for each generator."""
    some = F.col(text).rlike("[0-9]{2}")
    names = []
    for name, pattern in GENERATORS:
        gate = F.col(text).rlike(MASKED_GATE) if name == "masked_email" else some
        df = find_spans(df, f"{out}{name}", text, pattern, gate)
        names.append(f"{out}{name}")
    return df, names


def _layouts(rng: random.Random) -> dict[str, list[Callable[[], str]]]:
    """Layouts of each form: those with even places train, those with odd ones are held out."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    upper = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPRSTUVXYZ") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    year = lambda: str(rng.randint(1950, 2035))
    top = lambda: rng.choice(["com", "org", "net", "de", "fr", "io"])

    def checked(k: int, right: bool = True) -> str:
        body = n(k - 1)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        return body + str((10 - total % 10 + (0 if right else rng.randint(1, 9))) % 10)

    def grouped(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    return {
        "phone": [lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)} {n(3)} {n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"0{n(2)}/{n(3)}-{n(4)}",
                  lambda: f"0{n(3)} {n(3)} {n(3)}", lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"0{n(1)}-{n(4)}-{n(4)}", lambda: f"({n(4)}) {n(3)} {n(3)}"],
        "date": [lambda: f"{year()}-{n(2)}-{n(2)}", lambda: f"{n(2)}/{n(2)}/{year()}", lambda: f"{n(2)}.{n(2)}.{year()}", lambda: f"{year()}.{n(2)}.{n(2)}", lambda: f"{n(2)} {n(2)} {n(2)}", lambda: f"{n(2)}-{n(2)}-{n(2)}"],
        "number": [lambda: f"{n(2)}-{n(3)}-{n(2)}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(4)} {n(3)} {n(2)}", lambda: f"{n(2)}/{n(4)}/{n(3)}"],
        "mail": [lambda: f"{word()}.{word()} [at] {word()} [dot] {top()}", lambda: f"{word()}_{word()} (at) {word()}.{top()}", lambda: f"{word()} (at) {word()} (dot) {top()}", lambda: f"{word()}{n(2)}[at]{word()}[dot]{top()}"],
        "meet": [lambda: f"{word()} (at) {word()}. {word()}", lambda: f"{word()} [at] {word()}.{word()}", lambda: f"{word()} {{at}} {word()}.{word()} {word()}", lambda: f"{word()}(at){word()}. {word()}"],
        "ssn": [lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{n(3)}-{n(2)}-{n(4)}"],
        "iban": [lambda: f"{rng.choice(['DE', 'FR', 'ES'])}{n(2)} {grouped(n(16), ' ')} {n(2)}", lambda: f"{rng.choice(['GB', 'NL', 'IT'])}{n(2)} {upper(4)} {grouped(n(8), ' ')} {n(2)}",
                 lambda: f"{rng.choice(['AT', 'PT', 'BE'])}{n(20)}", lambda: f"{rng.choice(['CH', 'PL'])}{n(2)}{grouped(n(16), ' ')}"],
        "code": [lambda: f"{upper(2)}{n(2)}{upper(8)}", lambda: f"{upper(2)}{n(2)} {upper(4)} {upper(4)}", lambda: f"{upper(2)}{n(6)}{upper(6)}", lambda: f"{upper(2)}{n(10)}"],
        "card": [lambda: checked(16), lambda: grouped(checked(16), "-"), lambda: grouped(checked(16), " "), lambda: checked(15)],
        "long": [lambda: checked(rng.choice([13, 14, 16, 18]), rng.random() < 0.1), lambda: checked(rng.choice([15, 17, 19]), rng.random() < 0.1)],
    }


# Words before a candidate, by kind; those at even places train, those at odd ones are held out.
LEADS = {
    "phone": ("phone", "tel:", "call", "mobile", "Telefon", "whatsapp", "fax", "cell"), "card": ("card", "visa", "credit card", "Karte", "carte", "mastercard"),
    "identity": ("ssn", "social security", "iban", "account", "konto", "tax id"), "mail": ("email", "mail", "contact", "write", "reach", "courriel"),
    "noise": ("order", "invoice", "version", "ref", "sku", "part", "serial", "pages", "build", "date", "batch", "total"),
}
#: Form, context, whether it is personal.
CASES = (
    ("phone", "phone", 1), ("phone", "phone", 1), ("phone", "mail", 1), ("phone", "noise", 0), ("phone", "", 0), ("date", "", 0), ("date", "noise", 0), ("date", "phone", 0),
    ("number", "", 0), ("number", "noise", 0), ("mail", "mail", 1), ("mail", "", 1), ("mail", "phone", 1), ("meet", "", 0), ("meet", "noise", 0),
    ("ssn", "identity", 1), ("ssn", "identity", 1), ("ssn", "", 0), ("ssn", "noise", 0), ("iban", "identity", 1), ("iban", "", 1), ("code", "noise", 0), ("code", "", 0),
    ("card", "card", 1), ("card", "card", 1), ("long", "card", 1), ("long", "noise", 0), ("long", "", 0), ("card", "noise", 0), ("long", "phone", 0),
)


def examples(count: int, held: bool, seed: int) -> list[tuple[str, int]]:
    """Seeded lines with one candidate each, and whether it is personal; of held-out layouts and words or of the others."""
    rng = random.Random(seed)
    layouts, out = _layouts(rng), []
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    for _ in range(count):
        form, context, label = rng.choice(CASES)
        stray = rng.random()
        if stray < BARE:
            context = ""
        elif stray < BARE + ASTRAY:
            context = rng.choice(sorted(LEADS))
        lead = rng.choice(LEADS[context][held::2]) if context else word()
        lead = lead.upper() if rng.random() < 0.05 else lead
        tail = rng.choice(["%", " eur", ""]) if not label and rng.random() < 0.2 else ""
        mark = rng.choice(["#", "="]) if not label and rng.random() < 0.2 else ""
        fill = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(2)]
        between = rng.choice([" ", " ", ": ", " is ", " no "])
        out.append((f"{fill[0]} {lead}{between}{mark}{rng.choice(layouts[form][held::2])()}{tail} {fill[1]}.", label))
    return out


def described(spark: SparkSession, lines: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and line of every candidate that the generators find in labelled lines."""
    df, names = _candidates(spark.createDataFrame([(*line, k) for k, line in enumerate(lines)], "t string, y int, line int"), "t", "g_")
    rows = F.flatten(F.array(*[_described(F.col("t"), name, k) for k, name in enumerate(names)]))
    table = df.select("y", "line", F.explode(rows).alias("c")).select("y", "line", "c.x").orderBy("line", "x").collect()  # a few rows an example
    return tuple(np.array([r[c] for r in table], float) for c in ("x", "y", "line"))


_models: dict[str, tuple[Forest, tuple[float, ...], dict[str, tuple[float, float]]]] = {}


def model(spark: SparkSession) -> tuple[Forest, tuple[float, ...], dict[str, tuple[float, float]]]:
    """The forest, each generator's threshold, and its precision and recall on further held-out
    lines than those that set the threshold.  It is fitted once an application."""
    known = spark.sparkContext.applicationId
    if known not in _models:
        lines = [examples(EXAMPLES, False, SEED), examples(EXAMPLES, True, SEED + 1), examples(EXAMPLES, True, SEED + 2)]
        x, y, line = described(spark, sum(lines, []))
        part = line // EXAMPLES
        forest = boost(x[part == 0], y[part == 0])
        score = forest.score(x)
        cuts, told = [], {}
        for k, (name, _) in enumerate(GENERATORS):
            mine = x[:, 0] == k
            cuts.append(threshold(score[mine & (part == 1)], y[mine & (part == 1)], PRECISION))
            fresh = mine & (part == 2)
            picked = fresh & (score >= cuts[-1])
            told[name] = (float(y[picked].mean()) if picked.any() else 1.0, float(y[picked].sum() / max(1.0, y[fresh].sum())))
        _models.clear()
        _models[known] = forest, tuple(cuts), told
    return _models[known]


_PICKED = "array<struct<rank:int,start:int,end:int,kind:string>>"


def scan_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``<out>_base`` and ``<out>_spans``: sorted (rank, start, end, kind).

    ``<out>_base`` holds the base kinds, ``<out>_spans`` those and the selected
    candidates that overlap none of them; of selected candidates that overlap, the one
    with the highest score stays.  Positions are code points, ends exclusive.  A null
    text counts as empty; rows are independent, so repeated rows, null ids and other
    columns change nothing (columns of those two names are replaced).  Texts of any
    length are scanned whole; an empty table gives no rows.
    """
    forest, cuts, _ = model(docs.sparkSession)
    base_col, p = f"{out}_base", prefix(docs)
    t = f"{p}t"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text = F.col(t)
    df = find_spans(df, f"{p}email", t, EMAIL, F.contains(text, F.lit("@")))
    df = find_spans(df, f"{p}ip", t, IP, text.rlike(r"[0-9]\.[0-9]"))
    df = find_spans(df, f"{p}card", t, CARD, text.rlike("[0-9]"))
    df = find_spans(df, f"{p}phone", t, PHONE, F.contains(text, F.lit("+")))
    size = lambda s: F.length(_digits(s["match"]))
    valid = {
        "email": F.col(f"{p}email"),
        "ip": F.filter(f"{p}ip", lambda s: s["match"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": F.filter(f"{p}card", lambda s: size(s).between(13, 19) & luhn(_digits(s["match"]))),
        "phone": F.filter(f"{p}phone", lambda s: size(s).between(9, 15)),
    }
    base = F.concat(*[tagged(valid[kind], kind, k, True) for k, kind in enumerate(KINDS)])
    df = df.withColumn(base_col, F.sort_array(base)).drop(f"{p}email", f"{p}ip", f"{p}card", f"{p}phone")
    df, names = _candidates(df, t, f"{p}g_")

    def selected(k: int, name: str) -> Column:
        def judge(c: Column) -> Column:
            score = forest.column([c["x"][i] for i in range(len(FEATURES))])
            place = F.struct(F.lit(len(KINDS) + k).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), F.lit(GENERATORS[k][0]).alias("kind"))
            return F.struct((-score).alias("less"), place.alias("span"))

        return F.filter(F.transform(_described(text, name, k), judge), lambda x: x["less"] <= F.lit(-cuts[k]))

    kind = f"array<struct<less:double,span:{_PICKED[6:-1]}>>"
    some = F.lit(False)
    for name in names:
        some = some | (F.size(name) > 0)
    picked = F.when(some, F.sort_array(F.concat(*[selected(k, name) for k, name in enumerate(names)]))).otherwise(F.array().cast(kind))
    df = df.withColumn(f"{p}picked", picked).drop(*names)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda acc, x: ~F.exists(acc, lambda a: meets(a, x["span"])) & ~F.exists(base_col, lambda b: meets(b, x["span"]))
    best = F.aggregate(f"{p}picked", F.array().cast(_PICKED), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x["span"]))).otherwise(acc))
    return df.withColumn(f"{out}_spans", F.sort_array(F.concat(base_col, best))).drop(f"{p}picked", t)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, their digest, all spans written out, and their number."""
    df = scan_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"),
                     F.size("pii_spans").cast("long").alias("n_spans"))


def redact_pii(docs: DataFrame, text_col: str = "text", mark: str = "<PII>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; other columns, whatever their names, and rows stay."""
    p = prefix(docs)
    df = scan_pii(docs, text_col, f"{p}pii")
    found = f"{p}pii_spans"
    ranges = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.col(text_col).cast("string")
    new = F.when(F.size(found) > 0, redacted(text, merged(ranges), mark)).otherwise(text)
    return df.withColumn(text_col, new).select(*docs.columns)
