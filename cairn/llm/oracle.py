"""SQL for DuckDB of the corpus queries that SQL can express, over whole tables.

Each restates its query's meaning by plain means (all pairs, all windows), not by the
operator's method.
"""

from __future__ import annotations

from cairn.llm import quality_rules as q
from cairn.llm.mixing import LEVELS, Mix

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ledger() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in q.RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
win AS (SELECT rid, u.i, w[u.i:u.i + 4] AS g FROM t, unnest(range(1, len(w) - 3)) u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)"""


def _rules() -> str:
    base, policy = q.mask_of(q.BASE), q.mask_of(q.POLICIES[q.PRODUCTION])
    sole = "CASE fail_bits & {0} ".format(policy) + " ".join(f"WHEN {1 << r.bit} THEN '{r.name}'" for r in q.RULES if r.name in q.POLICIES[q.PRODUCTION]) + " END"
    return f"""{_ledger()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {base}) <> 0 AS base_failed,
  (fail_bits & {base | policy}) = 0 AS kept, fail_bits, '{q.PRODUCTION}' AS policy, {sole} AS sole_rule FROM b"""


def _ablations() -> str:
    parts = []
    for policy, names in q.POLICIES.items():
        mask = q.mask_of(names)
        for r in (r for r in q.RULES if r.name in names):
            bit = 1 << r.bit
            parts.append(f"SELECT '{policy}' AS policy, '{r.name}' AS rule, count(*) AS n_failed, count(*) FILTER (WHERE fail_bits & {mask} = {bit}) AS n_regained, "
                         f"bit_or(fail_bits & {mask & ~bit}) AS also_failed FROM b WHERE fail_bits & {bit} <> 0 HAVING count(*) > 0")
    return f"{_ledger()}\n" + "\nUNION ALL ".join(parts)


def _chat() -> str:
    escaped = r"replace(replace(replace(replace({0}, '\', '\\'), '###', '\#\#\#'), '<part>', '\<part\>'), '</turn>', '\</turn\>')"
    return rf"""
WITH every AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS n FROM every),
told AS (SELECT *, lag(role) OVER (PARTITION BY conv_id, alone ORDER BY n) IS NOT DISTINCT FROM role AS merged FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({escaped.format("text")}) + CASE WHEN merged THEN 6 ELSE 14 + length(replace({escaped.format("role")}, ':', '\:')) END)::BIGINT AS formatted_chars
FROM told GROUP BY conv_id, alone"""


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {other} END"


def _mixing(mix: Mix) -> str:
    domain = "CASE " + " ".join(f"WHEN coalesce(source, '') IN ({', '.join(map(repr, s))}) THEN '{d}'" for d, s in mix.domains.items()) + f" ELSE '{mix.other_domain}' END"
    weight = {"domain": _case("domain", mix.domain_weights, f"{mix.other_weight}::DOUBLE"), "lang": _case("lang", mix.lang_weights, f"{mix.other_weight}::DOUBLE"), "source": "1.0::DOUBLE"}
    parts = []
    for k, level in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: k + 1]), ", ".join(LEVELS[:k])
        by = f"PARTITION BY {parent} " if parent else ""
        above = f"JOIN b{k - 1} USING ({parent})" if parent else f"CROSS JOIN (SELECT floor(sum(tokens) * {mix.share}::DOUBLE) AS given FROM leaves) g"
        parts.append(f"n{k} AS (SELECT {keys}, sum(tokens * {mix.epochs})::BIGINT AS cap, {weight[level]} AS weight FROM leaves GROUP BY {keys})")
        parts.append(f"v{k} AS (SELECT *, (given - coalesce(sum(cap) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) "
                     f"/ sum(weight) OVER ({by}ORDER BY cap / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM n{k} {above})")
        parts.append(f"b{k} AS (SELECT {keys}, CASE WHEN cap <= lvl * weight THEN cap::DOUBLE ELSE max(CASE WHEN cap > lvl * weight THEN lvl END) OVER ({by}) * weight END AS given FROM v{k})")
    leaf = ", ".join(LEVELS)
    return f"""
WITH rows AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len({WORDS})::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY {leaf}),
{", ".join(parts)},
plan AS (SELECT {leaf}, tokens, floor(given)::BIGINT AS budget, CASE WHEN tokens > 0 THEN floor(given)::BIGINT // tokens ELSE 0 END AS whole FROM leaves JOIN b2 USING ({leaf})),
hashed AS (SELECT r.*, whole, budget - whole * tokens AS rest, ('0x' || substr(md5('{mix.seed}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS h FROM rows r JOIN plan USING ({leaf})),
taken AS (SELECT *, least(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY h, doc_id) <= rest THEN 1 ELSE 0 END, {mix.epochs}) AS copies FROM hashed)
SELECT doc_id, {leaf}, n_tokens, e::INTEGER AS epoch FROM taken, unnest(range(0, copies)) u(e)"""


def _jaccard() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[u.i:u.i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
cc(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT link.b, cc.root FROM cc JOIN link ON link.a = cc.id WHERE cc.root < link.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(cc.root)) AS component_id,
  (SELECT count(*) FROM link WHERE a = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cc ON cc.id = d.doc_id GROUP BY d.doc_id, n.n"""


def _matches(rid: str, name: str, pattern: str, source: str = "t") -> str:
    """CTE ``name`` (rid, start, finish, m): leftmost non-overlapping matches, in code points."""
    p = pattern.replace("'", "''")
    return f"""
{name}_x AS (SELECT {rid} AS rid, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS gap FROM {source}),
{name}_y AS (SELECT rid, k, m[k] AS m, length(gap[k]) AS g FROM {name}_x, unnest(range(1, len(m) + 1)) u(k)),
{name} AS (SELECT rid, m, sum(g + length(m)) OVER (PARTITION BY rid ORDER BY k) - length(m) AS start, sum(g + length(m)) OVER (PARTITION BY rid ORDER BY k) AS finish FROM {name}_y)"""


def _secrets() -> str:
    from cairn.llm import secrets as s

    first, rest = s.CLASSES
    runs = r"[0-9A-Za-z]{24,}"

    def allowed(string: str) -> str:
        forms = [f"regexp_matches({string}, '{p.replace('*+', '*')}')" for p in s.ALLOWED]
        return " OR ".join(forms + [f"contains('{a}', {string})" for a in s.IN_ORDER])

    windows = []
    for cls, name in ((first, "hexes"), (rest, "wide")):
        w = cls.window
        only = "AND regexp_full_match(m, '[0-9A-Fa-f]+')" if cls is first else ""
        windows.append(f"""
{name}_c AS (SELECT rid, start, m FROM {name} WHERE NOT ({allowed("m")}) {only}),
{name}_w AS (SELECT rid, start, m, start + i - 1 AS pos, substr(m, i::BIGINT, {w}) AS w FROM {name}_c, unnest(range(1, length(m) - {w} + 2)) u(i)),
{name}_h AS (SELECT rid, start, m, pos, w, substr(w, k::BIGINT, 1) AS c, count(*) AS n FROM {name}_w, range(1, {w + 1}) r(k) GROUP BY ALL),
{name}_e AS (SELECT rid, start, m, pos FROM {name}_h GROUP BY rid, start, m, pos, w HAVING {float(w)}::DOUBLE * log2({float(w)}::DOUBLE) - sum(n * log2(n)) >= {cls.floor * w}::DOUBLE),
{name}_p AS (SELECT DISTINCT rid, start, m, pos + k AS p FROM {name}_e, range(0, {w}) r(k)),
{name}_r AS (SELECT rid, start, m, min(p) AS lo, max(p) + 1 AS hi FROM (SELECT *, p - row_number() OVER (PARTITION BY rid, start ORDER BY p) AS g FROM {name}_p) GROUP BY rid, start, m, g),
{name}_k AS (SELECT rid, lo, hi FROM (SELECT *, substr(m, (lo - start + 1)::BIGINT, (hi - lo)::BIGINT) AS s FROM {name}_r) WHERE NOT ({allowed("s")}))""")
    told = "coalesce(string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, ord) FILTER (WHERE {0}), '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_matches("rid", "assigned", s.ASSIGN)}, {_matches("rid", "access", s.ACCESS)}, {_matches("rid", "hex", s.HEX)},
{_matches("rid", "hexes", runs)}, {_matches("rid", "wide", rest.pattern)}, {", ".join(windows)},
base AS (SELECT rid, start, finish, 0 AS ord, 'assign' AS kind FROM assigned WHERE length(regexp_extract(m, '{s.ASSIGN.replace("'", "''")}', 1)) >= 6
  UNION ALL SELECT rid, start, finish, 1, 'access' FROM access UNION ALL SELECT rid, start, finish, 2, 'hex' FROM hex),
high AS (SELECT DISTINCT rid, p FROM (SELECT * FROM hexes_k UNION ALL SELECT * FROM wide_k) e, unnest(range(lo::BIGINT, hi::BIGINT)) r(p)),
island AS (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM high),
run AS (SELECT rid, min(p) AS start, max(p) + 1 AS finish FROM island GROUP BY rid, g),
every AS (SELECT * FROM base UNION ALL SELECT rid, start, finish, 3, 'entropy' FROM run r
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start < r.finish AND r.start < b.finish))
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256({told.format("ord < 3")}) AS base_sha256, {told.format("ord IS NOT NULL")} AS spans, count(kind) AS n_spans
FROM t LEFT JOIN every USING (rid) GROUP BY rid, doc_id"""


ORACLE_SQL = {
    "op1_secret_scans": _secrets(),
    "op3_source_mixing": _mixing(Mix()),
    "op4_ngram_jaccard_join": _jaccard(),
    "op7_quality_rules": _rules(),
    "quality_ablations": _ablations(),
    "op10_chat_formatting": _chat(),
}
