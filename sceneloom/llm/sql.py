"""DuckDB SQL for the operators that SQL can express, written from their definitions."""

import string

from .quality import CHAR_CLASSES, COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_WORDS_FOR_COMMON

_REST = "t"
_CLASSES = []
for _k, _c in enumerate(CHAR_CLASSES):
    _next = f"regexp_replace({_REST}, '[{_c.replace(chr(39), chr(39) * 2)}]+', '', 'g')"
    _CLASSES.append(f"length({_REST}) - length({_next})")
    _REST = _next
_CLASSES.append(f"length({_REST})")

_PART = "(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END)"


def _distance(p: str, q: str) -> str:
    a, b = _PART.format(a="z[1]", b="z[2]"), _PART.format(a="z[2]", b="z[1]")
    return f"sqrt(abs(list_sum(list_transform(list_zip({p}, {q}), lambda z: {a} + {b}))) / 2)"


QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    [{", ".join(_CLASSES)}] AS cs
  FROM d
),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
chars AS (
  SELECT lang, list_transform(range(1, {len(CHAR_CLASSES) + 2}), lambda k: list_sum(list_transform(all_cs, lambda c: c[k]))) AS sums
  FROM (SELECT lang, list(cs) AS all_cs FROM w GROUP BY lang)
),
char_ref AS (SELECT lang, list_transform(sums, lambda s: s / greatest(list_sum(sums), 1)) AS p FROM chars),
words AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, lower(unnest(ws)) AS word FROM w) GROUP BY lang, word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k, sum(n) OVER (PARTITION BY lang) AS total FROM words),
word_ref AS (
  SELECT lang, list(word ORDER BY k) AS top, list_concat(list(n / total ORDER BY k), [(max(total) - sum(n)) / max(total)]) AS p
  FROM ranked WHERE k <= {COMMON_WORDS} GROUP BY lang
),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(list_aggregate(list_concat(ws, ['']), 'string_agg', '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    CASE WHEN len(ws) > 0 THEN {_distance("list_transform(cs, lambda c: c / length(t))", "char_ref.p")} END AS char_distance,
    CASE WHEN len(ws) >= {MIN_WORDS_FOR_COMMON} THEN {_distance("list_transform(list_concat(list_transform(top, lambda x: len(list_filter(ws, lambda y: lower(y) = x))), [len(list_filter(ws, lambda y: NOT list_contains(top, lower(y))))]), lambda c: c / len(ws))", "word_ref.p")} END AS word_distance
  FROM w LEFT JOIN rep USING (r)
    LEFT JOIN char_ref ON w.lang IS NOT DISTINCT FROM char_ref.lang
    LEFT JOIN word_ref ON w.lang IS NOT DISTINCT FROM word_ref.lang
),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_distance > {MAX_CHAR_DISTANCE}, false) AND NOT coalesce(word_distance > {MAX_WORD_DISTANCE}, false) AS kept
FROM f
"""


def mixing_sql(weights, most: int, block: int, seed: str, shards: int) -> str:
    """All quotients of all sources ranked outright."""
    upto = lambda w: f"(base * ({w}) + {block} * ((({w}) // {block} * rest + off) // n) + ((({w}) // {block} + 1) * rest + off) // n * (({w}) % {block}) - (({w}) // {block} * rest + off) // n * (({w}) % {block}))"
    picks = lambda j: f"(base * {j} + ({j} * rest + off) // n)"
    return f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '-')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, weights))}][place % {len(weights)} + 1] AS weight, {most} * source_size AS cap, sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared
  FROM w
),
held AS (SELECT *, cap * shared < weight * rest AS above FROM o),
level AS (SELECT any_value(total) - coalesce(sum(cap) FILTER (WHERE above), 0) AS rest, coalesce(sum(weight) FILTER (WHERE NOT above), 1) AS shared FROM held),
t AS (SELECT source, source_size, place, CASE WHEN above THEN cap::DOUBLE ELSE (weight * level.rest)::DOUBLE / level.shared::DOUBLE END AS target, total FROM held, level),
q AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place) AS r, total FROM (SELECT place, target, total, unnest(generate_series(0, (target // {block})::BIGINT + 2)) AS k FROM t WHERE target > 0)),
seats AS (SELECT place, count(*) AS seats FROM q WHERE r <= (total + {block} - 1) // {block} GROUP BY place),
house AS (SELECT t.place, s, count(*) FILTER (WHERE r <= ((t.total + {block} - 1) // {block}) * (s + 1) // {shards}) AS c FROM t CROSS JOIN (SELECT unnest(range({shards})) AS s) LEFT JOIN q ON q.place = t.place GROUP BY ALL),
uptos AS (SELECT place, list(c ORDER BY s) AS upto FROM house GROUP BY place),
n AS (SELECT *, greatest((source_size + {block} - 1) // {block}, 1) AS n FROM t LEFT JOIN seats USING (place)),
b AS (
  SELECT source, source_size, target, n, upto, least(coalesce(seats, 0), {most} * n) // n AS base, least(coalesce(seats, 0), {most} * n) % n AS rest,
    ('0x' || substr(md5('{seed}:' || coalesce(source, '-')), 1, 12))::BIGINT % n AS off
  FROM n JOIN uptos USING (place)
),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN len(list_filter(upto, lambda u: u <= {picks(f"(pos // {block})")})) END::INT AS first_shard,
  CASE WHEN taken > 0 THEN len(list_filter(upto, lambda u: u <= {picks(f"((pos + size + {block - 1}) // {block})")} - 1)) END::INT AS last_shard
FROM (SELECT *, ({upto("(pos + size)")} - {upto("pos")})::BIGINT AS taken FROM (SELECT doc_id, p.size::BIGINT AS size, pos, source_size, target, n, upto, base, rest, off FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source))
"""


#: What each pattern rule says, over ``t``, the lower-case host and tail, ``host``, and ``w``: t with a space for each separator and at both ends.
_PATTERNS = {
    "||spam-farm.": "starts_with(host, 'spam-farm.') OR contains(host, '.spam-farm.')",
    "-spam.": "contains(t, '-spam.')",
    "^casino^": "contains(w, ' casino ')",
    "^poker^": "contains(w, ' poker ')",
    "^adult^": "contains(w, ' adult ')",
    "/wp-login.php": "contains(t, '/wp-login.php')",
    "/cgi-bin/*.cgi^": "contains(t, '/cgi-bin/') AND regexp_matches(substr(t, strpos(t, '/cgi-bin/') + 9), '[.]cgi([^a-z0-9_%]|$)')",
    "^phishing^": "contains(w, ' phishing ')",
}


def url_rules_sql(host_rules, pattern_rules, default: str) -> str:
    """Every rule on every URL, by string comparison."""
    rows = ", ".join(f"('{r.verdict}', '{r.text[2:].partition('/')[0]}', '/{r.text[2:].partition('/')[2]}')" for r in host_rules)
    pick = lambda v: " OR ".join(f"({_PATTERNS[r.text]})" for r in pattern_rules if r.verdict == v) or "false"
    low = lambda x: f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rows}),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT r, page_id, {low("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {low("rest")} AS t,
    ' ' || regexp_replace({low("rest")}, '[^a-z0-9_%]', ' ', 'g') || ' ' AS w
  FROM p
),
fit AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {pick("block")} THEN 'block' WHEN {pick("allow")} THEN 'allow' ELSE '{default}' END) AS verdict
FROM h LEFT JOIN fit USING (r)
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: each character is mixed in before its eight shifts."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda k: [ascii(substr({text}, k, 1)), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda x: x::BIGINT)), {step}), 4294967295::BIGINT)"


def conversation_repair_sql(steps: dict[str, list[tuple[int, int, int, str]]], ends: dict[int, tuple[int, str]]) -> str:
    """Damage, faults, the cheapest repair and its text. The audits of each state are kept as strings, row by row."""
    ways = ", ".join(f"('{letter}', {a}, {b}, {c}, '{audit}')" for letter, those in steps.items() for a, b, c, audit in those)
    last = ", ".join(f"({state}, {c}, '{audit}')" for state, (c, audit) in ends.items())
    space = lambda c: f"coalesce({c}::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE named AS (
    SELECT conv_id, turn, {space("role")} AS role, {space("text")} AS text, {space("conv_id")} || ':' || {space("turn")} AS named FROM conversations
), hit AS (
    SELECT *, {crc32_sql("named")} % 20 AS hit FROM named
), after AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
    FROM hit, (SELECT unnest([0, 1]) AS copy) WHERE hit <> 0 AND (copy = 0 OR hit = 3)
), judged AS (
    SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS solid,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        substr(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1, 1) || substr(role, 1, 1) AS pair
    FROM after
), faults AS (
    SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
        CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS initial
    FROM judged
), letters AS (
    SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS letter FROM faults
), talks AS (
    SELECT conv_id, count(DISTINCT turn) AS turns, min(turn) AS first, max(turn) AS last,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(letter, '' ORDER BY pos) AS signature,
        list(role ORDER BY pos) AS roles, list(text ORDER BY pos) AS texts
    FROM letters GROUP BY conv_id
), signatures AS (SELECT DISTINCT signature FROM talks),
ways(letter, a, b, cost, audit) AS (VALUES {ways}),
ends(state, cost, audit) AS (VALUES {last}),
layers AS (
    SELECT signature, 0 AS k, 0 AS state, 0 AS cost, '' AS audit FROM signatures
    UNION ALL
    SELECT signature, k, state, best.c, best.s FROM (
        SELECT l.signature, l.k + 1 AS k, w.b AS state, min({{'c': l.cost + w.cost, 's': l.audit || w.audit}}) AS best
        FROM layers l JOIN ways w ON w.letter = substr(l.signature, l.k + 1, 1) AND w.a = l.state
        WHERE l.k < length(l.signature) GROUP BY ALL)
), answers AS (
    SELECT signature, min({{'c': l.cost + e.cost, 's': l.audit || e.audit}}) AS best FROM layers l JOIN ends e USING (state)
    WHERE k = length(signature) GROUP BY signature
), edits AS (
    SELECT conv_id, best.c AS cost, best.s AS audit, roles, texts, n, substr(best.s, n, 1) AS edit,
        length(replace(substr(best.s, 1, n), 'I', '')) AS row
    FROM talks JOIN answers USING (signature), LATERAL (SELECT unnest(range(1, length(best.s) + 1)) AS n)
), written AS (
    SELECT *, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY n) AS place,
        bool_or(edit = 'K' AND substr(roles[row], 1, 1) = 's') OVER (PARTITION BY conv_id) AS headed
    FROM edits
), lines AS (
    SELECT conv_id, n, CASE WHEN edit = 'K' THEN roles[row] WHEN (place - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
        || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[row] END AS line
    FROM written WHERE edit <> 'D'
), texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY conv_id)
SELECT conv_id, coalesce(last - first + 1 - turns, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.s, '') AS audit,
    sha256(coalesce(texts.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN talks USING (conv_id) LEFT JOIN answers USING (signature) LEFT JOIN texts USING (conv_id)
"""


def embedding_dedup_sql(least: float) -> str:
    """Every pair of vectors that are not null, empty or zero and hold finite numbers only, and what their links reach."""
    return f"""
WITH RECURSIVE usable AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (SELECT k, v, sqrt(list_dot_product(v, v)) AS norm FROM usable),
links AS (
    SELECT a.k AS a, b.k AS b FROM sized a JOIN sized b ON a.k <> b.k
    WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {least}
), reached AS (
    SELECT k AS a, k AS b FROM usable UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), told AS (
    SELECT r.a AS k, min(u.vec_id) AS component_id FROM reached r JOIN usable u ON u.k = r.b GROUP BY r.a
), counted AS (SELECT a AS k, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0)::BIGINT AS n_links, coalesce(t.component_id, e.vec_id) AS component_id,
    e.vec_id IS NOT DISTINCT FROM coalesce(t.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN usable u USING (vec_id) LEFT JOIN told t USING (k) LEFT JOIN counted c USING (k)
"""
