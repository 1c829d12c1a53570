"""SQL of the operators of vectors, quality rules and conversation repair, put together from their rules."""

from __future__ import annotations

from bizfit.llm.quality import BASE, DOUBT, PRIOR, ROUNDS, RULES, pattern

#: The contract's white space, in a character class.
_SPACE = r"[\x20\x09-\x0D]"


def _grown(value: str, cost: str, letter: str) -> str:
    """A state's value, cost in six digits and edits, after one more edit; null stays null."""
    return f"lpad(CAST(CAST(left({value}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({value}, 7) || '{letter}'"


def _closed(start: str, system: str, user: str, assistant: str, source: str, more: str) -> str:
    """The four states of ``source`` with rows inserted."""
    users = f"least({user}, {_grown(start, '2', 'I')}, {_grown(system, '2', 'I')}, {_grown(assistant, '2', 'I')})"
    return f"SELECT conv_id, n, st, sy, us, least(asst, {_grown('us', '2', 'I')}) AS asst FROM (SELECT {more}, {start} AS st, {system} AS sy, {users} AS us, {assistant} AS asst FROM {source})"


_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(crc_key, ''), lambda x: ord(x)::BIGINT)), "
    "lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_STAY = "CAST(fault IS NOT DISTINCT FROM 'truncated' AS INT)"
_MAY = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'"
_RAW_STATES = {
    "st": _grown("st", "3", "D"),
    "sy": f"least({_grown('sy', '3', 'D')}, CASE WHEN {_MAY} AND initial = 's' THEN {_grown('st', _STAY, 'K')} END)",
    "us": f"least({_grown('us', '3', 'D')}, CASE WHEN {_MAY} THEN least("
    + ", ".join(f"{_grown(s, f'2 + {_STAY}', 'R')}, CASE WHEN initial = 'u' THEN {_grown(s, _STAY, 'K')} END" for s in ("st", "sy", "asst"))
    + ") END)",
    "asst": f"least({_grown('asst', '3', 'D')}, CASE WHEN {_MAY} THEN least({_grown('us', f'2 + {_STAY}', 'R')}, CASE WHEN initial = 'a' THEN {_grown('us', _STAY, 'K')} END) END)",
}

REPAIR_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS crc_key FROM conversations
), dealt AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS kind FROM keyed),
bad AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM dealt, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END)
), rows_ AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_char FROM bad
), faults AS (
  SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
         WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM rows_
), costs AS (
  SELECT conv_id, 0 AS n, '000000' AS st, CAST(NULL AS VARCHAR) AS sy, '000002I' AS us, '000004II' AS asst FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  {_closed('st', 'sy', 'us', 'asst', f"(SELECT c.conv_id, c.n + 1 AS n, {', '.join(f'{v} AS {k}' for k, v in _RAW_STATES.items())} FROM costs c JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.k = c.n + 1)", 'conv_id, n')}
), ends AS (
  SELECT conv_id, arg_max(least(st, asst), n) AS best FROM costs GROUP BY conv_id
), audits AS (SELECT conv_id, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM ends),
steps AS (
  SELECT conv_id, j, substr(audit, j, 1) AS edit, length(replace(left(audit, j), 'I', '')) AS k, length(replace(left(audit, j), 'D', '')) AS place
  FROM audits, unnest(range(1, length(audit) + 1)) AS t(j)
), placed AS (
  SELECT s.*, f.role, f.text, f.initial FROM steps s LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k AND s.edit <> 'I' WHERE edit <> 'D'
), led AS (
  SELECT *, max(CAST(place = 1 AND edit = 'K' AND initial = 's' AS INT)) OVER (PARTITION BY conv_id) AS lead FROM placed
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS repaired_sha256
  FROM led GROUP BY conv_id
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM audits a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def _codes_sql(rounds: int = 4) -> str:
    def nearest(k: int) -> str:
        product = "list_inner_product(x, c)"
        return f"a{k} AS MATERIALIZED (SELECT ord, p, arg_min(entry, (cc - 2 * {product}) * 256 + entry) AS entry, min(xx + cc - 2 * {product}) AS d FROM parts JOIN c{k} USING (p) GROUP BY ord, p)"

    def moved(k: int) -> str:
        means = f"SELECT p, entry, i, floor(sum(y) / count(*)) AS y FROM (SELECT p, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k} JOIN parts USING (ord, p)) GROUP BY ALL"
        return (
            f"m{k} AS MATERIALIZED (SELECT p, entry, list(y ORDER BY i) AS m FROM ({means}) GROUP BY p, entry), "
            f"c{k + 1} AS MATERIALIZED (SELECT p, entry, coalesce(m, c) AS c, list_inner_product(coalesce(m, c), coalesce(m, c)) AS cc FROM c{k} LEFT JOIN m{k} USING (p, entry))"
        )

    steps = ", ".join(f"{nearest(k)}, {moved(k)}" for k in range(rounds))
    return rf"""
WITH vectors AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS ord, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS MATERIALIZED (
  SELECT ord, p, x, list_inner_product(x, x) AS xx FROM (SELECT ord, p, v[(p * len(v)) // 4 + 1 : ((p + 1) * len(v)) // 4] AS x FROM vectors, unnest(range(4)) AS t(p))
), c0 AS MATERIALIZED (SELECT p, ord - 1 AS entry, x AS c, xx AS cc FROM parts WHERE ord <= 256),
{steps}, {nearest(rounds)},
book AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM (SELECT p, entry, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM c{rounds})),
coded AS (SELECT ord, string_agg(lower(printf('%02x', entry)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY ord)
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM vectors JOIN coded USING (ord), book
"""


CODES_SQL = _codes_sql()


def _letters(chars: str) -> str:
    return f"length(regexp_replace(text, '[^{chars}]', '', 'g'))"


def _quality_sql() -> str:
    clip = lambda x: f"greatest({DOUBT}, least(1 - {DOUBT}, {x}))"
    steps = []
    for k in range(ROUNDS):
        bad, good = (f"(sum(n * {w}) FILTER (WHERE x = 'b') + {more}) / (coalesce(sum(n * {w}), 0) + {PRIOR})" for w, more in (("(1 - good)", PRIOR), ("good", 0)))
        bad, good = (clip(f"coalesce({x}, {y} / (coalesce(sum(n * {w}), 0) + {PRIOR}))") for x, y, w in ((bad, PRIOR, "(1 - good)"), (good, 0.0, "good")))
        steps.append(f"s{k} AS MATERIALIZED (SELECT r, greatest(b, g) AS b, g FROM (SELECT r, {bad} AS b, {good} AS g FROM casts JOIN g{k} USING (votes) GROUP BY r))")
        steps.append(f"o{k} AS MATERIALIZED (SELECT ln(p / (1 - p)) AS base FROM (SELECT {clip(f'(sum(n * good) + {PRIOR}) / (sum(n) + 2 * {PRIOR})')} AS p FROM g{k} JOIN seen USING (votes)))")
        adds = "coalesce(sum(CASE x WHEN 'b' THEN ln(g / b) ELSE ln((1 - g) / (1 - b)) END), 0)"
        steps.append(f"g{k + 1} AS MATERIALIZED (SELECT votes, odds, 1 / (1 + exp(-odds)) AS good FROM (SELECT votes, any_value(base) + {adds} AS odds FROM seen LEFT JOIN casts USING (votes, n) LEFT JOIN s{k} USING (r), o{k} GROUP BY votes))")
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
w AS MATERIALIZED (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i, array_to_string(words[i : i + 7], ' ') AS win, i + 7 <= len(words) AS whole FROM split),
p AS (SELECT *, lag(word) OVER b AS w1, lag(word, 2) OVER b AS w2, count(*) FILTER (WHERE whole) OVER (PARTITION BY rid, win) AS m FROM w WINDOW b AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM p, unnest(range(8)) AS t(j) WHERE whole AND m > 1 GROUP BY rid),
per AS (SELECT rid, count(*) FILTER (WHERE word = w1) AS n_repeats, count(*) FILTER (WHERE word = w1 AND word = w2) AS n_triples, count(*) FILTER (WHERE NOT regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]')) AS n_letterless,
  count(*) FILTER (WHERE NOT regexp_full_match(word, '([0-9A-Za-z]|[^\x00-\x7F])+[.,;:!?]?')) AS n_decorated FROM p GROUP BY rid),
top AS (SELECT rid, max(c) AS n_commonest FROM (SELECT rid, word, count(*) AS c FROM w GROUP BY rid, word) GROUP BY rid),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_letters("#*$%&|<>")} AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, {_letters("A-Z")} AS n_upper, {_letters("a-z")} AS n_lower, {_letters("!")} AS n_exclamations, {_letters(".?!")} AS n_stops, {_letters("0-9")} AS n_digits,
         {_letters("!-/:-@" + chr(92) + "[-`{-~")} AS n_marks, coalesce(n_repeats, 0) AS n_repeats, coalesce(n_triples, 0) AS n_triples, coalesce(n_letterless, 0) AS n_letterless, coalesce(n_decorated, 0) AS n_decorated, coalesce(n_commonest, 0) AS n_commonest
  FROM split LEFT JOIN rep USING (rid) LEFT JOIN per USING (rid) LEFT JOIN top USING (rid)
), voted AS MATERIALIZED (SELECT doc_id, {", ".join(BASE)}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {pattern()} AS votes FROM counted),
seen AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
casts AS MATERIALIZED (SELECT votes, n, r, substr(votes, r, 1) AS x FROM seen, unnest(range(1, {len(RULES) + 1})) AS t(r) WHERE substr(votes, r, 1) <> '-'),
g0 AS MATERIALIZED (SELECT votes, 1 - contains(votes, 'b')::INT * 0.5::DOUBLE - (length(replace(votes, 'g', '')) > length(replace(votes, 'b', '')))::INT * 0.4::DOUBLE AS good FROM seen),
{", ".join(steps)}
SELECT doc_id, {", ".join(f"{c}::BIGINT AS {c}" for c in BASE)}, base_failed, NOT base_failed AND odds >= 0 AS kept, round(good, 4) AS posterior, votes FROM voted JOIN g{ROUNDS} USING (votes)
"""


QUALITY_SQL = _quality_sql()
