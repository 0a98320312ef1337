"""Check SQL of the operators that DuckDB can work out over whole tables."""

from __future__ import annotations

from garimpo.llm.quality_rules import ENOUGH, RULES, Rule
from garimpo.llm.topk_search import K, SCALE


def _ratio(rule: Rule) -> str:
    return f"1000 * {rule.part} // greatest({rule.whole}, 1)"


def _limit(rule: Rule) -> str:
    spread = f"{rule.reach} * greatest(q75 - q25, {rule.slack})"
    return f"q75 + {spread}" if rule.high else f"q25 - {spread}"


def _beyond(rule: Rule) -> str:
    sign = ">" if rule.high else "<"
    return f"coalesce({_ratio(rule)} {sign} (SELECT edge FROM edges AS e WHERE e.row = c.row "\
        f"AND e.rule = '{rule.name}'), false)"


_LEVELS = {2: "lang, source", 1: "lang, NULL", 0: "NULL, NULL"}
_HISTOGRAMS = " UNION ALL ".join(
    f"SELECT {level} AS level, {group.split(', ')[0]} AS lang, {group.split(', ')[1]} AS source, "
    f"rule, bin FROM bins"
    for level, group in _LEVELS.items()
)
_BINS = " UNION ALL ".join(
    f"SELECT lang, source, '{rule.name}' AS rule, {_ratio(rule)} AS value FROM counted "
    "WHERE NOT base_failed"
    for rule in RULES
)

QUALITY_RULES = rf"""WITH numbered AS (
    SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text
    FROM documents),
parted AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)),
                    lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines
    FROM numbered),
windows AS (
    SELECT row, place, array_to_string(words[place:place + 4], ' ') AS words
    FROM (SELECT row, words, unnest(generate_series(1, len(words) - 4)) AS place FROM parted)),
repeated AS (
    SELECT row, count(DISTINCT place) AS n_repeat_words FROM (
        SELECT row, unnest(generate_series(place, place + 4)) AS place FROM windows
        QUALIFY count(*) OVER (PARTITION BY row, words) > 1)
    GROUP BY row),
counted AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
        SELECT row, doc_id, lang, source, len(words) AS n_words,
            length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) - len(list_distinct(lines)) AS n_dup_lines,
            coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM parted LEFT JOIN repeated USING (row))),
bins AS (
    SELECT lang, source, rule, value - value % step AS bin FROM (
        SELECT *, CAST(2 ** greatest(length(bin(value)) - 6, 0) AS BIGINT) AS step
        FROM ({_BINS}))),
ranked AS (
    SELECT level, lang, source, rule, bin,
        sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin) AS upto,
        sum(n) OVER (PARTITION BY level, lang, source, rule) AS total
    FROM (SELECT level, lang, source, rule, bin, count(*) AS n
          FROM ({_HISTOGRAMS}) GROUP BY ALL)),
quartiles AS (
    SELECT level, lang, source, rule, min(bin) FILTER (4 * upto >= total) AS q25,
        min(bin) FILTER (4 * upto >= 3 * total) AS q75
    FROM ranked WHERE total >= {ENOUGH} GROUP BY ALL),
limits AS (
    SELECT level, lang, source, rule,
        CASE rule {" ".join(f"WHEN '{r.name}' THEN {_limit(r)}" for r in RULES)} END AS edge
    FROM quartiles),
edges AS (
    SELECT c.row, l.rule, arg_max(l.edge, l.level) AS edge
    FROM counted AS c JOIN limits AS l ON l.level = 0
        OR l.lang IS NOT DISTINCT FROM c.lang
            AND (l.level = 1 OR l.source IS NOT DISTINCT FROM c.source)
    GROUP BY ALL)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT ({" OR ".join(map(_beyond, RULES))}) AS kept
FROM counted AS c"""

TOPK_SEARCH = f"""WITH scaled AS (
    SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT))
        AS x
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT)
            AS score
    FROM scaled AS q JOIN scaled AS c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
    WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= {K}"""

ORACLE_SQL = {"op3_quality_rules": QUALITY_RULES, "op7_topk_search": TOPK_SEARCH}
