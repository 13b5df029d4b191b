"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from foliospark.llm import license_scan, quality_rules
from foliospark.llm.common import LOWER, UPPER

#: The word classes, as patterns that DuckDB reads.
WORD, NOT_SPACE, SPACE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def words(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{WORD}')"


def _ratio(text: str) -> str:
    above, _, below = text.partition(" / ")
    return f"coalesce({above}::DOUBLE / nullif({below}, 0), 0)" if below else f"{above}::DOUBLE"


def _op10() -> str:
    fails = {
        r.name: " OR ".join(
            [f"{_ratio(r.ratio)} < {r.least}"] * (r.least is not None)
            + [f"{_ratio(r.ratio)} > {r.most}"] * (r.most is not None)
        )
        for r in quality_rules.RULES
    }
    failed = ", ".join(f"CASE WHEN {x} THEN '{name}' END" for name, x in fails.items())
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{NOT_SPACE}') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: length(x) <= 5 AND lower(x) IN ({stop}))) AS n_stop_words
      FROM w LEFT JOIN c USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {failed}) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed = '' AS kept, failed FROM v"""


def _op9() -> str:
    places, n_grams = [], []
    for t, exact, label, k, w in license_scan.phrases():
        places += [f"({t}, {i}, {k}, '{' '.join(w[i : i + k])}')" for i in range(len(w) - k + 1)]
        n_grams.append(f"({t}, {str(exact).lower()}, '{label}', {k}, {len(w) - k + 1})")
    two, five = (" || ' ' || ".join(f"ws[i + {j}]" for j in range(k)) for k in (license_scan.K_BASE, license_scan.K))
    return f"""
WITH p(template, t_place, k, gram) AS (VALUES {", ".join(places)}),
q(template, exact, label, k, n_grams) AS (VALUES {", ".join(n_grams)}),
w AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
e AS (SELECT rid, i, 2 AS k, {two} AS gram FROM w, unnest(range(1, len(ws))) AS u(i)
      UNION ALL SELECT rid, i, 5 AS k, {five} AS gram FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
v AS (SELECT rid, template, t_place, i - 1 - t_place AS diagonal FROM e JOIN p USING (k, gram)),
d AS (SELECT rid, template, diagonal, list(t_place) AS ts FROM v GROUP BY ALL),
g AS (SELECT *, CASE WHEN exact THEN 1
        WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {license_scan.SLACK} THEN 1 ELSE 0 END AS apart
      FROM d JOIN q USING (template)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS island FROM g),
m AS (SELECT rid, exact, label, n_grams, template, k, island, len(list_distinct(flatten(list(ts)))) AS n_found,
        min(diagonal + list_min(ts)) AS first_word, max(diagonal + list_max(ts) + k - 1) AS last_word FROM s GROUP BY ALL),
f AS (SELECT *, n_found / n_grams AS coverage FROM m
      WHERE CASE WHEN exact THEN n_found = n_grams
        ELSE n_found >= least({license_scan.GRAMS}, n_grams) AND n_found >= {license_scan.DENSITY} * (last_word - first_word - k + 2) END),
h AS (SELECT * FROM f AS s WHERE exact OR NOT EXISTS (
        SELECT 1 FROM f AS t WHERE NOT t.exact AND t.rid = s.rid AND t.first_word <= s.last_word AND s.first_word <= t.last_word
          AND (t.n_found > s.n_found OR t.n_found = s.n_found AND (t.coverage > s.coverage OR t.coverage = s.coverage AND t.template < s.template)))),
a AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(first_word) FILTER (exact) AS first_word,
        max(first_word) FILTER (exact) AS last_word,
        array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, round(max(coverage), 6) AS score
      FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN a USING (rid)"""


def _op1() -> str:
    return f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {words("text")} AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item, array_to_string(ws[i:least(i + 9, len(ws))], ' ') AS gram, least(10, len(ws)) AS m
      FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT rid, i, k.m AS m, array_to_string(ws[i:i + k.m - 1], ' ') AS gram
      FROM d, (SELECT DISTINCT m FROM p) k, unnest(range(1, greatest(len(ws) - k.m + 1, 0) + 1)) AS u(i)),
h AS (SELECT rid, i, m, item FROM g JOIN p USING (m, gram)),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT rid, i, m FROM h), unnest(range(i, i + m)) AS u(x) GROUP BY rid),
n AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM h GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN n USING (rid)"""


def _op2() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, i, ls[i] AS line,
        translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
      FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
m AS (SELECT rid, i, line, f.k IS NOT NULL AS dropped FROM l LEFT JOIN f USING (k)),
s AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256 FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN s USING (rid)"""


ORACLES = {
    "op1_decontaminate": _op1(),
    "op2_line_dedup": _op2(),
    "op9_license_scan": _op9(),
    "op10_quality_rules": _op10(),
}
