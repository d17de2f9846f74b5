"""DuckDB SQL for the queries of this folder that SQL can express, built from the same rule tables."""

from __future__ import annotations

from tidewatch.llm import decontaminate, quality_rules, url_filters

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filters_sql() -> str:
    rank = sorted(url_filters.SITE_RULES, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = {r: f"((host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}))" for r in rank}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN {quoted(r.host + r.path)}" for r in rank) + " END"
    given = "CASE " + " ".join(f"WHEN {fits[r]} THEN {quoted(r.verdict)}" for r in rank) + " END"
    names = sorted(url_filters.PATTERN_RULES, key=lambda r: (r.verdict, r.name))
    match = "CASE " + " ".join(f"WHEN regexp_matches(low, {quoted(r.pattern)}) THEN {{}}".format(quoted(r.name)) for r in names) + " END"
    found = "CASE " + " ".join(f"WHEN regexp_matches(low, {quoted(r.pattern)}) THEN {{}}".format(quoted(r.verdict)) for r in names) + " END"
    return f"""
    WITH parts AS (
      SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        CASE WHEN contains(url, '://') THEN {LOWER.format('url')} ELSE '' END AS low
      FROM pages),
    judged AS (SELECT *, {rule} AS rule, {given} AS given, {match} AS pattern, {found} AS found FROM parts)
    SELECT page_id, host, path, rule, coalesce(given, found, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
    FROM judged"""


URL_FILTERS = url_filters_sql()


def quality_rules_sql() -> str:
    stops = ", ".join(quoted(x) for x in sorted(set(quality_rules.STOP_WORDS)))
    failed = []
    for r in quality_rules.DEFAULT_RULES:
        tests = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        failed.append(f"CASE WHEN NOT ({' AND '.join(tests)}) THEN {quoted(r.name)} END")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM d),
    win AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    dup AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT k, count(DISTINCT i + o) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY k),
    m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{SPACE}+', '', 'g')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(ln) AS n_lines,
        len(list_intersect(list_transform(w, lambda x: lower(x)), [{stops}])) AS n_stops,
        len(list_filter(ln, lambda x: regexp_matches(x, '(\\.\\.\\.|…){SPACE}*$'))) AS n_ellipsis,
        len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS n_shouts
      FROM w LEFT JOIN rep USING (k)),
    b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
    f AS (SELECT *, CASE WHEN base_failed THEN '' ELSE array_to_string(list_filter([{', '.join(failed)}], lambda x: x IS NOT NULL), ',') END AS failed FROM b)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
      n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed
    FROM f"""


QUALITY_RULES = quality_rules_sql()


EMPTY = "''"


def word_list(column: str) -> str:
    return f"list_filter(string_split_regex({LOWER.format(f'coalesce({column}, {EMPTY})')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def decontamination_ctes(documents: str = "documents") -> str:
    """CTEs of which the last, ``contamination``, has a row per document with its row number k."""
    n = decontaminate.LENGTH
    return f"""
    docs AS (SELECT row_number() OVER () AS k, *, {word_list('text')} AS w FROM {documents}),
    iw AS (SELECT item_id::VARCHAR AS item, w, least(len(w), {n}) AS n FROM (SELECT item_id, {word_list('text')} AS w FROM benchmark) WHERE len(w) > 0),
    ix AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM iw)),
    dw AS (SELECT k, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
      FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM ix) WHERE len(w) >= n)),
    hits AS (SELECT k, s, n, win FROM dw SEMI JOIN ix USING (n, win)),
    hw AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS p FROM hits) GROUP BY k),
    hi AS (SELECT k, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items
      FROM hits JOIN ix USING (n, win) WHERE item IS NOT NULL GROUP BY k),
    contamination AS (SELECT docs.*, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
      FROM docs LEFT JOIN hw USING (k) LEFT JOIN hi USING (k))"""


DECONTAMINATION = f"""
    WITH {decontamination_ctes()}
    SELECT doc_id, n_words::BIGINT AS n_words, n_hit::BIGINT AS n_hit, n_items::BIGINT AS n_items, sha256(items) AS items_sha256, n_hit > 0 AS contaminated
    FROM contamination"""
