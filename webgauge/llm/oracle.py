"""Comparison SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

MIX_SOURCES = """
WITH RECURSIVE sizes AS (
    SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rated AS (
    SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes
), parted AS (
    SELECT source, greatest(ceil(rate / 64), 1)::INT AS parts, rate / greatest(ceil(rate / 64), 1) AS mean FROM rated
), steps AS (
    SELECT source, parts, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parted
    UNION ALL
    SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
    WHERE k < floor(mean + sqrt(mean) * 12 + 30)
), distribution AS (
    SELECT source, any_value(parts) AS parts, list(c ORDER BY k) AS below FROM steps GROUP BY source
), keyed AS (
    SELECT d.*, md5(concat_ws('|', '0', d.doc_id::VARCHAR, d.text)) AS key, t.parts, t.below
    FROM documents d JOIN distribution t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
    SELECT *, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(below, lambda b:
        b <= ('0x' || md5(concat_ws('|', key, j::VARCHAR))[1:13])::BIGINT::DOUBLE / 4503599627370496)))) ::INT AS n_copies
    FROM keyed
), exploded AS (
    SELECT *, unnest(range(n_copies))::INT AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5(concat_ws('|', key, 'copy', copy::VARCHAR)) AS place
FROM exploded
"""

URL_FILTER = r"""
WITH rests AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), canon AS (
    SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:/index)?(?:\.html?)?/*$', '') AS canonical FROM parts
), listed AS (
    SELECT DISTINCT canonical FROM canon
    WHERE regexp_extract(host, '(?:^|\.)([^.]+)\.[^.]+\.[^.]+$', 1) IN ('spam-farm', 'cheap-pills', 'casino-win', 'free-bets', 'ads-track', 'adult-x')
), rules(host, path, verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM (
    SELECT c.page_id, c.host, c.path, c.canonical IN (SELECT canonical FROM listed) AS listed,
        (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r
            WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)) AS rule,
        (SELECT max_by(r.verdict, length(r.host || r.path)) FROM rules r
            WHERE (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)) AS verdict
    FROM canon c)
"""

LEXICAL_SEARCH = r"""
WITH asked AS (
    SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
        .list_transform(lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS terms FROM benchmark
), wanted AS (
    SELECT item, item_id, unnest(terms) AS term FROM asked
), texts AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
        .list_transform(lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents
), held AS (
    SELECT row, doc_id, terms, len(terms) AS n FROM texts WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM held
), counts AS (
    SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM held)
    WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term
), scored AS (
    SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item, item_id, row, doc_id
)
SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""

CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\")
_ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROLS)

CHAT_FORMAT = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), stepped AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) = 1 AS ends FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(text) + length(role) + 24 + {_ESCAPES})::BIGINT AS formatted_chars,
    bool_and(CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
        WHEN 'assistant' THEN before IS NOT NULL AND before = 'user' ELSE false END AND (NOT ends OR role <> 'system')) AS valid
FROM stepped GROUP BY conv_id
"""

ORACLE: dict[str, str] = {
    "op3_url_filter": URL_FILTER,
    "op4_mix_sources": MIX_SOURCES,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_chat_format": CHAT_FORMAT,
}
