"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP3 = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM f"""

OP4 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
              UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     t AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS final FROM rows
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       cast(sum(length('### ' || role || ':' || chr(10)) + length('</turn>' || chr(10))
                + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars,
       bool_and(before || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')
                AND (NOT final OR role = 'assistant')) AS valid
FROM t GROUP BY conv_id"""

OP9 = r"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
     items AS (SELECT coalesce(cast(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
     ip AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p
            FROM items WHERE len(ws) > 0),
     ig AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM ip),
     dp AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM low, (SELECT DISTINCT n FROM ig) WHERE len(ws) >= n),
     dg AS (SELECT rid, n, p, array_to_string(ws[p:p + n - 1], ' ') AS gram FROM dp),
     hits AS (SELECT rid, n, p, item FROM dg JOIN ig USING (n, gram)),
     words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
     found AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)"""

# the limits are those of quality.LineLimits
OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '-') AS host FROM documents),
     w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
     wp AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS p FROM w),
     wg AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, array_to_string(ws[p:p + 7], ' ')) AS c FROM wp),
     rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM wg WHERE c > 1) GROUP BY rid),
     raw AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
     dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
     ln AS (SELECT rid, host, pos, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw),
     same AS (SELECT rid, md5(string_agg(line, chr(10) ORDER BY pos)) AS doc FROM ln WHERE line <> '' GROUP BY rid),
     l AS (SELECT rid, host, line, doc FROM ln JOIN same USING (rid) WHERE line <> ''),
     hosts AS (SELECT host, count(DISTINCT doc) AS docs FROM l GROUP BY host),
     freq AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc) AS n FROM l GROUP BY host, line) JOIN hosts USING (host)
              WHERE n > 10 AND n > least(docs * 0.02::DOUBLE, 100)),
     gone AS (SELECT rid, cast(sum(len(string_split(line, ' '))) AS BIGINT) AS n FROM l JOIN freq USING (host, line) GROUP BY rid),
     m AS (SELECT doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
           FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (n_words - n_removed_words < 20 OR n_words - n_removed_words < n_words * 0.3::DOUBLE) AS kept
FROM b"""

ORACLES: dict[str, str] = {
    "op3_warc": OP3,
    "op4_chat": OP4,
    "op9_decontamination": OP9,
    "op10_quality_rules": OP10,
}
