"""DuckDB SQL for the pN_ queries that SQL can express on whole tables."""

ORACLES = {
    "p3_found": """
        SELECT DISTINCT 'cleaned_pages' AS tbl, id FROM cleaned_pages WHERE length(content) > 1000
        UNION ALL
        SELECT DISTINCT 'chunks' AS tbl, id FROM chunks WHERE length(content) > 1000
    """,
    "p7_found": r"""
        WITH recs AS (
            SELECT DISTINCT id, content,
                   regexp_replace(regexp_extract(lower(url), '^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)', 1), '^www\.', '') AS site
            FROM pages),
        ls AS (
            SELECT id, site, unnest(string_split(content, chr(10))) AS l,
                   unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
            FROM recs WHERE content IS NOT NULL),
        norm AS (
            SELECT id, site, line_no::INT AS line_no,
                   trim(regexp_replace(lower(l), '[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}]+', ' ', 'g')) AS n
            FROM ls),
        tot AS (SELECT site, count(DISTINCT id) AS t FROM recs GROUP BY site),
        hot AS (
            SELECT site, n FROM norm JOIN tot USING (site) WHERE n <> ''
            GROUP BY site, n HAVING count(DISTINCT id) >= 5 AND count(DISTINCT id) * 10 >= max(t))
        SELECT DISTINCT id, line_no FROM norm JOIN hot USING (site, n)
    """,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": r"""
        WITH w AS (
            SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
        i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
        ig AS (
            SELECT item_id, least(12, len(ws)) AS k,
                   unnest([array_to_string(ws[p:p + least(12, len(ws)) - 1], ' ') FOR p IN range(1, len(ws) - least(12, len(ws)) + 2)]) AS g
            FROM i WHERE len(ws) > 0),
        ks AS (SELECT DISTINCT k FROM ig),
        dg AS (
            SELECT doc_id, k, unnest([array_to_string(ws[p:p + k - 1], ' ') FOR p IN range(1, len(ws) - k + 2)]) AS g
            FROM w, ks WHERE len(ws) >= k)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, g)
    """,
    "p5_found": r"""
        WITH d AS (SELECT DISTINCT id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM cleaned_pages WHERE content IS NOT NULL),
        s AS (SELECT DISTINCT id, unnest([array_to_string(ws[p:p + 2], ' ') FOR p IN range(1, len(ws) - 1)]) AS g FROM d WHERE len(ws) >= 3),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM b JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE c >= 0.6 * (na.n + nb.n - c)
    """,
    "p9_items": r"""
        WITH w AS (
            SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
        i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
        ig AS (
            SELECT item_id, least(12, len(ws)) AS k,
                   unnest([array_to_string(ws[p:p + least(12, len(ws)) - 1], ' ') FOR p IN range(1, len(ws) - least(12, len(ws)) + 2)]) AS g
            FROM i WHERE len(ws) > 0),
        ks AS (SELECT DISTINCT k FROM ig),
        dg AS (
            SELECT doc_id, k, unnest([array_to_string(ws[p:p + k - 1], ' ') FOR p IN range(1, len(ws) - k + 2)]) AS g
            FROM w, ks WHERE len(ws) >= k),
        f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, g))
        SELECT item_id, count(doc_id) AS n_docs FROM (SELECT DISTINCT item_id FROM eval_items WHERE item_id IS NOT NULL) e LEFT JOIN f USING (item_id) GROUP BY item_id
    """,
}
