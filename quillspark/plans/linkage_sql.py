"""SQL (DuckDB) of the record linkage."""

from quillspark.plans.sql import DOI, META, NOTES, strip

_O = r"^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$"
_S = lambda x: f"regexp_replace({x}, '{_O}', '', 'g')"
_ROWS = f"""{NOTES}, {META},
b AS (SELECT n.note_id, n.path_parts, n.stem, n.path_parts[1] AS top, m.source, m.reference, m."paper-translate" AS pt,
        m."paper-analyze" AS pa, m."figure-extractor" AS fe, nullif(rtrim(lower({strip('m.source')}), '/'), '') AS by_source, {_S('m.reference[1]')} AS f FROM n JOIN m USING (note_id)),
rows AS (SELECT *, CASE WHEN regexp_matches(f, '(?s)^\\[\\[.*\\|.*\\]\\]$') THEN nullif({_S("split_part(substr(f, 3, length(f) - 4), '|', 1)")}, '') END AS by_first FROM b),
clips AS (SELECT * FROM rows WHERE top = 'Clippings' AND NOT contains(stem, 'zh-CN')), chi AS (SELECT * FROM rows WHERE top = 'Chi'),
s1 AS (SELECT by_source AS k, arg_max(note_id, path_parts) AS target_id FROM chi WHERE by_source IS NOT NULL GROUP BY 1),
s2 AS (SELECT by_first AS k, arg_max(note_id, path_parts) AS target_id FROM chi WHERE by_first IS NOT NULL GROUP BY 1),
x AS (SELECT note_id, replace(unnest(reference), chr(10), ' ') AS x FROM rows),
y AS (SELECT note_id, coalesce(nullif(regexp_extract(x, '\\[\\[([^|]+)\\|([^\\]]+)\\]\\]', 2), ''), x) AS s FROM x),
d AS (SELECT DISTINCT note_id, unnest(regexp_extract_all(s, '(?i){DOI}')) AS doi FROM y),
dd AS (SELECT * FROM d WHERE doi IS NOT NULL), sz AS (SELECT note_id, count(*) AS n FROM dd GROUP BY 1),
sc AS (SELECT a.note_id AS l, c.note_id AS r, round(count(*) / (sa.n + sb.n - count(*)), 6) AS score, count(*) AS i, sa.n + sb.n - count(*) AS u
       FROM dd a JOIN clips ca ON ca.note_id = a.note_id JOIN dd c ON c.doi = a.doi JOIN chi cb ON cb.note_id = c.note_id
       JOIN sz sa ON sa.note_id = a.note_id JOIN sz sb ON sb.note_id = c.note_id GROUP BY a.note_id, c.note_id, sa.n, sb.n)"""
_BEST = "best AS (SELECT note_id, target_id, score FROM (SELECT l AS note_id, r AS target_id, score, row_number() OVER (PARTITION BY l ORDER BY score DESC, path_parts) AS k FROM sc JOIN rows ON rows.note_id = sc.r WHERE i * 100 >= 85 * u) WHERE k = 1)"
_CASCADE = f"""{_BEST},
found AS (SELECT c.note_id, c.pt, coalesce(s1.target_id, s2.target_id, best.target_id) AS target_id,
    CASE WHEN s1.target_id IS NOT NULL THEN 'source' WHEN s2.target_id IS NOT NULL THEN 'first reference' WHEN best.target_id IS NOT NULL THEN 'similarity' ELSE 'none' END AS method
  FROM clips c LEFT JOIN s1 ON s1.k = c.by_source LEFT JOIN s2 ON s2.k = c.by_first LEFT JOIN best ON best.note_id = c.note_id)"""

SQL = {
    "match_source": f"WITH {_ROWS} SELECT note_id, target_id FROM clips JOIN s1 ON s1.k = by_source",
    "match_first_ref": f"WITH {_ROWS} SELECT note_id, target_id FROM clips JOIN s2 ON s2.k = by_first",
    "match_jaccard": f"WITH {_ROWS}, {_BEST} SELECT * FROM best",
    "match_cascade": f"""WITH {_ROWS}, {_CASCADE} SELECT CASE WHEN coalesce(pt, '') <> '' THEN 'skipped' WHEN target_id IS NOT NULL THEN 'matched' ELSE 'failed' END AS status, method, count(*) AS n
        FROM found GROUP BY 1, 2""",
    "match_status": f"""WITH {_ROWS}, {_CASCADE},
        a AS (SELECT stem AS k, arg_max(note_id, path_parts) AS id FROM rows WHERE top = 'Claude' AND NOT suffix(stem, '_figures') GROUP BY 1),
        fg AS (SELECT regexp_replace(stem, '_figures$', '') AS k, arg_max(note_id, path_parts) AS id FROM rows WHERE top = 'Claude' AND suffix(stem, '_figures') GROUP BY 1),
        ks AS (SELECT 'translation' AS kind, pt AS link, target_id, method FROM found
            UNION ALL SELECT 'analysis', pa, a.id, CASE WHEN a.id IS NULL THEN 'none' ELSE 'stem' END FROM clips LEFT JOIN a ON a.k = replace(stem, ' ', '_')
            UNION ALL SELECT 'figures', fe, fg.id, CASE WHEN fg.id IS NULL THEN 'none' ELSE 'stem' END FROM clips LEFT JOIN fg ON fg.k = replace(stem, ' ', '_')),
        ff(force) AS (VALUES (false), (true)),
        st AS (SELECT kind, force, link, method, n.stem FROM ks CROSS JOIN ff LEFT JOIN n ON n.note_id = ks.target_id)
        SELECT kind, force, CASE WHEN coalesce(link, '') <> '' AND (NOT force OR stem IS NULL OR trim(regexp_extract(link, '\\[\\[\\s*([^|\\]]+)', 1)) = stem) THEN 'skipped'
            WHEN stem IS NULL THEN 'failed' ELSE 'matched' END AS status, method, count(*) AS n FROM st GROUP BY ALL""",
    "match_near_miss": f"""WITH {_ROWS}, {_CASCADE} SELECT note_id, place, target_id, score FROM (
        SELECT l AS note_id, r AS target_id, score, CAST(row_number() OVER (PARTITION BY l ORDER BY score DESC, path_parts, r) AS INT) AS place
        FROM sc JOIN rows ON rows.note_id = sc.r WHERE i * 100 >= 50 * u AND l IN (SELECT note_id FROM found WHERE method = 'none')) WHERE place <= 3""",
    "match_stem": f"""WITH {NOTES}, t AS (SELECT note_id, path_parts, stem, path_parts[1] AS top FROM n),
        a AS (SELECT stem AS k, arg_max(note_id, path_parts) AS id FROM t WHERE top = 'Claude' AND NOT suffix(stem, '_figures') GROUP BY 1),
        f AS (SELECT regexp_replace(stem, '_figures$', '') AS k, arg_max(note_id, path_parts) AS id FROM t WHERE top = 'Claude' AND suffix(stem, '_figures') GROUP BY 1)
        SELECT t.note_id, a.id AS analysis_id, f.id AS figures_id FROM t LEFT JOIN a ON a.k = replace(t.stem, ' ', '_') LEFT JOIN f ON f.k = replace(t.stem, ' ', '_')
        WHERE top = 'Clippings' AND NOT contains(stem, 'zh-CN') AND (a.id IS NOT NULL OR f.id IS NOT NULL)""",
}
