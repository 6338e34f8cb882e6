"""SQL (DuckDB) of the vault plans."""

from quillspark.plans.sql import META, NOTES

_IMAGES = r"""i AS (SELECT DISTINCT doc_id, regexp_replace(l, '^.*/', '') AS name FROM (SELECT doc_id, replace(unnest(regexp_extract_all(text, '!\[[^\]]*\]\(([^)]+)\)', 1)), '\', '/') AS l FROM documents)
    WHERE NOT regexp_matches(l, '^https?://') AND (contains(l, 'Vault/IMAGE') OR contains(l, '/images/') OR starts_with(l, 'images/')))"""
_O = r"^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$"
_S = lambda x: f"regexp_replace({x}, '{_O}', '', 'g')"


def _page(c: str) -> str:
    inner = _S(rf"regexp_extract({c}, '\[\[([^|#\]]*)', 1)")
    leaf = _S(f"regexp_replace({inner}, '^.*/', '')")
    return f"CASE WHEN contains({c}, '[[') THEN {_S(f'regexp_replace({leaf}, {chr(39)}\\.md${chr(39)}, {chr(39)}{chr(39)})')} END"


_LINKS = f"""l AS (SELECT note_id, 'paper-translate' AS field, "paper-translate" AS v FROM m UNION ALL SELECT note_id, 'paper-analyze', "paper-analyze" FROM m UNION ALL SELECT note_id, 'figure-extractor', "figure-extractor" FROM m),
p AS (SELECT note_id, field, {_page('v')} AS page FROM l),
ex AS (SELECT stem AS page, arg_min(note_id, path_parts) AS exact_id FROM n GROUP BY 1),
lo AS (SELECT translate(stem, '–—', '--') AS loose, arg_min(note_id, path_parts) AS loose_id FROM n GROUP BY 1),
links AS (SELECT p.note_id, field, p.page, coalesce(exact_id, loose_id) AS target_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN loose_id IS NOT NULL THEN 'dashes' ELSE 'none' END AS how
  FROM p LEFT JOIN ex USING (page) LEFT JOIN lo ON lo.loose = translate(p.page, '–—', '--') WHERE p.page IS NOT NULL)"""
_NAME = """substr_name AS (SELECT note_id, trim(regexp_replace(translate(replace(translate(title, '“”‘’–—', '""' || chr(39) || chr(39) || '--'), '…', '...'), '<>:"/\\|?*', ''), '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{3000}\\x{85}]+', ' ', 'g'), ' ') AS s FROM m WHERE title IS NOT NULL)"""

SQL = {
    "image_gc": f"WITH {_IMAGES} SELECT 'doc-' || doc_id || '.jpg' AS name, 'TRASH/doc-' || doc_id || '.jpg' AS \"to\" FROM documents WHERE text IS NOT NULL AND 'doc-' || doc_id || '.jpg' NOT IN (SELECT name FROM i)",
    "image_use": f"WITH {_IMAGES} SELECT name, count(DISTINCT doc_id) AS n_documents FROM i GROUP BY 1",
    "note_links": f"WITH {NOTES}, {META}, {_LINKS} SELECT * FROM links",
    "archive_plan": f"""WITH {NOTES}, {META}, {_LINKS}, a AS (SELECT note_id, 'note' AS item, note_id AS target_id FROM n WHERE path_parts[1] = 'Clippings'
            UNION ALL SELECT note_id, field, target_id FROM links WHERE note_id IN (SELECT note_id FROM n WHERE path_parts[1] = 'Clippings'))
        SELECT a.note_id, item, CASE WHEN t.path IS NULL THEN 'not found' WHEN t.trashed_at IS NOT NULL THEN 'in trash' WHEN t.mtime < TIMESTAMP '2022-01-01' THEN 'exists' ELSE 'copied' END AS status,
               CASE WHEN t.path IS NOT NULL AND t.trashed_at IS NULL THEN 'Archive/' || t.path END AS path FROM a LEFT JOIN n t ON t.note_id = a.target_id""",
    "trash_plan": f"WITH {NOTES} SELECT path_parts[1] AS folder, count(*) AS n_notes, 'trash/20240630/' || path_parts[1] AS \"to\" FROM n WHERE len(path_parts) > 1 AND path_parts[1] NOT IN ('.obsidian', 'TRASH', 'trash') GROUP BY path_parts[1]",
    "done_filter": f"""WITH {NOTES} SELECT array_to_string(path_parts[1:len(path_parts) - 1], '/') AS dir, stem || '.pdf' AS name, CASE WHEN trashed_at IS NOT NULL THEN 'trash' ELSE 'process' END AS action FROM n WHERE NOT contains(stem, '完成')""",
    "batches": f"""WITH {NOTES}, s AS (SELECT path, (row_number() OVER (ORDER BY path, note_id) - 1) // 45 AS batch, CASE WHEN trashed_at IS NOT NULL THEN 'failed' WHEN body IS NULL THEN 'waiting' ELSE 'done' END AS state FROM n)
        SELECT batch, count(*) AS n, count(*) FILTER (WHERE state = 'done') AS n_done, count(*) FILTER (WHERE state = 'failed') AS n_failed, min(path) AS first_path, count(*) FILTER (WHERE state IN ('done', 'failed')) >= count(*) AS over
        FROM s GROUP BY 1""",
    "rename_plan": f"""WITH {NOTES}, {META}, {_NAME}, c AS (SELECT note_id, CASE WHEN length(s) <= 250 THEN s WHEN length(regexp_extract(substr(s, 1, 251), '^(.*) [^ ]*$', 1)) > 100 THEN regexp_extract(substr(s, 1, 251), '^(.*) [^ ]*$', 1) ELSE substr(s, 1, 250) END AS name FROM substr_name),
        q AS (SELECT note_id, path_parts[1] AS dir, name, row_number() OVER (PARTITION BY path_parts[1], name ORDER BY path, note_id) - 1 AS place FROM c JOIN n USING (note_id) WHERE name <> ''),
        tk AS (SELECT DISTINCT dir, regexp_extract(name, '^(.*) \\((\\d{{1,9}})\\)$', 1) AS name, CAST(regexp_extract(name, '^(.*) \\((\\d{{1,9}})\\)$', 2) AS BIGINT) AS t FROM q WHERE regexp_matches(name, '^(.*) \\((\\d{{1,9}})\\)$')),
        tl AS (SELECT dir, name, list_sort(list(t)) AS l FROM tk WHERE t > 0 GROUP BY 1, 2),
        k AS (SELECT note_id, q.dir, q.name, CASE WHEN place = 0 OR l IS NULL THEN place ELSE list_filter(range(1, place + len(l) + 1), lambda z: NOT list_contains(l, z))[place] END AS k FROM q LEFT JOIN tl USING (dir, name))
        SELECT note_id, dir, CASE WHEN k = 0 THEN name || '.pdf' ELSE name || ' (' || k || ').pdf' END AS new_name FROM k""",
    "path_resolve": f"""WITH {NOTES}, {META}, a AS (SELECT note_id, {_page('"paper-analyze"')} AS page FROM m), b AS (SELECT note_id, page || CASE WHEN note_id % 3 = 0 THEN '...' WHEN note_id % 3 = 1 THEN '.md' ELSE '' END AS page FROM a WHERE page IS NOT NULL AND page <> ''),
        t AS (SELECT note_id, 0 AS priority, page AS stem FROM b UNION ALL SELECT note_id, 1, regexp_replace(page, '\\.md$', '') FROM b UNION ALL SELECT note_id, 2, rtrim(page, '.') FROM b),
        j AS (SELECT t.note_id, priority, n.note_id AS found_id FROM t JOIN n USING (stem))
        SELECT note_id, arg_min(found_id, priority) AS found_id, min(priority) AS priority FROM j GROUP BY 1""",
    "archive_images": f"""WITH {NOTES}, b AS (SELECT note_id, md5(stem) || '.jpg' AS name FROM n WHERE body IS NOT NULL)
        SELECT note_id, name, CASE WHEN note_id % 5 = 0 THEN 'there' WHEN note_id % 2 = 0 THEN 'vault' WHEN note_id % 3 = 0 THEN 'common' END AS source FROM b""",
    "archive_bodies": f"""WITH {NOTES} SELECT note_id, CAST(1 AS BIGINT) AS n_changed, md5(body || chr(10) || '![fig](/archive/images/' || md5(stem) || '.jpg)' || chr(10)) AS digest FROM n WHERE body IS NOT NULL""",
    "archive_figures": f"""WITH {NOTES}, {META}, p AS (SELECT note_id, {_page('"paper-analyze"')} AS page FROM m)
        SELECT p.note_id, f.note_id AS figures_id FROM p JOIN n USING (note_id) JOIN n f ON translate(f.stem, '–—', '--') = translate(p.page, '–—', '--') || '_figures'
        WHERE n.path_parts[1] = 'Clippings' AND f.path_parts[1] = 'Claude' AND p.page <> ''""",
    "note_roots": f"""WITH {NOTES}, p AS (SELECT note_id, path_parts[1:len(path_parts) - 1] AS l FROM n WHERE len(path_parts) > 1), q AS (SELECT note_id, l, list_max(list_filter(range(1, len(l) + 1), lambda i: l[i] = 'Clippings')) AS d FROM p)
        SELECT note_id, CASE WHEN d IS NOT NULL THEN array_to_string(l[1:d], '/') END AS clippings, CASE WHEN d IS NOT NULL THEN array_to_string(l[1:d - 1], '/') END AS vault FROM q""",
    "uri_resolve": f"""WITH {NOTES}, f AS (SELECT regexp_replace(path, '\\.md$', '') AS key, arg_max(note_id, (mtime, note_id)) AS found_id FROM n WHERE len(path_parts) > 1 GROUP BY 1)
        SELECT note_id, path_parts[1] AS vault, CASE WHEN note_id % 2 = 0 THEN array_to_string(path_parts[2:], '/') ELSE regexp_replace(array_to_string(path_parts[2:], '/'), '\\.md$', '') END AS file, found_id
        FROM n JOIN f ON f.key = regexp_replace(array_to_string(path_parts, '/'), '\\.md$', '') WHERE len(path_parts) > 1""",
    "newest_notes": f"WITH {NOTES} SELECT path_parts[1] AS folder, arg_max(note_id, mtime) AS note_id, max(mtime) AS mtime FROM n GROUP BY 1",
}
