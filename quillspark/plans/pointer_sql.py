"""SQL (DuckDB) of the pointer queries."""

_PAGE = r"""regexp_replace(trim(regexp_replace(trim(regexp_extract(link, '\[\[([^|#\]]*)', 1)), '^.*/', '')), '\.md$', '')"""
_DASH = lambda x: f"regexp_replace({x}, '[\\x{{ad}}‐-―⁃−﹘﹣－]', '-', 'g')"
_DOI = r"""rtrim(regexp_extract(translate(lower(raw), '￥', '/'), '10\.\d{4,9}/[-a-z0-9._;()/:]+'), '.;:/()')"""

_POINTERS = rf"""
n AS (SELECT DISTINCT note_id, {_DASH('stem')} AS stem, created_at, mtime, trashed_at FROM notes),
links AS (
  SELECT DISTINCT note_id, 'paper-translate' AS field, "paper-translate" AS link FROM frontmatter
  UNION ALL SELECT DISTINCT note_id, 'paper-analyze', "paper-analyze" FROM frontmatter),
by_note AS (
  SELECT l.note_id, l.field, 0 AS pos, m.mtime,
         NOT EXISTS (SELECT 1 FROM n t WHERE t.stem = {_DASH(_PAGE)} AND t.trashed_at IS NULL AND t.created_at <= m.mtime) AS orphan
  FROM links l JOIN n m USING (note_id) WHERE contains(link, '[[')),
w AS (SELECT lower(doi) AS doi, min(first_seen) AS first_seen FROM works WHERE deleted_at IS NULL GROUP BY 1),
entries AS (SELECT DISTINCT note_id, field, pos, {_DOI} AS doi FROM refs WHERE field = 'reference'),
by_work AS (
  SELECT e.note_id, e.field, e.pos, m.mtime, (w.doi IS NULL OR w.first_seen > m.mtime) AS orphan
  FROM entries e JOIN n m USING (note_id) LEFT JOIN w USING (doi) WHERE e.doi <> ''),
pointers AS (SELECT * FROM by_note UNION ALL SELECT * FROM by_work)
"""

SQL = {
    "p1_found": f"WITH {_POINTERS} SELECT note_id, field, pos FROM pointers WHERE orphan",
    "p1_report": f"""WITH {_POINTERS}
        SELECT CASE WHEN field = 'reference' THEN 'works' ELSE 'notes' END AS target, strftime(mtime, '%Y-%m') AS month,
               count(*) AS n_pointers, CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans
        FROM pointers GROUP BY 1, 2""",
}
