"""SQL (DuckDB) of the citation graph."""

from quillspark.plans.sql import ENTRIES, META, NOTES, SELF, safe

_NAMES = """
sp AS (SELECT note_id, pos, key, name, 'ref' AS slot FROM g WHERE is_special AND name <> '' UNION ALL SELECT note_id, pos, key, name, 'cb' FROM cg WHERE is_special AND name <> ''),
ordered AS (SELECT sp.*, row_number() OVER (PARTITION BY key, slot ORDER BY path_parts, pos) AS k FROM sp JOIN n USING (note_id)),
names AS (SELECT key, max(CASE WHEN slot = 'ref' THEN name END) AS spec_ref, max(CASE WHEN slot = 'cb' THEN name END) AS spec_cb FROM ordered WHERE k = 1 GROUP BY key)"""

SQL = {
    "graph_edges": f"WITH {ENTRIES} SELECT note_id, pos, key, name, is_special FROM g",
    "self_doi": f"WITH {NOTES}, {META}, {SELF} SELECT note_id, self_doi FROM sd",
    "graph_names": f"WITH {NOTES}, {ENTRIES}, {_NAMES} SELECT * FROM names",
    "graph_resolved_refs": f"""WITH {NOTES}, {ENTRIES}, {_NAMES}
        SELECT note_id, pos, '[[' || coalesce(spec_ref, spec_cb, {safe('doi')}) || '|' || doi || ']]' AS link FROM g LEFT JOIN names USING (key)
        UNION ALL SELECT note_id, pos, raw FROM lists WHERE doi IS NULL""",
    "graph_cited_by": f"""WITH {NOTES}, {META}, {ENTRIES}, {SELF}
        SELECT key, note_id AS citing_id FROM g WHERE key IN (SELECT lower(self_doi) FROM sd)""",
    "graph_polarity": f"""WITH {NOTES}, {META}, {ENTRIES}, {SELF},
        c AS (SELECT sd.note_id, count(g.note_id) AS n FROM sd LEFT JOIN g ON g.key = lower(sd.self_doi) AND g.note_id <> sd.note_id GROUP BY 1),
        s AS (SELECT note_id, count(*) FILTER (WHERE is_special) AS k FROM g GROUP BY 1)
        SELECT sd.note_id, self_doi, n AS n_citing, coalesce(k, 0) AS n_special, CASE WHEN n - coalesce(k, 0) > 0 THEN '正向' ELSE '负向' END AS tag
        FROM sd JOIN c USING (note_id) LEFT JOIN s USING (note_id)""",
    "graph_top_missing": f"""WITH {ENTRIES} SELECT key, count(*) AS n_citing FROM g
        WHERE key NOT IN (SELECT key FROM g WHERE is_special AND name <> '' UNION SELECT key FROM cg WHERE is_special AND name <> '')
        GROUP BY key ORDER BY n_citing DESC, key LIMIT 10""",
    "graph_top_external": f"""WITH {ENTRIES} SELECT key, count(*) AS n_listing FROM cg WHERE key NOT IN (SELECT key FROM g) GROUP BY key ORDER BY n_listing DESC, key LIMIT 10""",
}
