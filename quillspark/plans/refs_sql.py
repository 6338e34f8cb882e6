"""SQL (DuckDB) of the reference lists."""

from quillspark.plans.sql import DOI, META, NOTES, REFS, canonical, first_doi, repaired, safe, strip

_O = r"^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$"
_S = lambda x: f"regexp_replace({x}, '{_O}', '', 'g')"
_ANY = first_doi("translate(raw, '￥', '/')")
_KEY = rf"nullif(rtrim(regexp_extract(translate(lower(raw), '￥', '/'), '10\.\d{{4,9}}/[-a-z0-9._;()/:]+'), '.;:/()'), '')"
_LINK = "regexp_matches(s, '(?s)^\\[\\[.*\\|.*\\]\\]$')"
_NAME = _S("split_part(substr(s, 3, length(s) - 4), '|', 1)")
_DISPLAY = _S("regexp_replace(substr(s, 3, length(s) - 4), '(?s)^[^|]*\\|', '')")
_ITEMS = f"""{META}, items AS (SELECT note_id, i, x, {_S(strip('x'))} AS s, {strip('x')} AS t FROM
    (SELECT note_id, unnest(reference) AS x, unnest(range(1, len(reference) + 1)) AS i FROM m)),
parsed AS (SELECT *, {_LINK} AND {_DISPLAY} <> '' AS is_link, {_NAME} AS name, {_DISPLAY} AS display FROM items)"""
_OWN = f"own AS (SELECT note_id, {canonical(first_doi('doi'))} AS own FROM m)"
_CHAIN = f"""links AS (SELECT DISTINCT note_id, {_KEY} AS doi FROM r WHERE field = 'reference' AND {_KEY} IS NOT NULL),
chain AS (SELECT l.doi, l.note_id AS citing, o.own AS citing_doi, CAST(n.created_at AS DATE) AS day, n.path FROM links l JOIN n USING (note_id) JOIN own o USING (note_id))"""
_TEXT = "lower(regexp_replace(" + strip(r"regexp_replace(raw, '(?i)[\s,.;(]*(?:doi:?\s*)?10\.\d{4,9}/.*$', '')") + r""", '[\s.,;“”"]+$|^[\s“”"]+', '', 'g'))"""
_CITATIONS = f"""c AS (SELECT note_id, pos, {_KEY} AS own, CASE WHEN NOT contains(raw, '[[') AND length({_TEXT}) > 20 THEN {_TEXT} END AS text FROM r WHERE field = 'reference'),
lk AS (SELECT text, min(own) AS doi FROM c WHERE text IS NOT NULL AND own IS NOT NULL GROUP BY 1)"""
_W = "w AS (SELECT lower(doi) AS key, max(issued_year) AS issued_year, max(cited_count) AS cited_count FROM works WHERE doi IS NOT NULL GROUP BY 1)"
_RAW = "r AS (SELECT DISTINCT ON (ref_id) * FROM refs)"

SQL = {
    "dedupe_refs": f"""WITH {_ITEMS}, k AS (SELECT note_id, i, CASE WHEN is_link THEN lower(display) ELSE t END AS key, CASE WHEN is_link THEN '[[' || replace(name, '/', '￥') || '|' || display || ']]' ELSE t END AS txt FROM parsed),
        f AS (SELECT note_id, key, min(i) AS i, arg_min(txt, i) AS txt FROM k GROUP BY 1, 2)
        SELECT m.note_id, coalesce(string_agg(txt, chr(10) ORDER BY i), '') AS refs, count(txt) AS n FROM m LEFT JOIN f USING (note_id) WHERE m.reference IS NOT NULL GROUP BY 1""",
    "pin_main": f"""WITH {_ITEMS}, d AS (SELECT note_id, {canonical(first_doi('doi'))} AS doi, {first_doi('doi')} IS NOT NULL AS has FROM m WHERE reference IS NOT NULL),
        k AS (SELECT d.note_id, p.i, p.x FROM d JOIN parsed p USING (note_id) WHERE NOT d.has OR NOT regexp_matches(p.s, '(?s)^\\[\\[.*\\|.*\\]\\]$') OR lower(p.display) <> lower(d.doi)
              UNION ALL SELECT note_id, 0, '[[' || replace(rtrim(doi, '.,;:'), '/', '￥') || '|' || rtrim(doi, '.,;:') || ']]' FROM d WHERE has)
        SELECT d.note_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS refs FROM d LEFT JOIN k USING (note_id) GROUP BY 1""",
    "number_refs": f"""WITH {_ITEMS} SELECT m.note_id, '## 参考文献' || chr(10) || chr(10) || coalesce(string_agg('[' || i || '] ' || x, chr(10) ORDER BY i) FILTER (WHERE x <> ''), '') AS section
        FROM m LEFT JOIN items USING (note_id) WHERE len(reference) > 0 GROUP BY 1""",
    "merge_dois": f"""WITH {_RAW}, d AS (SELECT note_id, field, pos, {_ANY} AS doi FROM r)
        SELECT note_id, lower(doi) AS key, min(pos) AS first_pos, arg_max(doi, (CASE WHEN field = 'reference' THEN 0 ELSE 1 END) * 1000000 + pos) AS last_spelling, count(DISTINCT field) AS n_lists, count(*) AS n_entries
        FROM d WHERE doi IS NOT NULL GROUP BY 1, 2""",
    "existing_dois": f"""WITH {NOTES}, {META}, {_RAW}, d AS (SELECT note_id, lower({first_doi('doi')}) AS doi FROM m UNION ALL SELECT note_id, lower({_ANY}) FROM r)
        SELECT path_parts[1] AS folder, count(DISTINCT doi) AS n_dois, count(*) AS n_mentions FROM d JOIN n USING (note_id) WHERE doi IS NOT NULL GROUP BY 1""",
    "wikilinks": f"""WITH {REFS}, raw0 AS (SELECT DISTINCT ON (ref_id) ref_id, raw AS raw0 FROM refs), a AS (SELECT ref_id, s, {_LINK} AS ok, {first_doi("translate(raw0, '￥', '/')")} AS d FROM r JOIN raw0 USING (ref_id)),
        b AS (SELECT *, rtrim(d, '.,;:') AS p, {canonical('d')} AS c FROM a)
        SELECT ref_id, CASE WHEN ok THEN {_NAME} END AS name, CASE WHEN ok THEN {_DISPLAY} END AS display, '[[' || replace(p, '/', '￥') || '|' || p || ']]' AS plain,
               '[[' || replace(rtrim(c, '.,;:'), '/', '￥') || '|' || rtrim(c, '.,;:') || ']]' AS canonical, '[[' || {safe('c')} || '|' || c || ']]' AS with_safe_name FROM b""",
    "freshness_age": f"""WITH {META}, {_W} SELECT note_id, coalesce(date_diff('day', cited_by_date, DATE '2024-06-30') < 30, false) AS fresh, coalesce(2024 - issued_year <= 15, true) AS young
        FROM m LEFT JOIN w ON w.key = lower({first_doi('doi')})""",
    "enrich_refs": f"WITH {_RAW}, {_W}, k AS (SELECT ref_id, {_KEY} AS doi FROM r WHERE field = 'reference') SELECT ref_id, doi, issued_year, cited_count FROM k LEFT JOIN w ON w.key = k.doi",
    "lookup_misses": f"WITH {_RAW}, {_W}, k AS (SELECT {_KEY} AS doi FROM r WHERE field = 'reference') SELECT doi, count(*) AS n FROM k WHERE doi IS NOT NULL AND doi NOT IN (SELECT key FROM w) GROUP BY 1",
    "citedby_topn": f"""WITH {NOTES}, {META}, {_RAW}, {_OWN}, {_CHAIN},
        listed AS (SELECT DISTINCT lower(own) AS doi, {_KEY} AS key FROM r JOIN own USING (note_id) WHERE field = 'cited_by' AND own IS NOT NULL),
        fresh AS (SELECT chain.* FROM chain LEFT JOIN listed l ON l.doi = chain.doi AND l.key = lower(citing_doi) WHERE l.doi IS NULL AND citing_doi IS NOT NULL AND day > DATE '2024-06-30' - 1825),
        o AS (SELECT doi, CAST(row_number() OVER (PARTITION BY doi ORDER BY day DESC, citing) AS INT) AS place, citing_doi FROM fresh),
        k AS (SELECT doi, count(*) AS n_citing FROM links GROUP BY 1)
        SELECT * FROM o JOIN k USING (doi) WHERE place <= 10""",
    "citedby_claims": f"""WITH RECURSIVE {NOTES}, {META}, {_RAW}, {_OWN}, {_CHAIN},
        cand AS (SELECT n.path_parts[1] AS folder, n.path AS ord, n.note_id, lower(c.citing_doi) AS d, max(c.day) AS day FROM own JOIN n USING (note_id) JOIN chain c ON c.doi = lower(own.own) WHERE c.citing_doi IS NOT NULL GROUP BY ALL),
        o AS (SELECT folder, note_id, row_number() OVER (PARTITION BY folder ORDER BY ord, note_id) AS k, list(d ORDER BY day DESC, d) AS l FROM cand GROUP BY folder, ord, note_id),
        -- the notes of a folder one after the other, each without what those before it have taken
        rec AS (SELECT folder, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS note_id, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS got FROM o GROUP BY 1
            UNION ALL SELECT rec.folder, o.k, o.note_id, list_concat(rec.taken, list_filter(o.l, lambda x: NOT list_contains(rec.taken, x))[1:10]), list_filter(o.l, lambda x: NOT list_contains(rec.taken, x))[1:10]
            FROM rec JOIN o ON o.folder = rec.folder AND o.k = rec.k + 1)
        SELECT folder, note_id, CAST(unnest(range(1, len(got) + 1)) AS INT) AS place, unnest(got) AS doi FROM rec""",
    "work_references": f"""WITH {_RAW}, {_CITATIONS} SELECT note_id, pos, coalesce(own, doi) AS doi, CASE WHEN own IS NOT NULL THEN 'own' ELSE 'text' END AS found_by FROM c LEFT JOIN lk USING (text) WHERE coalesce(own, doi) IS NOT NULL""",
    "appended_refs": f"""WITH {NOTES}, {_RAW}, {_CITATIONS}, w AS (SELECT note_id, pos, coalesce(own, doi) AS doi FROM c LEFT JOIN lk USING (text) WHERE coalesce(own, doi) IS NOT NULL),
        x AS (SELECT w.note_id, w.pos, w.doi, {strip('r.raw')} AS raw, row_number() OVER (PARTITION BY w.note_id ORDER BY w.pos) AS i FROM w JOIN r ON r.note_id = w.note_id AND r.pos = w.pos AND r.field = 'reference')
        SELECT note_id, chr(10) || chr(10) || '## 参考文献' || chr(10) || string_agg(i || '. ' || x.raw || ' DOI: ' || doi, chr(10) ORDER BY i) AS section FROM x JOIN n USING (note_id) WHERE NOT contains(coalesce(n.body, ''), '## 参考文献') GROUP BY 1""",
    "citation_misses": f"WITH {_RAW}, {_CITATIONS} SELECT text, count(*) AS n FROM c WHERE own IS NULL AND text IS NOT NULL AND text NOT IN (SELECT text FROM lk) GROUP BY 1",
    "title_verified": f"""WITH {META}, {_OWN}, g AS (SELECT lower(title) AS key, min(lower(own)) AS doi FROM m JOIN own USING (note_id) WHERE title IS NOT NULL AND own IS NOT NULL GROUP BY 1)
        SELECT doc_id, m.note_id, g.doi FROM m JOIN documents d ON d.note_id = m.note_id JOIN g ON g.key = lower(m.title) WHERE d.text IS NOT NULL""",
    "pin_alike": f"""WITH {META}, {_OWN}, k AS (SELECT m.note_id, own, unnest(reference) AS x, unnest(range(1, len(reference) + 1)) AS i FROM m JOIN own USING (note_id)),
        kept AS (SELECT note_id, i, x FROM k WHERE own IS NULL OR NOT contains(lower(coalesce(x, '')), lower(own)) UNION ALL SELECT m.note_id, 0, '[[' || {safe('own')} || '|' || own || ']]' FROM m JOIN own USING (note_id) WHERE own IS NOT NULL)
        SELECT m.note_id, coalesce(string_agg(x, chr(10) ORDER BY i), '') AS refs FROM m LEFT JOIN kept USING (note_id) WHERE reference IS NOT NULL GROUP BY 1""",
    "local_refs": f"""WITH t AS (SELECT doc_id, text, position('# 参考文献' IN lower(text)) AS z, position('# reference' IN lower(text)) AS e FROM documents),
        s AS (SELECT doc_id, CASE WHEN z > 0 THEN substr(text, z) WHEN e > 0 THEN substr(text, e) END AS body FROM t),
        x AS (SELECT doc_id, regexp_extract_all(body, '(?m)^\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+(.*)$', 1) AS l FROM s WHERE body IS NOT NULL),
        y AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS number, rtrim(unnest(l), '. ' || chr(9)) AS entry FROM x),
        {repaired('y', 'doc_id, number, entry', 'entry')}
        SELECT doc_id, CAST(number AS INT) AS number, entry, nullif(regexp_extract(t, '(?i){DOI}'), '') AS doi FROM fixed""",
}
