"""SQL (DuckDB) of the text operators."""

from quillspark.functions.markdown import NO_TITLE as _NO_TITLE
from quillspark.functions.markdown import SECTION_HEADING as _SECTION
from quillspark.functions.markdown import SENTENCE_END as _END
from quillspark.functions.title import AUTHOR_WITH_DEGREE, DOI_IN_TITLE, ILLEGAL_IN_NAMES, JUNK_TITLES, MANUSCRIPT_ID, SOURCE_FILE, STATUS_MARKERS
from quillspark.plans.sql import DOI, INVISIBLE, META, NOTES, canonical, first_doi, plausible, repaired, safe

_DOCS = "d AS (SELECT * FROM documents WHERE text IS NOT NULL)"
_BLOCKS = "c AS (SELECT DISTINCT ON (block_id) * FROM content_list_v2 WHERE content IS NOT NULL)"
_WORKS = "w AS (SELECT DISTINCT doi FROM works WHERE doi IS NOT NULL)"
_H1 = "regexp_extract_all(text, '(?m)^#[ \\t]+(.+)$', 1)"
_TITLE = f"coalesce(list_filter(list_transform({_H1}, lambda x: trim(x)), lambda x: NOT regexp_matches(x, '{_NO_TITLE}'))[1], trim({_H1}[1]))"


def _merged(x: str) -> str:
    rows = f"list_transform(string_split({x}, chr(10)), lambda l, i: CASE WHEN i = 1 THEN rtrim(l, ' ') ELSE trim(l, ' ') END)"
    return f"""array_to_string(list_transform({rows}, lambda l, i:
        CASE WHEN {rows}[i + 1] IS NULL THEN l
             WHEN l <> '' AND {rows}[i + 1] <> '' AND (NOT contains('{_END}', right(l, 1)) OR regexp_matches({rows}[i + 1], '^\\p{{Ll}}') OR suffix(l, '-'))
             THEN CASE WHEN suffix(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END
             ELSE l || chr(10) END), '')"""


def _promoted(x: str) -> str:
    return f"""array_to_string(list_transform(string_split({x}, chr(10)), lambda l:
        CASE WHEN NOT starts_with(trim(l, ' '), '#') AND (regexp_matches(trim(l, ' '), '^[\\d.]+\\s+\\w') OR regexp_matches(trim(l, ' '), '{_SECTION}')
              OR (length(trim(l, ' ')) < 80 AND upper(trim(l, ' ')) = trim(l, ' ') AND lower(trim(l, ' ')) <> trim(l, ' ') AND length(regexp_replace(trim(l, ' '), '\\P{{L}}', '', 'g')) > 3))
             THEN '## ' || trim(l, ' ') ELSE l END), chr(10))"""


def _table(x: str) -> str:
    rows = f"list_transform(string_split({x}, chr(10)), lambda r: list_transform(regexp_split_to_array(r, '\\t| {{2,}}'), lambda z: trim(z, ' ')))"
    width = f"list_max(list_transform({rows}, lambda r: len(r)))"
    line = lambda r: f"'| ' || array_to_string({r}, ' | ') || ' |'"
    out = f"list_transform({rows}, lambda r: {line(f'list_resize(r, {width}, {chr(39)}{chr(39)})')})"
    rule = line(f"list_transform(range({width}), lambda k: '---')")
    return f"CASE WHEN len(list_filter(flatten({rows}), lambda z: z <> '')) > 0 THEN array_to_string(list_concat([{out}[1], {rule}], {out}[2:]), chr(10)) || chr(10) ELSE '' END"


_TAILS = ["", ".", "..", "(2020)", ".;", " (PMID: 123)", "https://x.org/a", "）note", "，", "/a:b__c"]
_TAIL_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TAILS))

def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _capitals(x: str) -> str:
    # letters whose capital is several letters
    return f"(upper({x}) = {x} AND lower({x}) <> {x} AND NOT regexp_matches({x}, '[ßŉǰﬀ-ﬆ]'))"


def _junk(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    begins = " OR ".join(f"starts_with(lower({x}), '{j}')" for j in JUNK_TITLES if len(j) >= 5)
    initials = f"({_capitals(x)} AND ((len({words}) <= 6 AND len(list_filter({words}, lambda w: length(w) > 4)) = 0) OR (len(list_filter({words}, lambda w: length(w) = 1)) >= 3 AND length({x}) < 40)))"
    bad = f"length(regexp_replace({x}, '[^\\x00-\\x1f\\x{{fffd}}]', '', 'g')) / length({x}) > 0.3"
    return f"({x} IS NULL OR length({x}) < 5 OR lower({x}) IN ({_quoted(JUNK_TITLES)}) OR (len({words}) = 1 AND regexp_matches({x}, '^\\p{{Lu}}')) OR {initials} OR {bad} OR {begins})"


_BLANK = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _outer(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_CUT = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(s), '{m}') THEN position('{m}' IN lower(s)) + {len(m)} END" for m in STATUS_MARKERS) + ", 1)"
_DEGREE = AUTHOR_WITH_DEGREE.replace("'", "''")
_CLEANED = f"""trim(regexp_replace(regexp_replace(regexp_replace({_outer(f'substr(s, {_CUT})')}, '(?i),?\\s+et\\s+al\\.?\\s*$', ''), '(?s){_DEGREE}.*$', ''), '\\s+', ' ', 'g'), ' ,-')"""


def _file_name(x: str) -> str:
    return f"{_outer(f'regexp_replace({_plain_name(x)}, {chr(39)}{_BLANK}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}"


def _plain_name(x: str) -> str:
    return f"translate(replace(translate({x}, '“”‘’–—', '\"\"' || chr(39) || chr(39) || '--'), '…', '...'), '{ILLEGAL_IN_NAMES}', '')"


_DAMAGED = f"""damaged AS (SELECT doi, damage, 'see ' || v || ', and' AS text FROM (SELECT doi, unnest(['whole', 'zero width', 'after slash', 'after dot', 'line break', 'soft hyphen', 'two blanks']) AS damage,
    unnest([doi, doi || chr(8203), replace(doi, '/', '/ '), replace(doi, '.', '. '), replace(doi, '/', '/' || chr(10)), replace(doi, '0', chr(173) || '0'), replace(doi, '/', '/  ')]) AS v FROM w))"""
_LINES = "CAST(least(i, 3) AS DOUBLE)"

# RE2 cannot look around: the images that keep their text are marked first, and links are told apart one kind after the other
_TEXT, _ADDRESS, _TRACKING = r"[^\]!\x01][^\]]*", "[^)]", "(?:login|article|md5=|journal|author)"
_BODY_CLEAN = rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '(?i)</?(?:lcel|nl)>', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
    a AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\(\s*([^)]*?)\s*\)', '![\1](\2)', 'g'), '!\[([^\]]*)\]\(//([^)]*)\)', '![\1](https://\2)', 'g') AS t FROM d),
    b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\((images/|https://|C:/)', chr(1) || '[\1](\2', 'g'), '!\[[^\]]*\]\(([^)]*)\)', '!(\1)', 'g') AS t FROM a),
    c AS (SELECT doc_id, replace(regexp_replace(t, '(?i)\[\s*((?:\x01\[[^\]]*\]\([^)]+\)|!\([^)]+\))[^\]]*?)\]\s*\(([^)]+)\)', '\1(\2)', 'g'), chr(1) || '[', chr(1)) AS t FROM b),
    e AS (SELECT doc_id, regexp_replace(t, '(?i)\[({_TEXT}|)\]\(({_ADDRESS}*?{_TRACKING}{_ADDRESS}*|#{_ADDRESS}*)\)', '(\1)(\2)', 'g') AS t FROM c),
    f AS (SELECT doc_id, regexp_replace(t, '(?i)\s*\[([^\]!\x01]?[^\]]*{DOI}[^\]]*)\]\([^)]+\)\s*', ' \1 ', 'g') AS t FROM e),
    g AS (SELECT doc_id, regexp_replace(t, '(?i)\s*\[(?:{_TEXT}|)\]\({_ADDRESS}*?({DOI}){_ADDRESS}*\)\s*', ' \1 ', 'g') AS t FROM f),
    h AS (SELECT doc_id, regexp_replace(t, '\[({_TEXT})\]\(([^)]+)\)', '(\1)(\2)', 'g') AS t FROM g)
    SELECT doc_id, replace(regexp_replace(t, '\[\[([^\]]+)\]\]', '[\1]', 'g'), chr(1), '![') AS body FROM h"""

SQL = {
    "doi_repair": f"WITH {_WORKS}, {_DAMAGED}, {repaired('damaged', 'doi, damage', 'text')} SELECT doi, damage, {first_doi('t')} AS found FROM fixed",
    "title_clean": f"""WITH {META}, a AS (SELECT note_id, unnest(range(0, 5)) AS form, unnest([title, 'Article in Press ' || title || ' et al.', title || ' Jane Miller Ph.D.', 'Microsoft Word - x', translate(title, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')]) AS raw FROM m WHERE title IS NOT NULL),
        b AS (SELECT *, regexp_replace({_outer('raw')}, '{DOI_IN_TITLE}', ' ', 'g') AS s, {_outer('raw')} AS o FROM a), c AS (SELECT *, {_CLEANED} AS cleaned, {_file_name('raw')} AS f FROM b),
        d AS (SELECT *, {_junk('raw')} AS junk, o = '' OR {_junk('o')} OR regexp_matches(o, '{MANUSCRIPT_ID}') OR regexp_matches(o, '{SOURCE_FILE}') OR ({_capitals('o')} AND length(o) > 20) AS bad, {_junk('cleaned')} AS junk_cleaned FROM c)
        SELECT note_id, CAST(form AS INT) AS form, junk, cleaned, CASE WHEN bad OR cleaned = '' OR junk_cleaned THEN NULL ELSE cleaned END AS from_metadata,
            CASE WHEN length(f) <= 250 THEN f WHEN length(regexp_extract(substr(f, 1, 251), '^(.*) [^ ]*$', 1)) > 100 THEN regexp_extract(substr(f, 1, 251), '^(.*) [^ ]*$', 1) ELSE substr(f, 1, 250) END AS file_name FROM d""",
    "first_processing": f"""WITH {NOTES}, {META}, z AS (SELECT note_id, coalesce(body, '') AS body FROM n JOIN m USING (note_id) WHERE aliases IS NULL AND reference IS NULL), {repaired('z', 'note_id', 'body')},
        x AS (SELECT note_id, list_filter(regexp_extract_all(t, '(?i){DOI}'), lambda y: {plausible('y')}) AS l FROM fixed), y AS (SELECT note_id, unnest(l) AS d, unnest(range(0, len(l))) AS pos FROM x),
        k AS (SELECT note_id, min(pos) AS pos, arg_max(d, pos) AS d FROM y GROUP BY note_id, lower(d)), c AS (SELECT note_id, pos, {canonical('d')} AS c FROM k)
        SELECT z.note_id, coalesce(string_agg('[[' || {safe('c')} || '|' || c || ']]', chr(10) ORDER BY pos), '') AS links, count(c) AS n, CAST(0 AS BIGINT) AS n_special FROM z LEFT JOIN c USING (note_id) GROUP BY 1""",
    "content_dois": rf"""WITH {_BLOCKS}, z AS (SELECT block_id, note_id, translate(content, '‐‑–—', '----') AS u FROM c), {repaired('z', 'block_id, note_id', 'u')}
        SELECT DISTINCT note_id, 'doi' AS kind, v AS value FROM (SELECT note_id, unnest(regexp_extract_all(t, '(?i){DOI}')) AS v FROM fixed) WHERE {plausible('v')}
        UNION SELECT note_id, 'url', unnest(regexp_extract_all(u, 'https?://[^\s<>"'')\]]+')) FROM z""",
    "doi_sources": f"""WITH {_BLOCKS}, {NOTES}, z AS (SELECT note_id, body AS u FROM n WHERE body IS NOT NULL UNION ALL SELECT note_id, text FROM documents WHERE note_id IS NOT NULL AND text IS NOT NULL
            UNION ALL SELECT note_id, translate(content, '‐‑–—', '----') FROM c), {repaired('z', 'note_id', 'u')}
        SELECT DISTINCT note_id, v AS doi FROM (SELECT note_id, unnest(regexp_extract_all(t, '(?i){DOI}')) AS v FROM fixed) WHERE {plausible('v')}""",
    "body_clean": _BODY_CLEAN,
    "frontmatter_split": rf"""WITH {_DOCS}, x AS (SELECT doc_id, regexp_extract(text, '(?sm)^---\n(.*?)\n---', 1) AS block, regexp_replace(text, '(?sm)\A.*?^---\n.*?\n---\n?', '') AS rest FROM d)
        SELECT doc_id, CASE WHEN NOT broken THEN nullif(trim(regexp_extract(block, '(?m)^tags:\s*\[([^,\]]+)', 1)), '') END AS tag, NOT broken AND regexp_matches(block, '(?m)^title:\s*\S') AS has_title, length(rest) AS rest
        -- a plain value with a colon and a blank in it is no YAML
        FROM (SELECT *, regexp_matches(block, '(?m)^title:\s*[^"''\s][^\n]*:(\s|$)') AS broken FROM x) WHERE block <> ''""",
    "doi_extract": f"""WITH {_DOCS}, x AS (SELECT doc_id, list_filter(regexp_extract_all(text, '(?i){DOI}'), lambda y: {plausible('y')}) AS l FROM d)
        SELECT doc_id, len(l) AS n, array_to_string(l, ' ') AS dois FROM x WHERE len(l) > 0""",
    "doi_canonical": f"""WITH {_WORKS}, t(tail, suffix) AS (VALUES {_TAIL_ROWS}), x AS (SELECT w.doi, tail, w.doi || suffix AS v FROM w, t), y AS (SELECT doi, tail, {canonical('v')} AS canonical FROM x)
        SELECT doi, tail, canonical, {safe('canonical')} AS safe, {plausible('canonical')} AS plausible FROM y""",
    "dash_quotes": f"""WITH {META} SELECT note_id, translate(title, '‐‑–—', '----') AS dashes, translate(title, '‐‑–—―', '-----') AS citation, replace(translate(title, '“”‘’–—', '""' || chr(39) || chr(39) || '--'), '…', '...') AS quotes FROM m WHERE title IS NOT NULL""",
    "main_doi_cascade": f"""WITH {META}, {_DOCS}, p AS (SELECT note_id, doc_id, regexp_extract(list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda l: regexp_matches(l, '(?i)^\\s*doi:') AND regexp_matches(l, '(?i){DOI}'))[1], '(?i){DOI}') AS b,
              list_filter(regexp_extract_all(text, '(?i){DOI}'), lambda y: {plausible('y')})[1] AS c FROM d WHERE note_id IS NOT NULL),
        f AS (SELECT note_id, arg_min(b, doc_id) FILTER (WHERE b IS NOT NULL) AS b, arg_min(c, doc_id) FILTER (WHERE c IS NOT NULL) AS c FROM p GROUP BY 1),
        x AS (SELECT m.note_id, {first_doi('doi')} AS a, b, c FROM m LEFT JOIN f USING (note_id)),
        y AS (SELECT note_id, {canonical('a')} AS a, {canonical('b')} AS b, {canonical('c')} AS c FROM x)
        SELECT note_id, coalesce(a, b, c) AS main_doi, CASE WHEN a IS NOT NULL THEN 'front matter' WHEN b IS NOT NULL THEN 'line' WHEN c IS NOT NULL THEN 'text' ELSE 'none' END AS found_in FROM y""",
    "main_doi_of_body": f"""WITH {META}, {NOTES}, {repaired('n', 'note_id', 'body')},
        x AS (SELECT m.note_id, {first_doi('m.doi')} AS a, {first_doi("regexp_replace(CASE WHEN regexp_matches(reference[1], '(?s)^\\[\\[.*\\]\\]$') THEN substr(reference[1], 3, length(reference[1]) - 4) ELSE reference[1] END, '(?s)^[^|]*\\|', '')")} AS b,
            {first_doi('t')} AS c, nullif(regexp_extract(list_filter(string_split(replace(body, chr(13), ''), chr(10)), lambda l: regexp_matches(l, '(?i)^\\s*doi:') AND regexp_matches(l, '(?i){DOI}'))[1], '(?i){DOI}'), '') AS e FROM m JOIN n USING (note_id) JOIN fixed USING (note_id)),
        y AS (SELECT note_id, {canonical('a')} AS a, {canonical('b')} AS b, {canonical('c')} AS c, {canonical('e')} AS e FROM x) SELECT note_id, coalesce(a, b, c, e) AS main_doi FROM y""",
    "note_title": f"""WITH {_DOCS}, {META}, {NOTES}, k AS (SELECT note_id, nullif(title, '') AS mt, stem FROM m JOIN n USING (note_id))
        SELECT doc_id, coalesce({_TITLE}, mt, stem, 'document ' || doc_id) AS title FROM d LEFT JOIN k USING (note_id)""",
    "headings": f"WITH {_DOCS}, x AS (SELECT doc_id, text, {_promoted('text')} AS body FROM d) SELECT doc_id, md5(body) AS digest, length(body) - length(text) AS added FROM x",
    "paragraph_merge": f"WITH {_BLOCKS} SELECT block_id, {_merged('content')} AS merged FROM c WHERE kind = 'text' OR kind IS NULL",
    "table_md": f"WITH {_BLOCKS} SELECT block_id, {_table('content')} AS markdown FROM c WHERE kind = 'table'",
    "pdf_markdown": f"""WITH {_BLOCKS}, n AS (SELECT *, translate(content, '‐‑–—', '----') AS t FROM c WHERE kind IS NULL OR kind <> 'image'), q AS (SELECT *, {_merged('t')} AS mm FROM n),
        p AS (SELECT note_id, page, ord, block_id, CASE WHEN kind = 'table' THEN 1 ELSE 0 END AS k, CASE WHEN kind = 'table' THEN {_table('content')} ELSE {_promoted('mm')} END AS part FROM q)
        SELECT note_id, page, string_agg(part, chr(10) ORDER BY k, ord, block_id) AS markdown FROM p GROUP BY 1, 2""",
    "body_images": r"""WITH d AS (SELECT * FROM documents WHERE contains(text, '![')), x AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '!\[([^\]]*)\]\(\s*([^)]*?)\s*\)', '![\1](\2)', 'g'), '!\[([^\]]*)\]\(//([^)]*)\)', '![\1](https://\2)', 'g') AS a FROM d),
        -- the images that keep their text are marked, the others lose it
        y AS (SELECT doc_id, text, regexp_replace(regexp_replace(a, '!\[([^\]]*)\]\((images/|https://|C:/)', chr(1) || '[\1](\2', 'g'), '!\[[^\]]*\]\(([^)]*)\)', '!(\1)', 'g') AS a FROM x)
        SELECT doc_id, len(regexp_extract_all(text, '!\[[^\]]*\]\([^)]*\)')) AS n_images, md5(replace(replace(a, chr(1) || '[', '!['), '](images/', '](C:/Vault/IMAGE/')) AS digest FROM y""",
    "url_extract": rf"""WITH {META}, {NOTES} SELECT note_id, unnest(regexp_extract_all(source, 'https?://[^\s<>"'')\]]+')) AS url FROM m
        UNION SELECT note_id, unnest(regexp_extract_all(body, 'https?://[^\s<>"'')\]]+')) FROM n""",
    "url_linkify": f"WITH {META} SELECT note_id, 'See ' || CASE WHEN regexp_matches(source, '^https?://') THEN '[' || source || '](' || source || ')' ELSE source END || ' and [it](' || source || ').' AS text FROM m WHERE source IS NOT NULL",
    "json_leaves": "SELECT leaf, count(*) AS n FROM (SELECT unnest([event_type, props, event_type]) AS leaf FROM events) WHERE leaf IS NOT NULL GROUP BY leaf",
    "first_time_branch": f"WITH {META} SELECT aliases IS NULL AND reference IS NULL AS first_time, count(*) AS n FROM m GROUP BY 1",
    "remove_doi": f"""WITH {_DOCS}, x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), y AS (SELECT doc_id, l, list_filter(l, lambda z: NOT contains(z, 'doi 10.')) AS k FROM x)
        SELECT doc_id, len(l) - len(k) AS removed, md5(array_to_string(k, chr(10))) AS digest FROM y WHERE len(l) > len(k)""",
    "title_from_blocks": f"""WITH {_BLOCKS}, f AS (SELECT note_id, ord, block_id, CASE WHEN kind = 'title' THEN 18.0 WHEN length(content) < 60 THEN 14.0 ELSE 10.0 END AS size, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS text
            FROM c WHERE page = 0 AND (kind IS NULL OR kind IN ('text', 'title'))), j AS (SELECT note_id, size, string_agg(text, ' ' ORDER BY ord, block_id) AS text FROM f GROUP BY 1, 2)
        SELECT note_id, arg_max(text, size) AS title, CAST(max(size) AS DOUBLE) AS size FROM j WHERE length(text) > 20 AND NOT {_junk('text')} GROUP BY 1""",
}
