"""Building blocks of the SQL (DuckDB) that the queries are checked against."""

DOI = r"10\.\d{4,9}/[-A-Za-z0-9._;()/:]+"
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def first_doi(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(?i){DOI}'), '')"


def canonical(x: str) -> str:
    """The canonical DOI of an expression (the expression is repeated; keep it short)."""
    s = f"regexp_replace({strip(x)}, '(?s)https?://.*$', '')"
    s = f"regexp_replace({s}, '(?i)\\.?\\(?(?:PMID|PMCID):?\\s*\\d+\\)?\\.?$', '')"
    s = f"regexp_replace({s}, '\\(\\d{{4}}\\)\\.?$|\\.+$', '')"
    s = f"rtrim({strip(s)}, '。,， \t\n;；：:')"
    return f"(CASE WHEN regexp_matches({s}, '[（(]') THEN {s} ELSE regexp_replace({s}, '[)）].*', '', 'g') END)"


def safe(d: str) -> str:
    """The safe name of a canonical DOI."""
    s = f"regexp_replace(replace({d}, '/', '￥'), '[\\\\:*?\"<>|]', '', 'g')"
    s = f"substr(trim(regexp_replace({s}, '[￥_\\s]+', '￥', 'g'), '￥-_ '), 1, 200)"
    return s


_C = "[-A-Za-z0-9._;()/:]"
INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD, 0x200E, 0x200F, 0x2028, 0x2029)))


def repaired(source: str, key: str, text: str, rounds: int = 8) -> str:
    """CTEs that end in ``fixed``: ``key`` and ``text`` of ``source`` with split DOIs closed, round by round."""
    once = lambda x: rf"regexp_replace({x}, '([/\-._;():])\s({_C})', '\1\2', 'g')"
    gap = lambda x: rf"regexp_replace({x}, '(?i)(10\.\d{{4,9}}/{_C}+)([./])\s+([-A-Za-z0-9]{{2,}}\.{_C}+)', '\1\2\3', 'g')"
    digit = lambda x: rf"regexp_replace({x}, '(?i)(10\.\d{{4,9}}/{_C}*?)[ \t]+({_C}*\d{_C}*)', '\1\2', 'g')"
    clean = f"translate({text}, '{INVISIBLE}', '')"
    steps = [f"fix0 AS (SELECT {key}, {once(once(clean))} AS t FROM {source})"]
    steps += [f"fix{i} AS (SELECT {key}, {digit(gap('t'))} AS t FROM fix{i - 1})" for i in range(1, rounds)]
    return ", ".join([*steps, f"fixed AS (SELECT {key}, {digit(gap('t'))} AS t FROM fix{rounds - 1})"])


def plausible(d: str) -> str:
    return f"NOT regexp_matches({d}, '^10\\.\\d{{4,9}}/[A-Za-z]+$')"


def is_safe(n: str) -> str:
    return f"regexp_matches({n}, '(?i)^10\\.\\d{{4,9}}￥[-A-Za-z0-9._;()/:]+')"


NOTES = "n AS (SELECT DISTINCT ON (note_id) * FROM notes)"
META = "m AS (SELECT DISTINCT ON (note_id) * FROM frontmatter)"
_OUT = r"^[\s\p{Z}\x{200b}\x{feff}]+|[\s\p{Z}\x{200b}\x{feff}]+$"
_STRIPPED = f"regexp_replace(raw, '{_OUT}', '', 'g')"
REFS = f"r AS (SELECT DISTINCT ON (ref_id) ref_id, note_id, field, pos, {strip('raw')} AS raw, {_STRIPPED} AS s FROM refs)"
ENTRIES = f"""{REFS},
l AS (SELECT *, regexp_matches(s, '(?s)^\\[\\[.*\\|.*\\]\\]$') AS ok, regexp_extract(s, '(?s)^\\[\\[(.*)\\]\\]$', 1) AS i FROM r WHERE raw <> ''),
l2 AS (SELECT note_id, field, pos, raw, CASE WHEN ok THEN regexp_replace(split_part(i, '|', 1), '{_OUT}', '', 'g') END AS name,
              CASE WHEN ok THEN regexp_replace(regexp_replace(i, '(?s)^[^|]*\\|', ''), '{_OUT}', '', 'g') END AS display FROM l),
e AS (SELECT *, CASE WHEN display IS NOT NULL THEN {canonical('display')} END AS doi FROM l2),
lists AS (SELECT note_id, lower(coalesce(doi, raw)) AS key, pos, raw, doi, name FROM e WHERE field = 'reference' AND (display IS NULL OR {plausible('doi')})
          QUALIFY row_number() OVER (PARTITION BY note_id, lower(coalesce(doi, raw)) ORDER BY pos) = 1),
edges AS (SELECT note_id, key, pos, doi, name FROM lists WHERE doi IS NOT NULL),
ce AS (SELECT note_id, pos, coalesce(name, '') AS name, {first_doi('coalesce(display, raw)')} AS f FROM e WHERE field = 'cited_by'),
cited AS (SELECT note_id, lower(doi) AS key, min(pos) AS pos, arg_min(name, pos) AS name FROM (SELECT *, {canonical('f')} AS doi FROM ce WHERE f IS NOT NULL AND {plausible('f')}) GROUP BY 1, 2),
g AS (SELECT *, NOT {is_safe('name')} AS is_special FROM edges),
cg AS (SELECT *, NOT {is_safe('name')} AS is_special FROM cited)"""
SELF = f"""
links AS (SELECT note_id, i, regexp_replace(x, '{_OUT}', '', 'g') AS x, x AS raw FROM (SELECT note_id, unnest(reference) AS x, unnest(range(1, len(reference) + 1)) AS i FROM m)),
li AS (SELECT *, regexp_matches(x, '(?s)^\\[\\[.*\\|.*\\]\\]$') AS ok, regexp_extract(x, '(?s)^\\[\\[(.*)\\]\\]$', 1) AS inn FROM links),
lj AS (SELECT note_id, i, regexp_replace(split_part(inn, '|', 1), '{_OUT}', '', 'g') AS name, {first_doi("regexp_replace(inn, '(?s)^[^|]*\\|', '')")} AS f FROM li WHERE ok),
own AS (SELECT lj.note_id, arg_min(f, i) AS f FROM lj JOIN n ON n.note_id = lj.note_id AND n.stem = lj.name WHERE f IS NOT NULL GROUP BY 1),
head AS (SELECT note_id, {first_doi("regexp_replace(CASE WHEN regexp_matches(raw, '(?s)^\\[\\[.*\\]\\]$') THEN substr(raw, 3, length(raw) - 4) ELSE raw END, '(?s)^[^|]*\\|', '')")} AS f FROM links WHERE i = 1),
sd AS (SELECT n.note_id, {canonical('coalesce(own.f, head.f)')} AS self_doi FROM n JOIN m USING (note_id) LEFT JOIN own USING (note_id) LEFT JOIN head USING (note_id))"""
