"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quillspark.llm import abuse, duplicates, encoding, lookalikes, mojibake, packing, scans, setjoin

_KEY = r"array_to_string(list_sort(regexp_extract_all(replace(translate(lower(raw), 'ςſıẞ', 'σsiß'), 'ß', 'ss'), '[\p{L}\p{M}\p{N}]+')), ' ')"
_ENTRIES = f"SELECT DISTINCT note_id, field, ref_id, {_KEY} AS k FROM refs WHERE raw IS NOT NULL"
_DOI = r"rtrim(regexp_extract(translate(lower(x), '￥', '/'), '10\.\d{4,9}/[-a-z0-9._;()/:]+'), '.;:/()')"
_SETS = rf"""
tok AS (SELECT DISTINCT note_id, {_DOI} AS doi FROM (SELECT note_id, unnest(reference) AS x FROM frontmatter) WHERE regexp_matches(translate(lower(x), '￥', '/'), '10\.\d{{4,9}}/')),
t AS (SELECT * FROM tok WHERE doi <> ''),
n AS (SELECT note_id, count(*) AS n FROM t GROUP BY 1),
links AS (
  SELECT a.note_id AS a, b.note_id AS b FROM t a JOIN t b ON a.doi = b.doi AND a.note_id < b.note_id
  JOIN n na ON na.note_id = a.note_id JOIN n nb ON nb.note_id = b.note_id
  GROUP BY a.note_id, b.note_id, na.n, nb.n HAVING count(*) * 100 >= 85 * (na.n + nb.n - count(*)))
"""


def queries() -> dict:
    return {
        "p2_found": duplicates.p2_found,
        "p2_collapsed": duplicates.p2_collapsed,
        "p3_found": mojibake.p3_found,
        "p3_restored": mojibake.p3_restored,
        "p4_found": lookalikes.p4_found,
        "p4_forms": lookalikes.p4_forms,
        "p5_found": scans.p5_found,
        "p5_paragraphs": scans.p5_paragraphs,
        "p6_found": setjoin.p6_found,
        "p6_classes": setjoin.p6_classes,
        "p7_ids": encoding.p7_ids,
        "p8_packed": packing.p8_packed,
        "p8_fill": packing.p8_fill,
        "p8_sound": packing.p8_sound,
        "p9_found": abuse.p9_found,
        "p9_scores": abuse.p9_scores,
        "p9_rates": abuse.p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""SELECT keep_ref_id, ref_id FROM (SELECT ref_id, min(ref_id) OVER (PARTITION BY note_id, field, k) AS keep_ref_id FROM ({_ENTRIES}))
            WHERE ref_id <> keep_ref_id""",
        "p2_collapsed": f"SELECT min(ref_id) AS ref_id, count(*) AS n_copies FROM ({_ENTRIES}) GROUP BY note_id, field, k",
        "p6_found": f"WITH {_SETS} SELECT a AS note_id_a, b AS note_id_b FROM links",
        "p8_sound": "SELECT DISTINCT pack, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_overfull FROM pack_sizes",
        "p6_classes": f"""WITH {_SETS},
            s AS (SELECT note_id, list_sort(list(doi)) AS k FROM t GROUP BY 1),
            c AS (SELECT note_id, min(note_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_same FROM s),
            o AS (SELECT ca.class_id, count(DISTINCT cb.class_id) AS n_links FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l
                  JOIN c ca ON ca.note_id = l.a JOIN c cb ON cb.note_id = l.b WHERE ca.class_id <> cb.class_id GROUP BY 1)
            SELECT c.note_id, c.class_id, c.n_same, coalesce(o.n_links, 0) AS n_links FROM c LEFT JOIN o USING (class_id)""",
    }
