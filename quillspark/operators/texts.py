"""Operators on the text of documents and of converted pages."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import markdown as M
from quillspark.functions import title as T
from quillspark.functions import udfs
from quillspark.operators.spans import first_page_titles
from quillspark.tables import frontmatter, notes, table

IMAGE_FOLDER = "C:/Vault/IMAGE/"


def _documents(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL")


def _content(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "content_list_v2").filter("content IS NOT NULL").drop("received_at").dropDuplicates(["block_id"])


def doi_extract(spark, sf_dir: str) -> DataFrame:
    """Plausible DOIs of each document, in order."""
    found = D.plausible_dois(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("dois")).filter("n > 0")


#: Ways in which a DOI comes out of a page broken, and what was put before and behind it.
DAMAGE = {
    "whole": ("{}", ""), "zero width": ("{}​", ""), "after slash": ("/", "/ "), "after dot": (".", ". "), "line break": ("/", "/\n"), "soft hyphen": ("0", "­0"), "two blanks": ("/", "/  "),
}


def doi_repair(spark, sf_dir: str) -> DataFrame:
    """The DOIs of the registry, damaged in each usual way, repaired and found again."""
    rows = table(spark, sf_dir, "works").filter("doi IS NOT NULL").select(F.col("doi")).distinct()
    forms = F.array(*(F.struct(F.lit(name).alias("damage"), F.concat(F.lit("see "), F.replace("doi", F.lit(old), F.lit(new)) if old != "{}" else F.concat("doi", F.lit("​" if name == "zero width" else "")), F.lit(", and")).alias("text")) for name, (old, new) in DAMAGE.items()))
    each = rows.select("doi", F.explode(forms).alias("f")).select("doi", "f.damage", "f.text")
    return each.select("doi", "damage", D.doi_first(D.repair_text(F.col("text"))).alias("found"))


TAILS = ["", ".", "..", "(2020)", ".;", " (PMID: 123)", "https://x.org/a", "）note", "，", "/a:b__c"]


def doi_canonical(spark, sf_dir: str) -> DataFrame:
    """The DOIs of the registry with each usual tail, made canonical, and their file names."""
    rows = table(spark, sf_dir, "works").filter("doi IS NOT NULL").select("doi").distinct()
    each = rows.select("doi", F.posexplode(F.array(*map(F.lit, TAILS))).alias("i", "tail"))
    made = D.canonical(F.concat("doi", "tail"))
    return each.select("doi", F.col("i").alias("tail"), made["doi"].alias("canonical"), made["safe"].alias("safe"), D.is_plausible(made["doi"]).alias("plausible"))


def dash_quotes(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter("title IS NOT NULL")
    return rows.select("note_id", D.normalize_dashes(F.col("title")).alias("dashes"), D.citation_dashes(F.col("title")).alias("citation"), D.smart_quotes(F.col("title")).alias("quotes"))


def main_doi_cascade(spark, sf_dir: str) -> DataFrame:
    """A note's main DOI: of its front matter, else of a ``doi:`` line of one of its documents, else the first plausible one in
    them; of several documents the first that has one."""
    per_doc = _documents(spark, sf_dir).filter("note_id IS NOT NULL").select("note_id", "doc_id", D.doi_from_doi_line(F.col("text")).alias("line"), D.canonical(F.get(D.plausible_dois(F.col("text")), F.lit(0)))["doi"].alias("first"))
    pick = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    docs = per_doc.groupBy("note_id").agg(pick("line"), pick("first"))
    rows = frontmatter(spark, sf_dir).select("note_id", "doi").join(docs, "note_id", "left")
    own = D.canonical(D.doi_first(F.col("doi")))["doi"]
    line, first = F.col("line"), F.col("first")
    return rows.select(
        "note_id", F.coalesce(own, line, first).alias("main_doi"), F.when(own.isNotNull(), "front matter").when(line.isNotNull(), "line").when(first.isNotNull(), "text").otherwise("none").alias("found_in")
    )


def main_doi_of_body(spark, sf_dir: str) -> DataFrame:
    """A note's main DOI for its cited-by list: of its front matter, else of its first reference, else the first one in its
    repaired body (plausible or not), else of a ``doi:`` line."""
    rows = frontmatter(spark, sf_dir).select("note_id", "doi", F.get("reference", F.lit(0)).alias("ref")).join(notes(spark, sf_dir).select("note_id", "body"), "note_id")
    inner = F.when(F.col("ref").rlike(r"(?s)^\[\[.*\]\]$"), F.expr("substring(ref, 3, length(ref) - 4)")).otherwise(F.col("ref"))
    listed = D.doi_first(F.regexp_replace(inner, r"(?s)^[^|]*\|", ""))
    found = [D.canonical(x)["doi"] for x in (D.doi_first(F.col("doi")), listed, D.doi_first(D.repair_text(F.col("body"))))]
    return rows.select("note_id", F.coalesce(*found, D.doi_from_doi_line(F.col("body"))).alias("main_doi"))


def note_title(spark, sf_dir: str) -> DataFrame:
    """Title of each document: its first heading that is no section's, else its first one, else the title of its note's front
    matter, else the note's name, else its number."""
    meta = frontmatter(spark, sf_dir).select("note_id", F.nullif("title", F.lit("")).alias("meta_title")).join(notes(spark, sf_dir).select("note_id", "stem"), "note_id")
    rows = _documents(spark, sf_dir).join(meta, "note_id", "left")
    return rows.select("doc_id", M.first_title(F.col("text"), F.coalesce("meta_title", "stem", F.concat(F.lit("document "), "doc_id"))).alias("title"))


def headings(spark, sf_dir: str) -> DataFrame:
    """Documents with their heading lines marked: how many lines changed."""
    rows = _documents(spark, sf_dir).select("doc_id", M.promoted_headings(F.col("text")).alias("body"), "text")
    return rows.select("doc_id", F.md5(F.col("body").cast("binary")).alias("digest"), (F.length("body") - F.length("text")).cast("long").alias("added"))


def paragraph_merge(spark, sf_dir: str) -> DataFrame:
    rows = _content(spark, sf_dir).filter("kind = 'text' OR kind IS NULL")
    return rows.select("block_id", M.merged_paragraphs(F.col("content")).alias("merged"))


def table_md(spark, sf_dir: str) -> DataFrame:
    """Extracted tables as Markdown. Cells are set apart by tabs or two blanks."""
    rows = F.transform(F.split("content", "\n"), lambda r: F.split(r, r"\t| {2,}"))
    return _content(spark, sf_dir).filter("kind = 'table'").select("block_id", M.table_markdown(rows).alias("markdown"))


def pdf_markdown(spark, sf_dir: str) -> DataFrame:
    """Converted pages as Markdown: their merged text with headings marked, then their tables."""
    rows = F.transform(F.split("content", "\n"), lambda r: F.split(r, r"\t| {2,}"))
    part = F.when(F.col("kind") == "table", M.table_markdown(rows)).otherwise(M.promoted_headings(M.merged_paragraphs(D.normalize_dashes(F.col("content")))))
    made = _content(spark, sf_dir).filter("kind IS NULL OR kind <> 'image'").select("note_id", "page", F.when(F.col("kind") == "table", 1).otherwise(0).alias("t"), "ord", "block_id", part.alias("part"))
    # a page holds a few dozen blocks
    return made.groupBy("note_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "block_id", "part"))), lambda x: x["part"]), "\n").alias("markdown"))


def title_clean(spark, sf_dir: str) -> DataFrame:
    """Titles judged, cleaned and made into file names; with a publication status and a degree put before and behind some."""
    rows = frontmatter(spark, sf_dir).filter("title IS NOT NULL").select("note_id", "title")
    forms = F.array(F.col("title"), F.concat(F.lit("Article in Press "), "title", F.lit(" et al.")), F.concat("title", F.lit(" Jane Miller Ph.D.")), F.lit("Microsoft Word - x"), F.translate("title", ascii_lowercase, ascii_uppercase))
    each = rows.select("note_id", F.posexplode(forms).alias("form", "raw"))
    return each.select("note_id", "form", T.is_junk(F.col("raw")).alias("junk"), T.clean(F.col("raw")).alias("cleaned"), T.from_metadata(F.col("raw")).alias("from_metadata"), T.file_name(F.col("raw")).alias("file_name"))


def title_from_blocks(spark, sf_dir: str) -> DataFrame:
    """The title on a note's first page: its blocks are as large as their kind says; of the sizes, from large to small, the
    first whose text, put together, is longer than twenty characters and no junk."""
    size = F.when(F.col("kind") == "title", 18.0).when(F.length("content") < 60, 14.0).otherwise(10.0)
    first = _content(spark, sf_dir).filter("page = 0 AND (kind IS NULL OR kind IN ('text', 'title'))").select("note_id", "ord", "block_id", size.alias("size"), F.trim(F.regexp_replace("content", r"\s+", " ")).alias("text"))
    joined = first.groupBy("note_id", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    good = joined.filter((F.length("text") > 20) & ~T.is_junk(F.col("text")))
    return good.groupBy("note_id").agg(F.max_by("text", "size").alias("title"), F.max("size").alias("size"))


def body_images(spark, sf_dir: str) -> DataFrame:
    """Image links of the documents brought into their one form and moved to the vault's folder."""
    rows = _documents(spark, sf_dir).filter(F.contains("text", F.lit("![")))
    fixed = M.fixed_images(F.col("text"))
    return rows.select("doc_id", F.regexp_count("text", F.lit(r"!\[[^\]]*\]\([^)]*\)")).cast("long").alias("n_images"), F.md5(M.moved_images(fixed, IMAGE_FOLDER).cast("binary")).alias("digest"))


def body_clean(spark, sf_dir: str) -> DataFrame:
    """Bodies without artifact tags, with images in their one form, none of them clickable, and without bracketed links."""
    return _documents(spark, sf_dir).select("doc_id", udfs.plain_links(M.without_artifacts(F.col("text"))).alias("body"))


def first_processing(spark, sf_dir: str) -> DataFrame:
    """Notes that were never worked on (neither aliases nor references): their document's DOIs, each once in its last spelling, as
    the new reference list. ``n_special`` counts names that are not made of a DOI: none of these are."""
    fresh = frontmatter(spark, sf_dir).filter("aliases IS NULL AND reference IS NULL").select("note_id")
    rows = fresh.join(notes(spark, sf_dir).select("note_id", "body"), "note_id")
    found = rows.select("note_id", F.posexplode(D.plausible_dois(D.repair_text(F.coalesce("body", F.lit("")))))).groupBy("note_id", F.lower("col").alias("key")).agg(F.min("pos").alias("pos"), F.max_by("col", "pos").alias("doi"))
    made = D.canonical(F.col("doi"))
    links = found.select("note_id", "pos", F.concat(F.lit("[["), made["safe"], F.lit("|"), made["doi"], F.lit("]]")).alias("link"))
    lists = links.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]), "\n").alias("links"), F.count("*").alias("n"))
    return rows.select("note_id").join(lists, "note_id", "left").select("note_id", F.coalesce("links", F.lit("")).alias("links"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("n_special"))


def content_dois(spark, sf_dir: str) -> DataFrame:
    """DOIs and addresses in the blocks of converted PDFs, per note: what is drawn from content lists."""
    text = D.normalize_dashes(F.col("content"))
    rows = _content(spark, sf_dir).select("note_id", F.explode(F.concat(F.transform(D.plausible_dois(D.repair_text(text)), lambda x: F.struct(F.lit("doi").alias("kind"), x.alias("value"))), F.transform(M.urls(text), lambda x: F.struct(F.lit("url").alias("kind"), x.alias("value"))))).alias("v"))
    return rows.select("note_id", "v.kind", "v.value").distinct()


def doi_sources(spark, sf_dir: str) -> DataFrame:
    """Distinct DOIs of each note out of its body, its documents and its converted PDF (letter case counts)."""
    body = notes(spark, sf_dir).filter("body IS NOT NULL").select("note_id", F.col("body").alias("text"))
    docs = _documents(spark, sf_dir).filter("note_id IS NOT NULL").select("note_id", "text")
    text = body.unionByName(docs).select("note_id", F.explode(D.plausible_dois(D.repair_text(F.col("text")))).alias("doi"))
    return text.unionByName(content_dois(spark, sf_dir).filter("kind = 'doi'").select("note_id", F.col("value").alias("doi"))).distinct()


def span_titles(spark, sf_dir: str) -> DataFrame:
    """Titles from the spans of first pages. The lines of a converted PDF's first blocks are its spans: as large as their kind
    says, as far down as their order."""
    first = _content(spark, sf_dir).filter("page = 0 AND ord < 12 AND (kind IS NULL OR kind IN ('text', 'title'))")
    size = F.when(F.col("kind") == "title", 18.0).when(F.length("content") < 60, 14.0).otherwise(10.0)
    rows = first.select(F.col("note_id").alias("pdf_id"), size.alias("size"), F.posexplode(F.split("content", "\n")).alias("i", "text"), (F.col("ord") * 60.0).alias("top"))
    spans = rows.select("pdf_id", "size", "text", F.lit(50.0).alias("x"), (F.col("top") + F.least(F.col("i"), F.lit(3)) * 12.0).alias("y"), F.lit(800.0).alias("page_h"))
    return first_page_titles(spans).withColumnRenamed("pdf_id", "note_id")


def url_extract(spark, sf_dir: str) -> DataFrame:
    """Addresses in the front matter's sources and in the bodies of notes."""
    meta = frontmatter(spark, sf_dir).select("note_id", F.explode(M.urls(F.col("source"))).alias("url"))
    body = notes(spark, sf_dir).filter("body IS NOT NULL").select("note_id", F.explode(M.urls(F.col("body"))).alias("url"))
    return meta.unionByName(body).distinct()


def url_linkify(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter("source IS NOT NULL").select("note_id", F.concat(F.lit("See "), "source", F.lit(" and [it]("), "source", F.lit(").")).alias("text"))
    return rows.select("note_id", udfs.linked_urls(F.col("text"), M.urls(F.col("text"))).alias("text"))


def json_leaves(spark, sf_dir: str) -> DataFrame:
    """String leaves of nested JSON, counted. The leaves are walked in Python; only the column read is sent there."""
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", F.struct(F.col("props"), F.array("event_type").alias("kinds")).alias("nested"))).alias("payload"))
    return rows.select(F.explode(udfs.json_leaves("payload")).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))


def frontmatter_split(spark, sf_dir: str) -> DataFrame:
    """Front matter block of documents, as title and tags, and the length of what follows."""
    block = F.regexp_extract("text", r"(?dsm)^---\n(.*?)\n---", 1)
    rows = _documents(spark, sf_dir).select("doc_id", block.alias("block"), F.length(F.regexp_replace("text", r"(?dsm)\A.*?^---\n.*?\n---\n?", "")).cast("long").alias("rest")).filter("block <> ''")
    parsed = rows.withColumn("fm", udfs.front_matter_json(F.col("block")))
    return parsed.select("doc_id", F.get_json_object("fm", "$.tags[0]").alias("tag"), F.get_json_object("fm", "$.title").isNotNull().alias("has_title"), "rest")


def never_worked_on(fm: Column) -> Column:
    """Whether front matter as JSON has neither aliases nor references; a key without a value is there."""
    keys = F.coalesce(F.json_object_keys(fm), F.array().cast("array<string>"))
    return ~F.array_contains(keys, "aliases") & ~F.array_contains(keys, "reference")


def first_page_dois(pages: DataFrame) -> DataFrame:
    """(path, doi): of ``pages(path, page, text)`` the first DOI of the first page that has a plausible one, canonical."""
    found = pages.select("path", "page", F.get(D.plausible_dois(D.repair_text(F.col("text"))), F.lit(0)).alias("d")).filter("d IS NOT NULL")
    return found.groupBy("path").agg(F.min_by("d", "page").alias("d")).select("path", D.canonical(F.col("d"))["doi"].alias("doi"))


def first_time_branch(spark, sf_dir: str) -> DataFrame:
    """Notes that were never worked on: neither aliases nor references are there (an empty list is)."""
    return frontmatter(spark, sf_dir).groupBy((F.col("aliases").isNull() & F.col("reference").isNull()).alias("first_time")).agg(F.count("*").alias("n"))


def remove_doi(spark, sf_dir: str) -> DataFrame:
    """Documents without the lines that hold a DOI mark: lines removed and what is left."""
    rows = _documents(spark, sf_dir).filter(F.contains("text", F.lit("doi 10.")))
    done = M.without_lines(F.col("text"), F.lit("doi 10."))
    return rows.select("doc_id", done["removed"].cast("long").alias("removed"), F.md5(done["body"].cast("binary")).alias("digest")).filter("removed > 0")


def fuzzy_title(spark, sf_dir: str) -> DataFrame:
    """Notes whose title resembles the first heading of their document by at least a half."""
    docs = _documents(spark, sf_dir).filter("note_id IS NOT NULL").select("doc_id", "note_id", M.first_title(F.col("text"), F.lit(None).cast("string")).alias("heading")).filter("heading IS NOT NULL")
    rows = docs.join(frontmatter(spark, sf_dir).filter("title IS NOT NULL").select("note_id", "title"), "note_id")
    return rows.withColumn("similarity", udfs.screened_similarity("title", "heading")).filter("similarity >= 0.5").select("doc_id", "note_id", "similarity")


QUERIES = {
    f.__name__: f
    for f in (
        doi_extract, doi_repair, doi_canonical, dash_quotes, main_doi_cascade, main_doi_of_body, note_title, headings, paragraph_merge, table_md, pdf_markdown, title_clean, title_from_blocks, body_images, body_clean, url_extract,
        url_linkify, json_leaves, frontmatter_split, first_time_branch, first_processing, content_dois, doi_sources, span_titles, remove_doi, fuzzy_title,
    )
}
