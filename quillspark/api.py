"""One function per task of a collection, each a plan over the tables under a folder. What is to be written, copied or moved
comes back as DataFrames; the sinks carry it out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import graph, linkage, refs, texts, vault

Plans = dict[str, DataFrame]


def _run(functions, spark: SparkSession, folder: str) -> Plans:
    return {f.__name__: f(spark, folder) for f in functions}


def citation_graph(spark: SparkSession, folder: str) -> Plans:
    """Lists with one name per work, tags, what is missing and what is cited from outside."""
    return _run((graph.graph_resolved_refs, graph.graph_polarity, graph.graph_names, graph.graph_cited_by, graph.graph_top_missing, graph.graph_top_external, texts.body_clean, texts.first_processing), spark, folder)


def match_notes(spark: SparkSession, folder: str) -> Plans:
    """Translations, analyses and figures of clippings."""
    return _run((linkage.match_source, linkage.match_first_ref, linkage.match_jaccard, linkage.match_stem, linkage.match_status, linkage.match_near_miss), spark, folder)


def cited_by(spark: SparkSession, folder: str) -> Plans:
    """New citing works per DOI, and what each note of a folder gets of them."""
    return _run((texts.main_doi_of_body, refs.freshness_age, refs.citedby_topn, refs.citedby_claims), spark, folder)


def reference_lists(spark: SparkSession, folder: str) -> Plans:
    """Reference lists of works: own DOI, DOIs by text and title, enriched entries, what nobody knows."""
    return _run((texts.main_doi_cascade, refs.title_verified, refs.work_references, refs.pin_alike, refs.enrich_refs, refs.appended_refs, refs.citation_misses), spark, folder)


def converted_pages(spark: SparkSession, folder: str) -> Plans:
    """Converted PDFs as Markdown, with DOIs and addresses of their blocks, in batches."""
    return _run((texts.pdf_markdown, texts.table_md, texts.content_dois, texts.doi_sources, vault.done_filter, vault.batches, refs.pin_main), spark, folder)


def clean_images(spark: SparkSession, folder: str) -> Plans:
    return _run((vault.image_gc,), spark, folder)


def rename_files(spark: SparkSession, folder: str) -> Plans:
    return _run((texts.span_titles, texts.title_clean, vault.rename_plan), spark, folder)


def remove_dois(spark: SparkSession, folder: str) -> Plans:
    return _run((texts.remove_doi,), spark, folder)


def archive(spark: SparkSession, folder: str) -> Plans:
    return _run((vault.note_roots, vault.archive_plan, vault.archive_images, vault.archive_bodies, vault.archive_figures), spark, folder)


def trash(spark: SparkSession, folder: str) -> Plans:
    return _run((vault.trash_plan,), spark, folder)


def resolve(spark: SparkSession, folder: str) -> Plans:
    """Notes by address, by name, and by what their name begins with."""
    return _run((vault.uri_resolve, vault.path_resolve, vault.path_resolve_begun), spark, folder)
