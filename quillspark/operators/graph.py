"""The citation graph of all notes: who cites which work, under which name, and what is missing.

Nothing is collected per DOI: one work may be cited by a third of all notes. Counts and first names are aggregates that
combine before the shuffle; the names go back to the citations by a skew-safe lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import wikilink as W
from quillspark.tables import cut, frontmatter, lookup, notes, refs


def entries(references: DataFrame) -> DataFrame:
    """List entries with their link, canonical DOI and key."""
    link = W.split(F.col("raw"))
    rows = references.select("note_id", "field", "pos", D.strip_blanks(F.col("raw")).alias("raw"), link["name"].alias("name"), link["display"].alias("display"))
    doi = F.when(F.col("display").isNotNull(), D.canonical(F.col("display"))["doi"])
    return rows.filter(F.col("raw") != "").withColumn("doi", doi).withColumn("key", F.lower(F.coalesce("doi", "raw")))


def rebuilt_lists(references: DataFrame) -> DataFrame:
    """The ``reference`` lists with each DOI of a link, and each entry that is no link, once per note (the first one counts;
    such an entry's key is its text, whatever the letter case): note_id, pos, key, raw, doi, name, is_special. Implausible DOIs
    are dropped; ``doi`` and ``name`` are null where there is no link."""
    rows = entries(references.filter(F.col("field") == "reference")).filter(F.col("doi").isNull() | D.is_plausible(F.col("doi")))
    first = rows.groupBy("note_id", "key").agg(F.min_by(F.struct("pos", "raw", "doi", "name"), "pos").alias("f"))
    return first.select("note_id", "f.pos", "key", "f.raw", "f.doi", "f.name", (~D.is_safe_name(F.col("f.name"))).alias("is_special"))


def reference_edges(references: DataFrame) -> DataFrame:
    """Citations of the ``reference`` lists: note_id, pos, key, doi, name, is_special."""
    return rebuilt_lists(references).filter("doi IS NOT NULL").drop("raw")


def cited_by_edges(references: DataFrame) -> DataFrame:
    """DOIs that the ``cited_by`` lists name: note_id, pos, key, doi, name ('' for a bare one), each once per note."""
    rows = entries(references.filter(F.col("field") == "cited_by"))
    found = D.doi_first(F.coalesce("display", "raw"))
    rows = rows.select("note_id", "pos", F.coalesce("name", F.lit("")).alias("name"), D.canonical(found)["doi"].alias("doi"), D.is_plausible(found).alias("ok")).filter("doi IS NOT NULL AND ok")
    first = rows.withColumn("key", F.lower("doi")).groupBy("note_id", "key").agg(F.min_by(F.struct("pos", "doi", "name"), "pos").alias("f"))
    return first.select("note_id", "f.pos", "key", "f.doi", "f.name", (~D.is_safe_name(F.col("f.name"))).alias("is_special"))


def work_names(edges: DataFrame, cited: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, spec_ref, spec_cb): the first special name of each DOI in reference and in cited-by lists, in the order of the
    notes' paths."""
    special = edges.filter("is_special AND name <> ''").select("note_id", "pos", "key", "name", F.lit("ref").alias("slot")).unionByName(
        cited.filter("is_special AND name <> ''").select("note_id", "pos", "key", "name", F.lit("cb").alias("slot"))
    )
    order = F.struct("path_parts", "pos")
    pick = lambda slot: F.min_by(F.when(F.col("slot") == slot, F.col("name")), F.when(F.col("slot") == slot, order))
    return special.join(paths, "note_id").groupBy("key").agg(pick("ref").alias("spec_ref"), pick("cb").alias("spec_cb"))


def shared_name(key_doi: Column) -> Column:
    return F.coalesce("spec_ref", "spec_cb", D.canonical(key_doi)["safe"])


def self_dois(meta: DataFrame, stems: DataFrame) -> DataFrame:
    """(note_id, stem, self_doi): the reference that bears the note's own name, else the first one."""
    rows = meta.select("note_id", "reference").join(stems, "note_id")
    links = F.transform("reference", W.split)
    own = F.get(F.filter(links, lambda x: (x["name"] == F.col("stem")) & D.doi_first(x["display"]).isNotNull()), F.lit(0))["display"]
    first = F.get("reference", F.lit(0))
    inner = F.when(first.rlike(r"(?s)^\[\[.*\]\]$"), F.expr("substring(reference[0], 3, length(reference[0]) - 4)")).otherwise(first)
    head = F.regexp_replace(inner, r"(?s)^[^|]*\|", "")
    return rows.select("note_id", "stem", F.coalesce(D.canonical(D.doi_first(own))["doi"], D.canonical(D.doi_first(head))["doi"]).alias("self_doi"))


def polarity(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(note_id, self_doi, n_citing, n_special, tag): notes that cite the note's own DOI, without itself, against the
    special names in its own list."""
    # stems are unique, so notes can be counted
    citing = edges.groupBy("key").agg(F.count("*").alias("n"))
    itself = edges.select("note_id", "key", F.lit(1).alias("itself"))
    special = edges.groupBy("note_id").agg(F.count_if("is_special").alias("n_special"))
    rows = own.withColumn("key", F.lower("self_doi")).join(citing, "key", "left").join(itself, ["note_id", "key"], "left").join(special, "note_id", "left")
    n_citing = F.coalesce("n", F.lit(0)) - F.coalesce("itself", F.lit(0))
    n_special = F.coalesce("n_special", F.lit(0))
    return rows.select("note_id", "self_doi", n_citing.cast("long").alias("n_citing"), n_special.alias("n_special"), F.when(n_citing - n_special > 0, "正向").otherwise("负向").alias("tag"))


# --- queries --------------------------------------------------------------------------------------------------------

def _paths(spark, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("note_id", "path_parts")


def graph_edges(spark, sf_dir: str) -> DataFrame:
    return reference_edges(refs(spark, sf_dir)).select("note_id", "pos", "key", "name", "is_special")


def graph_polarity(spark, sf_dir: str) -> DataFrame:
    stems = notes(spark, sf_dir).select("note_id", "stem")
    return polarity(cut(reference_edges(refs(spark, sf_dir)).select("note_id", "key", "is_special")), self_dois(frontmatter(spark, sf_dir), stems))


def self_doi(spark, sf_dir: str) -> DataFrame:
    return self_dois(frontmatter(spark, sf_dir), notes(spark, sf_dir).select("note_id", "stem")).select("note_id", "self_doi")


def graph_names(spark, sf_dir: str) -> DataFrame:
    all_refs = refs(spark, sf_dir)
    return work_names(reference_edges(all_refs), cited_by_edges(all_refs), _paths(spark, sf_dir))


def graph_resolved_refs(spark, sf_dir: str) -> DataFrame:
    """The lists as they are written back: every citation with the name that all notes share for its work, entries that are no
    links as they stand."""
    all_refs = refs(spark, sf_dir)
    lists = cut(rebuilt_lists(all_refs))
    edges = lists.filter("doi IS NOT NULL")
    names = work_names(edges, cited_by_edges(all_refs), _paths(spark, sf_dir))
    linked = lookup(edges, "key", names).select("note_id", "pos", F.concat(F.lit("[["), shared_name(F.col("doi")), F.lit("|"), "doi", F.lit("]]")).alias("link"))
    return linked.unionByName(lists.filter("doi IS NULL").select("note_id", "pos", F.col("raw").alias("link")))


def graph_cited_by(spark, sf_dir: str) -> DataFrame:
    """Who cites the works that are some note's own, one row per work and citing note.

    Notes that share their own DOI share its rows (``self_doi`` has each note's), so the result grows with the citations
    and not with citations times notes.
    """
    own = self_dois(frontmatter(spark, sf_dir), notes(spark, sf_dir).select("note_id", "stem")).filter("self_doi IS NOT NULL")
    edges = reference_edges(refs(spark, sf_dir)).select("key", F.col("note_id").alias("citing_id"))
    return edges.join(own.select(F.lower("self_doi").alias("key")).distinct(), "key", "left_semi")


def graph_top_missing(spark, sf_dir: str) -> DataFrame:
    """The most cited works that nobody gave a name of its own: the notes still to be written. Ten, ties by DOI."""
    all_refs = refs(spark, sf_dir)
    edges, cited = cut(reference_edges(all_refs).select("key", "name", "is_special")), cited_by_edges(all_refs)
    named = edges.filter("is_special AND name <> ''").select("key").unionByName(cited.filter("is_special AND name <> ''").select("key")).distinct()
    counts = edges.groupBy("key").agg(F.count("*").alias("n_citing"))
    return counts.join(named, "key", "left_anti").orderBy(F.desc("n_citing"), "key").limit(10)


def graph_top_external(spark, sf_dir: str) -> DataFrame:
    """The works that most cited-by lists name and no reference list does. Ten, ties by DOI."""
    all_refs = refs(spark, sf_dir)
    counts = cited_by_edges(all_refs).groupBy("key").agg(F.count("*").alias("n_listing"))
    known = reference_edges(all_refs).select("key").distinct()
    return counts.join(known, "key", "left_anti").orderBy(F.desc("n_listing"), "key").limit(10)


QUERIES = {f.__name__: f for f in (graph_edges, graph_polarity, self_doi, graph_names, graph_resolved_refs, graph_cited_by, graph_top_missing, graph_top_external)}
