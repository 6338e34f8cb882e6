"""Reference lists: clean-up, merging, numbering, enrichment from the registry of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import markdown as M
from quillspark.functions import udfs
from quillspark.functions import wikilink as W
from quillspark.tables import cut, frontmatter, lookup, notes, refs, spread_join, table

AS_OF = "2024-06-30"
MOST_AGE = 15
TOP = 10


def deduped(items: Column) -> Column:
    """A list with each link's display (whatever its case) and each other entry (as it stands) once, the first one; a slash
    in a name becomes its stand-in. An entry's key is compared with those before it, within the list."""
    kept = F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: D.strip_blanks(x))

    def parsed(x: Column) -> Column:
        link = W.split(x)
        is_link = link.isNotNull() & (link["display"] != "")
        text = F.when(is_link, F.concat(F.lit("[["), F.replace(link["name"], F.lit("/"), F.lit(D.SLASH_STAND_IN)), F.lit("|"), link["display"], F.lit("]]"))).otherwise(x)
        return F.struct(F.when(is_link, F.lower(link["display"])).otherwise(x).alias("key"), text.alias("text"))

    def first(rows: Column, keys: Column) -> Column:
        return F.transform(F.filter(rows, lambda r, i: F.array_position(keys, r["key"]) == i + 1), lambda r: r["text"])

    return D.bound(F.transform(kept, parsed), lambda rows: D.bound(F.transform(rows, lambda r: r["key"]), lambda keys: first(rows, keys)))


def pinned(items: Column, doi: Column) -> Column:
    """The note's own DOI first, and no second time."""
    link = W.make_canonical(doi)
    return F.when(doi.isNull(), items).otherwise(F.concat(F.array(link), F.filter(items, lambda x: F.coalesce(F.lower(W.split(x)["display"]) != F.lower(D.canonical(doi)["doi"]), F.lit(True)))))


def pinned_alike(items: Column, doi: Column) -> Column:
    """The note's own DOI first; entries that hold it anywhere, whatever the letter case, go."""
    own = D.canonical(doi)["doi"]
    return F.when(doi.isNull(), items).otherwise(F.concat(F.array(W.make_safe(doi)), F.filter(items, lambda x: ~F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lower(own)))))


def dedupe_refs(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter("reference IS NOT NULL")
    return rows.select("note_id", F.array_join(deduped(F.col("reference")), "\n").alias("refs"), F.size(deduped(F.col("reference"))).cast("long").alias("n"))


def pin_main(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter("reference IS NOT NULL")
    return rows.select("note_id", F.array_join(pinned(F.col("reference"), D.doi_first(F.col("doi"))), "\n").alias("refs"))


def pin_alike(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter("reference IS NOT NULL")
    return rows.select("note_id", F.array_join(pinned_alike(F.col("reference"), D.doi_first(F.col("doi"))), "\n").alias("refs"))


def number_refs(spark, sf_dir: str) -> DataFrame:
    rows = frontmatter(spark, sf_dir).filter(F.size("reference") > 0)
    return rows.select("note_id", M.reference_list(F.col("reference")).alias("section"))


def merge_dois(spark, sf_dir: str) -> DataFrame:
    """Per note and DOI of either list: the first position and the last spelling, and the lists it stands in."""
    rows = refs(spark, sf_dir).select("note_id", "field", "pos", D.doi_first(F.translate("raw", D.SLASH_STAND_IN, "/")).alias("doi")).filter("doi IS NOT NULL")
    order = F.struct(F.when(F.col("field") == "reference", 0).otherwise(1).alias("f"), "pos")
    return rows.groupBy("note_id", F.lower("doi").alias("key")).agg(
        F.min("pos").alias("first_pos"), F.max_by("doi", order).alias("last_spelling"), F.countDistinct("field").alias("n_lists"), F.count("*").alias("n_entries")
    )


def existing_dois(spark, sf_dir: str) -> DataFrame:
    """Distinct DOIs known in each folder: of the notes themselves, of their references and of what cites them."""
    top = notes(spark, sf_dir).select("note_id", F.get("path_parts", F.lit(0)).alias("folder"))
    own = frontmatter(spark, sf_dir).select("note_id", F.lower(D.doi_first(F.col("doi"))).alias("doi"))
    listed = refs(spark, sf_dir).select("note_id", F.lower(D.doi_first(F.translate("raw", D.SLASH_STAND_IN, "/"))).alias("doi"))
    both = own.unionByName(listed).filter("doi IS NOT NULL")
    return both.join(top, "note_id").groupBy("folder").agg(F.countDistinct("doi").alias("n_dois"), F.count("*").alias("n_mentions"))


def wikilinks(spark, sf_dir: str) -> DataFrame:
    """Entries split as links and the links made anew of their DOI, plain, canonical and with a safe name."""
    rows = refs(spark, sf_dir)
    link, doi = W.split(F.col("raw")), D.doi_first(F.translate("raw", D.SLASH_STAND_IN, "/"))
    return rows.select(
        "ref_id", link["name"].alias("name"), link["display"].alias("display"), W.make(doi).alias("plain"), W.make_canonical(doi).alias("canonical"), W.make_safe(doi).alias("with_safe_name")
    )


def freshness_age(spark, sf_dir: str) -> DataFrame:
    """Whether a note's cited-by list is younger than thirty days, and whether its work is young enough for references."""
    rows = frontmatter(spark, sf_dir).select("note_id", "cited_by_date", F.lower(D.doi_first(F.col("doi"))).alias("key"))
    works = table(spark, sf_dir, "works").filter("doi IS NOT NULL").groupBy(F.lower("doi").alias("key")).agg(F.max("issued_year").alias("issued_year"))
    as_of = F.lit(AS_OF).cast("date")
    found = lookup(rows, "key", works)
    return found.select(
        "note_id", F.coalesce(F.datediff(as_of, "cited_by_date") < 30, F.lit(False)).alias("fresh"), F.coalesce(F.year(as_of) - F.col("issued_year") <= MOST_AGE, F.lit(True)).alias("young")
    )


def enrich_refs(spark, sf_dir: str) -> DataFrame:
    """References with year and citations of their work; without a DOI or a work, nulls. Withdrawn works count."""
    rows = refs(spark, sf_dir).filter("field = 'reference'").select("ref_id", D.key_of_entry(F.col("raw")).alias("key"))
    works = table(spark, sf_dir, "works").filter("doi IS NOT NULL").groupBy(F.lower("doi").alias("key")).agg(F.max("issued_year").alias("issued_year"), F.max("cited_count").alias("cited_count"))
    return lookup(rows, "key", works).select("ref_id", F.col("key").alias("doi"), "issued_year", "cited_count")


def lookup_misses(spark, sf_dir: str) -> DataFrame:
    """DOIs to be fetched: those that references carry and the registry does not have, with how often they are asked for."""
    rows = refs(spark, sf_dir).filter("field = 'reference'").select(D.key_of_entry(F.col("raw")).alias("doi")).filter("doi IS NOT NULL")
    known = table(spark, sf_dir, "works").select(F.lower("doi").alias("doi")).distinct()
    return rows.groupBy("doi").agg(F.count("*").alias("n")).join(known, "doi", "left_anti")


def largest(rows: DataFrame, by: list[str], order: list, most: int, salts: int = 32) -> DataFrame:
    """The first ``most`` rows per group and their ``place``, in two levels: per salt, then per group, so that a group with a
    third of all rows does not come into one task."""
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in by)), F.lit(salts)).alias("__salt")
    per_salt = Window.partitionBy(*by, "__salt").orderBy(*order)
    some = rows.select("*", salt).withColumn("__k", F.row_number().over(per_salt)).filter(F.col("__k") <= most).drop("__k", "__salt")
    return some.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= most)


def new_citing(links: DataFrame, summaries: DataFrame, listed: DataFrame, as_of: str, most: int = TOP, years: int = 5) -> DataFrame:
    """(doi, place, citing_doi, n_citing): the newest citing works of each DOI that its own list does not have yet.

    ``links(doi, citing)`` tells which records cite a DOI, ``summaries(citing, ord, published, citing_doi)`` what is known of
    them, ``listed(doi, key)`` the keys that a DOI's list has. Only works of the last ``years`` of 365 days count, those
    without a date or a DOI do not; of one day by ``ord``. ``n_citing`` counts all links.
    """
    day = F.try_to_date("published", "yyyy/MM/dd")
    recent = summaries.withColumn("day", day).filter((F.col("day") > F.date_sub(F.lit(as_of).cast("date"), years * 365)) & F.col("citing_doi").isNotNull())
    met = links.join(recent.select("citing", "ord", "day", "citing_doi"), "citing").withColumn("key", F.lower("citing_doi"))
    fresh = met.join(listed.select("doi", "key").distinct(), ["doi", "key"], "left_anti").select("doi", "day", "ord", "citing_doi")
    counts = links.groupBy("doi").agg(F.count("*").alias("n_citing"))
    return largest(fresh, ["doi"], [F.desc("day"), "ord"], most).select("doi", "place", "citing_doi").join(counts, "doi")


def _citing(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links and summaries of the chain, from the notes: a note cites the DOIs of its references, was published when it was
    made, and has the DOI of its front matter."""
    links = refs(spark, sf_dir).filter("field = 'reference'").select(F.col("note_id").alias("citing"), D.key_of_entry(F.col("raw")).alias("doi")).filter("doi IS NOT NULL").distinct()
    own = frontmatter(spark, sf_dir).select("note_id", D.canonical(D.doi_first(F.col("doi")))["doi"].alias("citing_doi"))
    made = notes(spark, sf_dir).select("note_id", F.date_format("created_at", "yyyy/MM/dd").alias("published"))
    return links, made.join(own, "note_id").select(F.col("note_id").alias("citing"), F.col("note_id").alias("ord"), "published", "citing_doi")


def citedby_topn(spark, sf_dir: str) -> DataFrame:
    """The ten newest works of the last five years that cite each DOI and stand in no ``cited_by`` list of the notes on it."""
    links, summaries = _citing(spark, sf_dir)
    owners = frontmatter(spark, sf_dir).select("note_id", F.lower(D.canonical(D.doi_first(F.col("doi")))["doi"]).alias("doi")).filter("doi IS NOT NULL")
    cited = refs(spark, sf_dir).filter("field = 'cited_by'").select("note_id", D.key_of_entry(F.col("raw")).alias("key")).filter("key IS NOT NULL")
    return new_citing(links, summaries, cited.join(owners, "note_id").select("doi", "key"), AS_OF)


def claims(candidates: DataFrame, most: int = TOP) -> DataFrame:
    """(folder, note_id, place, doi): each note of a folder, in the order of ``ord``, claims its ``most`` newest citing DOIs that
    no note before it has claimed. ``candidates`` is (folder, ord, note_id, age, doi).

    No folder is gone through in order: all notes ask for their newest at once, each DOI goes to the first note that asks, and
    those turned down ask for their next, until nobody is. As all DOIs prefer the notes in the same order, that ends where
    going through them would, after as many rounds as claims depend on one another.
    """
    alive = cut(candidates.select("folder", "ord", "note_id", "age", "doi").distinct())
    while True:
        asked = cut(largest(alive, ["folder", "ord", "note_id"], ["age", "doi"], most))
        winner = asked.groupBy("folder", "doi").agg(F.min(F.struct("ord", "note_id")).alias("w"))
        lost = cut(asked.join(winner, ["folder", "doi"]).filter(F.struct("ord", "note_id") != F.col("w")).select("folder", "ord", "note_id", "doi"))
        if lost.isEmpty():
            return asked.select("folder", "note_id", "place", "doi")
        alive = cut(alive.join(lost, ["folder", "ord", "note_id", "doi"], "left_anti"))


def citedby_claims(spark, sf_dir: str) -> DataFrame:
    """What each note with a DOI of its own gets for its cited-by list, if the notes of a folder are served by their paths."""
    links, summaries = _citing(spark, sf_dir)
    owners = frontmatter(spark, sf_dir).select("note_id", F.lower(D.canonical(D.doi_first(F.col("doi")))["doi"]).alias("doi")).filter("doi IS NOT NULL")
    placed = owners.join(notes(spark, sf_dir).select("note_id", F.get("path_parts", F.lit(0)).alias("folder"), F.col("path").alias("ord")), "note_id")
    days = summaries.filter("citing_doi IS NOT NULL").select("citing", (-F.datediff(F.try_to_date("published", "yyyy/MM/dd"), F.lit("1970-01-01").cast("date"))).alias("age"), F.lower("citing_doi").alias("citing_doi"))
    met = spread_join(links, placed, "doi", limit=1000).join(days, "citing")
    return claims(met.groupBy("folder", "ord", "note_id", F.col("citing_doi").alias("doi")).agg(F.min("age").alias("age")))


# --- citations as text ----------------------------------------------------------------------------------------------

#: What stands before the DOI of a citation in running text.
DOI_MARK = r"(?i)[\s,.;(]*(?:doi:?\s*)?10\.\d{4,9}/.*$"


def citation_text(raw: Column) -> Column:
    """A citation without its DOI, its case and the punctuation at its end; null for links and for what is too short."""
    text = F.lower(F.regexp_replace(D.strip_blanks(F.regexp_replace(raw, DOI_MARK, "")), r"[\s.,;“”\"]+$|^[\s“”\"]+", ""))
    return F.when(~F.contains(raw, F.lit("[[")) & (F.length(text) > 20), text)


def citation_lookup(entries: DataFrame) -> DataFrame:
    """(text, doi): the DOI that each citation was given wherever it stands with one; of several the smallest."""
    return entries.select(citation_text(F.col("raw")).alias("text"), D.key_of_entry(F.col("raw")).alias("doi")).filter("text IS NOT NULL AND doi IS NOT NULL").groupBy("text").agg(F.min("doi").alias("doi"))


def work_references(spark, sf_dir: str) -> DataFrame:
    """The reference list of each note on a work: entries in order with their DOI, their own or, where there is none, the one
    that the citation's text is known with; entries that get none are left out."""
    entries = refs(spark, sf_dir).filter("field = 'reference'").select("note_id", "pos", "raw")
    rows = entries.select("note_id", "pos", D.key_of_entry(F.col("raw")).alias("own"), citation_text(F.col("raw")).alias("text"))
    found = lookup(rows.withColumn("text", F.when(F.col("own").isNull(), F.col("text"))), "text", citation_lookup(entries))
    filled = found.select("note_id", "pos", F.coalesce("own", "doi").alias("doi"), F.when(F.col("own").isNotNull(), "own").otherwise("text").alias("found_by")).filter("doi IS NOT NULL")
    return filled


def appended_refs(spark, sf_dir: str) -> DataFrame:
    """The section of references that is put at the end of each body that has none yet: numbered entries with the DOI they are
    known with."""
    texts = refs(spark, sf_dir).filter("field = 'reference'").select("note_id", "pos", D.strip_blanks(F.col("raw")).alias("raw"))
    open_ = notes(spark, sf_dir).filter(~F.contains(F.coalesce("body", F.lit("")), F.lit("## 参考文献"))).select("note_id")
    rows = work_references(spark, sf_dir).join(texts, ["note_id", "pos"]).join(open_, "note_id", "left_semi")
    # a note's list, in order
    lists = rows.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "doi"))).alias("l"))
    lines = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["raw"], F.lit(" DOI: "), x["doi"]))
    return lists.select("note_id", F.concat(F.lit("\n\n## 参考文献\n"), F.array_join(lines, "\n")).alias("section"))


def citation_misses(spark, sf_dir: str) -> DataFrame:
    """Citations without a DOI that nobody knows one for, and how often they are asked for."""
    entries = refs(spark, sf_dir).filter("field = 'reference'").select("raw")
    asked = entries.filter(D.key_of_entry(F.col("raw")).isNull()).select(citation_text(F.col("raw")).alias("text")).filter("text IS NOT NULL")
    return asked.groupBy("text").agg(F.count("*").alias("n")).join(citation_lookup(entries), "text", "left_anti")


def title_verified(spark, sf_dir: str) -> DataFrame:
    """A note's DOI by its title, tried against the first heading of its documents: accepted at a similarity of 0.5, else the
    DOI that the registry's own spelling of the title leads to, else the first one all the same.

    The registry of titles are the notes that have both; a title is looked up without its case."""
    known = frontmatter(spark, sf_dir).filter("title IS NOT NULL").select(F.lower("title").alias("key"), "title", F.lower(D.canonical(D.doi_first(F.col("doi")))["doi"]).alias("found")).filter("found IS NOT NULL")
    registry = known.groupBy("key").agg(F.min("found").alias("found"), F.min_by("title", "found").alias("known_title"))
    headed = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND note_id IS NOT NULL").select("doc_id", "note_id", M.first_title(F.col("text"), F.lit(None).cast("string")).alias("heading"))
    asked = frontmatter(spark, sf_dir).filter("title IS NOT NULL").select("note_id", F.lower("title").alias("key")).join(headed, "note_id")
    hit = lookup(asked, "key", registry).filter("found IS NOT NULL")
    again = lookup(hit.withColumn("retry_key", F.lower("known_title")), "retry_key", registry.select(F.col("key").alias("retry_key"), F.col("found").alias("retry")))
    alike = F.when(F.col("heading").isNull(), 1.0).otherwise(udfs.screened_similarity("heading", "known_title"))
    return again.select("doc_id", "note_id", F.when(alike >= 0.5, F.col("found")).otherwise(F.coalesce("retry", "found")).alias("doi"))


def local_refs(spark, sf_dir: str) -> DataFrame:
    """Numbered entries of the documents' reference sections with the DOI they carry."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(M.reference_entries(F.col("text"))).alias("i", "entry"))
    return rows.select("doc_id", (F.col("i") + 1).alias("number"), "entry", D.doi_first(D.repair_text(F.col("entry"))).alias("doi"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_refs, pin_main, pin_alike, number_refs, merge_dois, existing_dois, wikilinks, freshness_age, enrich_refs, lookup_misses, citedby_topn, citedby_claims, work_references, appended_refs, citation_misses, title_verified,
        local_refs,
    )
}
