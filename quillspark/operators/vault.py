"""Plans for the files of a vault: what would be renamed, archived, moved or thrown away. No file is touched here; a plan is
a DataFrame that a sink may carry out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import markdown as M
from quillspark.functions import title as T
from quillspark.functions import udfs
from quillspark.functions import wikilink as W
from quillspark.tables import frontmatter, lookup, notes, ranked, table

BATCH = 45
DONE = "完成_"
ARCHIVED = "2022-01-01"
SPARED = (".obsidian", "TRASH", "trash")
#: Dashes read as a hyphen when names are compared.
NAME_DASHES = "–—"
#: A stem that begins with a name must resemble it by this much.
RESEMBLES = 0.7


def unreferenced(inventory: DataFrame, texts: DataFrame) -> DataFrame:
    """Names of ``inventory(name)`` that no text of ``texts(text)`` shows as a local image."""
    shown = texts.filter(F.contains("text", F.lit("!["))).select(F.explode(M.local_images(F.col("text"))).alias("name")).distinct()
    return inventory.select("name").distinct().join(shown, "name", "left_anti")


def image_gc(spark, sf_dir: str) -> DataFrame:
    """Images to be moved away: every document is held to own an image of its name, beside those that are shown."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    own = docs.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".jpg")).alias("name"))
    shown = docs.select(F.explode(M.local_images(F.col("text"))).alias("name"))
    return unreferenced(own.unionByName(shown), docs).select("name", F.concat(F.lit("TRASH/"), "name").alias("to"))


def image_use(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(M.local_images(F.col("text"))).alias("name")).groupBy("name").agg(F.countDistinct("doc_id").alias("n_documents"))


def _name_key(name):
    return F.translate(name, NAME_DASHES, "-" * len(NAME_DASHES))


def _resolved(links: DataFrame, stems: DataFrame) -> DataFrame:
    """``links(note_id, field, page)`` with the note each leads to: by its exact name, else by the name with other dashes;
    of several the first path."""
    exact = stems.groupBy(F.col("stem").alias("page")).agg(F.min_by("note_id", "path_parts").alias("exact_id"))
    loose = stems.groupBy(_name_key(F.col("stem")).alias("loose")).agg(F.min_by("note_id", "path_parts").alias("loose_id"))
    found = links.join(exact, "page", "left").withColumn("loose", _name_key(F.col("page"))).join(loose, "loose", "left")
    return found.select("note_id", "field", "page", F.coalesce("exact_id", "loose_id").alias("target_id"), F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("loose_id").isNotNull(), "dashes").otherwise("none").alias("how"))


def note_links(spark, sf_dir: str) -> DataFrame:
    fields = ("paper-translate", "paper-analyze", "figure-extractor")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), W.page(F.col(f"`{f}`")).alias("page")) for f in fields))).alias("l")
    links = frontmatter(spark, sf_dir).select("note_id", each).select("note_id", "l.field", "l.page").filter("page IS NOT NULL")
    return _resolved(links, notes(spark, sf_dir).select("note_id", "stem", "path_parts"))


def archive_plan(spark, sf_dir: str) -> DataFrame:
    """Copies that archiving every clipping would make: the note itself and the notes it links to. What is not found is
    reported, what is in the trash is not copied, and what lies at the destination already (an archive of the notes saved before
    ``ARCHIVED``) stays."""
    n = notes(spark, sf_dir).select("note_id", "path", "trashed_at", "mtime", F.get("path_parts", F.lit(0)).alias("top"))
    own = n.filter("top = 'Clippings'").select("note_id", F.lit("note").alias("item"), F.col("note_id").alias("target_id"))
    linked = note_links(spark, sf_dir).join(n.filter("top = 'Clippings'").select("note_id"), "note_id", "left_semi").select("note_id", F.col("field").alias("item"), "target_id")
    targets = n.select(F.col("note_id").alias("target_id"), F.col("path").alias("source"), "trashed_at", (F.col("mtime") < F.lit(ARCHIVED).cast("timestamp_ntz")).alias("archived"))
    plan = own.unionByName(linked).join(targets, "target_id", "left")
    status = F.when(F.col("source").isNull(), "not found").when(F.col("trashed_at").isNotNull(), "in trash").when(F.col("archived"), "exists").otherwise("copied")
    return plan.select("note_id", "item", status.alias("status"), F.when(status.isin("copied", "exists"), F.concat(F.lit("Archive/"), "source")).alias("path"))


def trash_plan(spark, sf_dir: str, day: str = "20240630") -> DataFrame:
    """Folders to be moved into the day's trash, with the notes in them; those of the program and of the trash are spared."""
    top = F.get("path_parts", F.lit(0))
    rows = notes(spark, sf_dir).filter((F.size("path_parts") > 1) & ~top.isin(*SPARED)).groupBy(top.alias("folder")).agg(F.count("*").alias("n_notes"))
    return rows.select("folder", "n_notes", F.concat(F.lit(f"trash/{day}/"), "folder").alias("to"))


def _pdfs(spark, sf_dir: str) -> DataFrame:
    """A PDF for every note, in its folder; those of trashed notes have a sibling marked as done."""
    n = notes(spark, sf_dir)
    folder = F.array_join(F.slice("path_parts", F.lit(1), F.greatest(F.size("path_parts") - 1, F.lit(0))), "/")
    own = n.select(folder.alias("dir"), F.concat("stem", F.lit(".pdf")).alias("name"))
    done = n.filter("trashed_at IS NOT NULL").select(folder.alias("dir"), F.concat(F.lit(DONE), "stem", F.lit(".pdf")).alias("name"))
    return own.unionByName(done)


def done_filter(spark, sf_dir: str) -> DataFrame:
    """PDFs to be processed, and those whose marked sibling is there, which go to the trash."""
    pdfs = _pdfs(spark, sf_dir)
    marked = pdfs.filter(F.col("name").startswith(DONE)).select("dir", F.expr(f"substring(name, {len(DONE) + 1})").alias("name"), F.lit(True).alias("done"))
    rows = pdfs.filter(~F.contains("name", F.lit("完成"))).join(marked, ["dir", "name"], "left")
    return rows.select("dir", "name", F.when(F.col("done"), "trash").otherwise("process").alias("action"))


def batches(spark, sf_dir: str) -> DataFrame:
    """Batches of 45 notes in the order of their paths, each with its histogram of states; a batch is over when none of its
    notes is left in another state."""
    n = notes(spark, sf_dir).select("note_id", "path", F.when(F.col("trashed_at").isNotNull(), "failed").when(F.col("body").isNull(), "waiting").otherwise("done").alias("state"))
    rows = ranked(n, "path", "note_id").withColumn("batch", F.expr(f"rank div {BATCH}"))
    return rows.groupBy("batch").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("state") == "failed").alias("n_failed"), F.min("path").alias("first_path")
    ).withColumn("over", F.col("n_done") + F.col("n_failed") >= F.col("n"))


def free_numbers(place: Column, taken: Column) -> Column:
    """The ``place``-th number (from 0) that is not in ``taken``, a sorted array without repeats."""
    return F.aggregate(taken, place.cast("long"), lambda k, t: F.when(t <= k, k + 1).otherwise(k))


def numbered_names(rows: DataFrame) -> DataFrame:
    """``rows(note_id, dir, name, path)`` with ``k``: of equal names in a folder the first in order of paths has 0, the others the
    next numbers that no name there bears already (as ``name (1)``). A usual name is no group of one task: rows are ranked in
    ranges of the total order, and each name's first rank is taken off."""
    order = ranked(rows, "dir", "name", "path", "note_id")
    first = order.groupBy("dir", "name").agg(F.min("rank").alias("first"))
    numbered = F.regexp_extract("name", r"^(.*) \((\d{1,9})\)$", 2)
    taken = rows.filter(numbered != "").select("dir", F.regexp_extract("name", r"^(.*) \(\d{1,9}\)$", 1).alias("name"), numbered.cast("long").alias("t"))
    # numbers that stand in names of one folder: as many as there are such files
    info = first.join(taken.groupBy("dir", "name").agg(F.array_sort(F.collect_set("t")).alias("taken")), ["dir", "name"], "left").withColumn("both", F.concat_ws("\x00", "dir", "name")).drop("dir", "name")
    met = lookup(order.withColumn("both", F.concat_ws("\x00", "dir", "name")), "both", info).drop("both")
    place = F.col("rank") - F.col("first")
    return met.withColumn("k", F.when(F.col("taken").isNull(), place).when(place == 0, 0).otherwise(free_numbers(place, F.filter("taken", lambda t: t > 0)))).drop("rank", "first", "taken")


def rename_plan(spark, sf_dir: str) -> DataFrame:
    """New file names from titles; of equal names in a folder the first keeps it, the others get a number that is free."""
    n = notes(spark, sf_dir).select("note_id", "path", F.get("path_parts", F.lit(0)).alias("dir"))
    rows = frontmatter(spark, sf_dir).filter("title IS NOT NULL").select("note_id", T.file_name(F.col("title")).alias("name")).filter("name <> ''").join(n, "note_id")
    return numbered_names(rows).select("note_id", "dir", F.when(F.col("k") == 0, F.concat("name", F.lit(".pdf"))).otherwise(F.concat("name", F.lit(" ("), F.col("k").cast("string"), F.lit(").pdf"))).alias("new_name"))


def _illustrated(spark, sf_dir: str) -> DataFrame:
    """(note_id, body): bodies of the notes, each with an image of its own, addressed in one of the usual ways."""
    n = notes(spark, sf_dir).filter("body IS NOT NULL")
    name = F.concat(F.md5(F.col("stem").cast("binary")), F.lit(".jpg"))
    at = F.when(F.col("note_id") % 3 == 0, F.lit("../images/")).when(F.col("note_id") % 3 == 1, F.lit("C:\\Vault\\images\\")).otherwise(F.lit("D:/a/b/images/"))
    return n.select("note_id", "stem", F.concat("body", F.lit("\n![fig]("), at, name, F.lit(")\n")).alias("body"))


def archived_images(bodies: DataFrame, inventory: DataFrame, there: DataFrame) -> DataFrame:
    """(note_id, name, source): images that archiving notes copies, from the first source of ``inventory(name, source, priority)``
    that has them; ``there`` for those of ``there(name)``, which are at the destination, null where none has them."""
    shown = bodies.select("note_id", F.explode(F.array_distinct(M.copied_images(F.col("body")))).alias("name"))
    best = inventory.groupBy("name").agg(F.min_by("source", "priority").alias("source"))
    met = shown.join(best, "name", "left").join(there.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    return met.select("note_id", "name", F.when(F.col("there"), "there").otherwise(F.col("source")).alias("source"))


def archive_images(spark, sf_dir: str) -> DataFrame:
    """Images of the archived notes and where they are copied from: the vault's own folder has those of every second note, the
    common one those of every third, the destination those of every fifth."""
    bodies = _illustrated(spark, sf_dir)
    named = bodies.select("note_id", F.concat(F.md5(F.col("stem").cast("binary")), F.lit(".jpg")).alias("name"))
    inventory = named.filter("note_id % 2 = 0").select("name", F.lit("vault").alias("source"), F.lit(0).alias("priority")).unionByName(named.filter("note_id % 3 = 0").select("name", F.lit("common").alias("source"), F.lit(1).alias("priority")))
    return archived_images(bodies, inventory, named.filter("note_id % 5 = 0"))


def archive_bodies(spark, sf_dir: str) -> DataFrame:
    """Bodies of archived notes with their images' new addresses, and how many were changed."""
    rows = _illustrated(spark, sf_dir)
    return rows.select("note_id", F.size(M.copied_images(F.col("body"))).cast("long").alias("n_changed"), F.md5(M.readdressed_images(F.col("body"), "/archive/images/").cast("binary")).alias("digest"))


def archive_figures(spark, sf_dir: str) -> DataFrame:
    """Figure notes that are archived with a clipping: those of the analysis it links to, whatever dashes its name has."""
    n = notes(spark, sf_dir).select("note_id", "stem", F.get("path_parts", F.lit(0)).alias("top"))
    pages = frontmatter(spark, sf_dir).select("note_id", W.page(F.col("`paper-analyze`")).alias("page")).filter("page IS NOT NULL AND page <> ''")
    own = pages.join(n.filter("top = 'Clippings'").select("note_id"), "note_id", "left_semi")
    figures = n.filter((F.col("top") == "Claude") & F.col("stem").endswith("_figures")).select(F.col("note_id").alias("figures_id"), _name_key(F.col("stem")).alias("key"))
    return own.withColumn("key", F.concat(_name_key(F.col("page")), F.lit("_figures"))).join(figures, "key").select("note_id", "figures_id")


def note_roots(spark, sf_dir: str) -> DataFrame:
    """The nearest folder above each note that is called Clippings, and the folder above that: what archiving starts from."""
    parents = F.slice("path_parts", F.lit(1), F.size("path_parts") - 1)
    back = F.array_position(F.reverse(parents), "Clippings")
    depth = (F.size(parents) - back + 1).cast("int")
    found = notes(spark, sf_dir).filter(F.size("path_parts") > 1).withColumn("depth", F.when(back > 0, depth))
    upto = lambda n: F.array_join(F.slice("path_parts", F.lit(1), n), "/")
    return found.select("note_id", F.when(F.col("depth").isNotNull(), upto(F.col("depth"))).alias("clippings"), F.when(F.col("depth").isNotNull(), upto(F.col("depth") - 1)).alias("vault"))


def parsed_uri(uri: Column) -> Column:
    """``struct(vault, file)`` of an address of the note program, decoded (twice, as it is encoded within a query); null if one is
    missing or it is no such address."""
    part = lambda k: F.nullif(F.try_url_decode(F.try_url_decode(F.try_parse_url(uri, F.lit("QUERY"), F.lit(k)))), F.lit(""))
    return F.when(uri.startswith("obsidian://") & part("vault").isNotNull() & part("file").isNotNull(), F.struct(part("vault").alias("vault"), F.regexp_replace(part("file"), r"[ \t\n]+$", "").alias("file")))


def uri_resolve(spark, sf_dir: str) -> DataFrame:
    """Every note by the address under which the note program opens it: vault, file, and the note found (with and without the
    file's ending)."""
    n = notes(spark, sf_dir).filter(F.size("path_parts") > 1)
    top, rest = F.get("path_parts", F.lit(0)), F.array_join(F.slice("path_parts", F.lit(2), F.size("path_parts")), "/")
    file = F.when(F.col("note_id") % 2 == 0, rest).otherwise(F.regexp_replace(rest, r"\.md$", ""))
    uri = F.concat(F.lit("obsidian://open?vault="), F.url_encode(F.url_encode(top)), F.lit("&file="), F.url_encode(F.url_encode(file)))
    asked = n.select("note_id", parsed_uri(uri).alias("u")).select("note_id", "u.vault", "u.file")
    by_path = n.groupBy(F.regexp_replace("path", r"\.md$", "").alias("key")).agg(F.max_by("note_id", F.struct("mtime", "note_id")).alias("found_id"))
    return asked.withColumn("key", F.concat("vault", F.lit("/"), F.regexp_replace("file", r"\.md$", ""))).join(by_path, "key", "left").select("note_id", "vault", "file", "found_id")


def _asked(spark, sf_dir: str) -> DataFrame:
    """(note_id, page): pages that are asked for, some with dots or ``.md`` at the end."""
    asked = frontmatter(spark, sf_dir).select("note_id", W.page(F.col("`paper-analyze`")).alias("page")).filter("page IS NOT NULL AND page <> ''")
    return asked.withColumn("page", F.concat("page", F.when(F.col("note_id") % 3 == 0, "...").when(F.col("note_id") % 3 == 1, ".md").otherwise("")))


def exact_paths(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, found_id, priority): the page as it stands, with ``.md``, without dots at the end; the first that exists."""
    stems = notes.groupBy("stem").agg(F.max_by("note_id", F.struct("mtime", "note_id")).alias("found_id"))
    forms = F.array(*(F.struct(F.lit(i).alias("priority"), x.alias("stem")) for i, x in enumerate((F.col("page"), F.regexp_replace("page", r"\.md$", ""), F.rtrim(F.col("page"), F.lit("."))))))
    tried = asked.select("note_id", F.explode(forms).alias("f")).select("note_id", "f.priority", "f.stem")
    return tried.join(stems, "stem").groupBy("note_id").agg(F.min_by("found_id", "priority").alias("found_id"), F.min("priority").alias("priority"))


def begun_paths(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, found_id, priority): of the notes whose stem begins with the page (without ``.md``, dots and blanks around it)
    and resembles it by at least ``RESEMBLES``, the newest.

    A stem resembles its own beginning by 2 n / (n + length) at most, so only beginnings that are long enough are tried; they
    meet the pages by equality, so stems that begin alike make no large group.
    """
    pages = asked.select("note_id", F.regexp_replace(F.regexp_replace("page", r"\.md$", ""), r"^[. \t]+|[. \t]+$", "").alias("page")).filter("page <> ''")
    n = F.length("stem")
    least = F.greatest(F.lit(1), F.floor(n * (RESEMBLES / (2 - RESEMBLES))).cast("int"))
    begun = notes.filter(n > 0).select(F.col("note_id").alias("found_id"), "stem", "mtime", F.explode(F.sequence(least, n)).alias("k")).withColumn("page", F.expr("substring(stem, 1, k)"))
    near = pages.join(begun, "page").filter(udfs.similarity("page", "stem") >= RESEMBLES)
    return near.groupBy("note_id").agg(F.max_by("found_id", F.struct("mtime", "found_id")).alias("found_id")).withColumn("priority", F.lit(3))


def path_resolve(spark, sf_dir: str) -> DataFrame:
    """Notes that given names lead to: as it stands, with ``.md``, without dots at the end; the first of these that exists.
    Names that only begin a stem are left to :func:`path_resolve_begun`."""
    return exact_paths(_asked(spark, sf_dir), notes(spark, sf_dir))


def path_resolve_begun(spark, sf_dir: str) -> DataFrame:
    """As :func:`path_resolve`, else any note whose stem begins so and resembles the name, the newest."""
    asked, found = _asked(spark, sf_dir), notes(spark, sf_dir)
    exact = exact_paths(asked, found)
    return exact.unionByName(begun_paths(asked.join(exact, "note_id", "left_anti"), found))


def newest_notes(spark, sf_dir: str) -> DataFrame:
    """The note saved last in each folder."""
    return notes(spark, sf_dir).groupBy(F.get("path_parts", F.lit(0)).alias("folder")).agg(F.max_by("note_id", F.struct("mtime", "note_id")).alias("note_id"), F.max("mtime").alias("mtime"))


QUERIES = {
    f.__name__: f
    for f in (
        image_gc, image_use, note_links, archive_plan, archive_images, archive_bodies, archive_figures, note_roots, trash_plan, done_filter, batches, rename_plan, path_resolve, path_resolve_begun, uri_resolve,
        newest_notes,
    )
}
