"""References to records that do not exist.

A pointer is an orphan if its target is absent (or gone), or came only after the pointing record was saved.
A Bloom filter over the keys of the living targets, of bounded size, proves most orphans without any join; only
the pointers that pass it are verified by an exact join.

Defined results
    null key: the pointer is not looked at; null ``since`` of a target: it was there from the start; pointing record
    unknown or its time null: only absence counts; empty parent table: every pointer is an orphan; repeated pointers
    come out once per identity; further columns of either side are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import wikilink as W
from quillspark.bloom import bloom_filter, might_contain
from quillspark.tables import cut, lookup, parallel, table

def find_orphans(pointers: DataFrame, parents: DataFrame, carriers: DataFrame, ident: list[str]) -> DataFrame:
    """Orphans among ``pointers(ident..., carrier, key)``.

    ``parents(key, since)`` are the living targets, ``carriers(carrier, as_of)`` the times of the pointing records.
    Returns ``ident...`` and ``reason`` (``absent`` or ``late``), one row per identity.
    """
    # read several times below; working out the keys is what costs: written once
    pointers = cut(pointers.select(*ident, "carrier", "key").filter(F.col("key").isNotNull()))
    parents = parents.filter(F.col("key").isNotNull()).select("key", "since")
    n = parents.count()
    maybe = might_contain(bloom_filter(parents, "key", n), F.col("key"))
    definite = pointers.filter(~maybe).select(*ident, F.lit("absent").alias("reason"))
    rest = pointers.filter(maybe)

    # one living target per key: the earliest; a target without a time was always there
    targets = parents.groupBy("key").agg(F.min(F.coalesce("since", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).alias("since"))
    # pointers to a hot target are spread over salts, so that no task gets them all
    met = lookup(rest.select(*ident, "carrier", "key"), "key", targets).select(*ident, "carrier", "since")
    times = carriers.filter(F.col("as_of").isNotNull()).groupBy("carrier").agg(F.max("as_of").alias("as_of"))
    # a target older than every pointing record cannot be late, so only the others have to meet their record's time
    doubtful = met.filter(F.col("since").isNull() | (F.col("since") > times.agg(F.min("as_of")).scalar()))
    verified = doubtful.join(times, "carrier", "left").filter(F.col("since").isNull() | (F.col("since") > F.col("as_of")))
    reason = F.when(F.col("since").isNull(), "absent").otherwise("late").alias("reason")
    return definite.unionByName(verified.select(*ident, reason)).dropDuplicates(ident)


# --- the project's pointers ---------------------------------------------------------------------------------------

def note_pointers(frontmatter: DataFrame) -> DataFrame:
    """Links in ``paper-translate`` and ``paper-analyze``: (note_id, field, pos, carrier, key)."""
    links = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("link")) for c in ("paper-translate", "paper-analyze")))
    rows = frontmatter.select("note_id", F.explode(links).alias("l")).select("note_id", "l.field", "l.link")
    return rows.filter(F.contains("link", F.lit("[["))).select(
        "note_id", "field", F.lit(0).alias("pos"), F.col("note_id").alias("carrier"), W.dash_key(W.page(F.col("link"))).alias("key")
    )


def reference_pointers(refs: DataFrame) -> DataFrame:
    """DOIs of the ``reference`` entries: (note_id, field, pos, carrier, key)."""
    return parallel(refs.filter(F.col("field") == "reference").select("note_id", "field", "pos", "raw")).select(
        "note_id", "field", F.col("pos").cast("int").alias("pos"), F.col("note_id").alias("carrier"), D.key_of_entry(F.col("raw")).alias("key")
    ).filter(F.col("key").isNotNull())


def project_orphans(notes: DataFrame, frontmatter: DataFrame, refs: DataFrame, works: DataFrame) -> DataFrame:
    """(note_id, field, pos, reason) of all pointers of the project whose target is absent, gone or late."""
    ident = ["note_id", "field", "pos"]
    carriers = notes.select(F.col("note_id").alias("carrier"), F.col("mtime").alias("as_of"))
    living_notes = notes.filter(F.col("trashed_at").isNull()).select(W.dash_key(F.col("stem")).alias("key"), F.col("created_at").alias("since"))
    living_works = works.filter(F.col("deleted_at").isNull()).select(F.lower("doi").alias("key"), F.col("first_seen").alias("since"))
    by_note = find_orphans(note_pointers(frontmatter), living_notes, carriers, ident)
    by_work = find_orphans(reference_pointers(refs), living_works, carriers, ident)
    return by_note.unionByName(by_work)


def p1_found(spark, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    return project_orphans(t("notes"), t("frontmatter"), t("refs"), t("works")).select("note_id", "field", "pos")


def p1_report(spark, sf_dir: str) -> DataFrame:
    """Pointers and orphans per target table and calendar month of the pointing note's ``mtime``."""
    t = lambda n: table(spark, sf_dir, n)
    notes, frontmatter, refs = t("notes"), t("frontmatter"), t("refs")
    ident = ["note_id", "field", "pos"]
    pointers = note_pointers(frontmatter).unionByName(reference_pointers(refs)).select(*ident, F.lit(0).alias("orphan"))
    orphans = project_orphans(notes, frontmatter, refs, t("works")).select(*ident, F.lit(1).alias("orphan"))
    each = pointers.unionByName(orphans).groupBy(*ident).agg(F.max("orphan").alias("orphan"))
    months = notes.groupBy("note_id").agg(F.date_format(F.max("mtime"), "yyyy-MM").alias("month"))
    # per note first, so that a note's row meets its month once
    per_note = each.groupBy("note_id", F.when(F.col("field") == "reference", "works").otherwise("notes").alias("target")).agg(
        F.count("*").alias("n_pointers"), F.sum("orphan").alias("n_orphans")
    )
    return per_note.join(months, "note_id").groupBy("target", "month").agg(
        F.sum("n_pointers").alias("n_pointers"), F.sum("n_orphans").alias("n_orphans")
    )
