"""Linking notes that belong together: a clipping and its translation, its analysis and its figures."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.functions import wikilink as W
from quillspark.tables import cut, frontmatter, notes, spread_join

THRESHOLD = Fraction(85, 100)
#: Near misses are looked for down to this similarity (a parameter of the search: the prefixes that are joined grow as it falls).
NEAR = Fraction(50, 100)
#: A link and its display part; what a link leads to.
LINK = r"\[\[([^|]+)\|([^\]]+)\]\]"
LINK_TARGET = r"\[\[\s*([^|\]]+)"
#: An item in more prefixes than this is spread over tasks.
PREFIX_LIMIT = 1000


def source_key(source: Column) -> Column:
    """A source address without its case, outer blanks and closing slashes; null for an empty one."""
    return F.nullif(F.rtrim(F.lower(D.strip_blanks(source)), F.lit("/")), F.lit(""))


def first_target(references: Column) -> Column:
    """Name of the first reference's link; null if it is no link."""
    return F.nullif(W.split(F.get(references, F.lit(0)))["name"], F.lit(""))


def doi_set(references: Column) -> Column:
    """All DOIs in the display part of an entry's link, wherever it stands in the entry, otherwise of the whole entry; case
    counts here."""
    def found(x: Column) -> Column:
        flat = F.replace(x, F.lit("\n"), F.lit(" "))
        return D.doi_all(F.coalesce(F.nullif(F.regexp_extract(flat, LINK, 2), F.lit("")), flat))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(references, lambda x: x.isNotNull()), found))))


def last_path(rows: DataFrame, key: str) -> DataFrame:
    """(key, target_id): of the rows with a key, the one whose path comes last."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("note_id", "path_parts").alias("target_id"))


def similar(left: DataFrame, right: DataFrame, threshold: Fraction) -> DataFrame:
    """(left_id, right_id, score): pairs of (id, items) whose sets have a Jaccard similarity of at least ``threshold``.

    Two similar sets share one of the rarest items of each, so only these are joined (prefix filter, rarest first); an
    item that is in a third of all sets is among them only in sets with nothing rarer, and its pairs are made in many tasks.
    Sizes that cannot match are left out, the rest is verified.
    """
    both = left.select(F.lit(0).alias("side"), "id", "items").unionByName(right.select(F.lit(1).alias("side"), "id", "items")).filter(F.size("items") > 0)
    rows = both.select("side", "id", F.size("items").alias("n"), F.explode("items").alias("item"))
    counts = rows.groupBy("item").agg(F.count("*").alias("df"))
    by_set = rows.join(counts, "item").groupBy("side", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("r"))
    t = F.lit(float(threshold))
    length = (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + 1).cast("int")
    # joined with itself and counted: written once
    prefix = cut(by_set.select("side", "id", "n", F.explode(F.slice("r", F.lit(1), length)).alias("x")).select("side", "id", "n", "x.item"))
    a = prefix.filter("side = 0").select("item", F.col("id").alias("left_id"), F.col("n").alias("n_left"))
    b = prefix.filter("side = 1").select("item", F.col("id").alias("right_id"), F.col("n").alias("n_right"))
    pairs = spread_join(a, b, "item", PREFIX_LIMIT).filter(F.least("n_left", "n_right") * threshold.denominator >= F.greatest("n_left", "n_right") * threshold.numerator).select("left_id", "right_id").distinct()
    met = pairs.join(left.select(F.col("id").alias("left_id"), F.col("items").alias("a")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("items").alias("b")), "right_id")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - F.col("shared")
    return met.withColumn("shared", shared).filter(F.col("shared") * threshold.denominator >= union * threshold.numerator).select("left_id", "right_id", F.round(F.col("shared") / union, 6).alias("score"))


def _rows(spark, sf_dir: str) -> DataFrame:
    """Notes with their front matter; clippings are those outside Chi and Claude, translations lie in Chi."""
    n = notes(spark, sf_dir).select("note_id", "path_parts", "stem", F.get("path_parts", F.lit(0)).alias("top"))
    m = frontmatter(spark, sf_dir).select("note_id", "source", "reference", "`paper-translate`", "`paper-analyze`", "`figure-extractor`")
    return n.join(m, "note_id")


def _clips(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("top") == "Clippings") & ~F.contains("stem", F.lit("zh-CN")))


def match_source(spark, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("key", source_key(F.col("source")))
    build = last_path(rows.filter("top = 'Chi'"), "key")
    return _clips(rows).join(build, "key").select("note_id", "target_id")


def match_first_ref(spark, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("key", first_target(F.col("reference")))
    build = last_path(rows.filter("top = 'Chi'"), "key")
    return _clips(rows).join(build, "key").select("note_id", "target_id")


def _scores(rows: DataFrame, clips: DataFrame, threshold: Fraction) -> DataFrame:
    sets = lambda x: x.select(F.col("note_id").alias("id"), doi_set(F.col("reference")).alias("items"))
    scored = similar(sets(clips), sets(rows.filter("top = 'Chi'")), threshold)
    return scored.join(rows.select(F.col("note_id").alias("right_id"), "path_parts"), "right_id")


def match_jaccard(spark, sf_dir: str) -> DataFrame:
    """The most similar translation of each clipping, at least 0.85; of equals the first path."""
    rows = _rows(spark, sf_dir)
    best = _scores(rows, _clips(rows), THRESHOLD).groupBy("left_id").agg(F.min_by(F.struct("right_id", "score"), F.struct(-F.col("score"), "path_parts")).alias("b"))
    return best.select(F.col("left_id").alias("note_id"), F.col("b.right_id").alias("target_id"), F.col("b.score").alias("score"))


def _cascade(rows: DataFrame) -> DataFrame:
    """(note_id, target_id, method): by source, else by first reference, else by similar sets, which is only worked out for
    the clippings that are left."""
    rows = cut(rows.withColumn("by_source", source_key(F.col("source"))).withColumn("by_first", first_target(F.col("reference"))))
    clips, chi = _clips(rows), rows.filter("top = 'Chi'")
    one = clips.join(last_path(chi, "by_source"), "by_source").select("note_id", "target_id", F.lit("source").alias("method"))
    left = clips.join(one.select("note_id"), "note_id", "left_anti")
    two = left.join(last_path(chi, "by_first"), "by_first").select("note_id", "target_id", F.lit("first reference").alias("method"))
    rest = left.join(two.select("note_id"), "note_id", "left_anti")
    best = _scores(rows, rest, THRESHOLD).groupBy("left_id").agg(F.min_by("right_id", F.struct(-F.col("score"), "path_parts")).alias("target_id"))
    three = best.select(F.col("left_id").alias("note_id"), "target_id", F.lit("similarity").alias("method"))
    return one.unionByName(two).unionByName(three)


def match_cascade(spark, sf_dir: str) -> DataFrame:
    """Counts of the clippings' link status per method. An existing link is kept; without one, a target is a match, none a
    failure."""
    rows = _rows(spark, sf_dir)
    found = _clips(rows).join(_cascade(rows), "note_id", "left")
    has = F.coalesce("`paper-translate`", F.lit("")) != ""
    status = F.when(has, "skipped").when(F.col("target_id").isNotNull(), "matched").otherwise("failed")
    return found.groupBy(status.alias("status"), F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n"))


def link_status(existing: Column, target_stem: Column, force: Column) -> Column:
    """An existing link stays unless it is to be overwritten by another target; without a target there is no match."""
    there = F.coalesce(existing, F.lit("")) != ""
    same = F.coalesce(F.trim(F.regexp_extract(existing, LINK_TARGET, 1)) == target_stem, F.lit(False))
    return F.when(there & (~force | target_stem.isNull() | same), "skipped").when(target_stem.isNull(), "failed").otherwise("matched")


def match_status(spark, sf_dir: str) -> DataFrame:
    """Counts of the clippings' link status per kind of link and method, without and with overwriting."""
    rows = _rows(spark, sf_dir)
    clips = _clips(rows).select("note_id", "stem", "`paper-translate`", "`paper-analyze`", "`figure-extractor`")
    translated = _cascade(rows).select("note_id", F.col("target_id").alias("t1"), "method")
    by_stem = match_stem(spark, sf_dir).select("note_id", F.col("analysis_id").alias("t2"), F.col("figures_id").alias("t3"))
    found = clips.join(translated, "note_id", "left").join(by_stem, "note_id", "left")
    kinds = F.array(
        F.struct(F.lit("translation").alias("kind"), F.col("`paper-translate`").alias("link"), F.col("t1").alias("target_id"), F.coalesce("method", F.lit("none")).alias("method")),
        *(F.struct(F.lit(k).alias("kind"), F.col(f"`{c}`").alias("link"), F.col(t).alias("target_id"), F.when(F.col(t).isNull(), "none").otherwise("stem").alias("method")) for k, c, t in (("analysis", "paper-analyze", "t2"), ("figures", "figure-extractor", "t3"))),
    )
    each = found.select(F.explode(kinds).alias("k")).select("k.*").withColumn("force", F.explode(F.array(F.lit(False), F.lit(True))))
    stems = rows.select(F.col("note_id").alias("target_id"), "stem")
    met = each.join(stems, "target_id", "left")
    return met.groupBy("kind", "force", link_status(F.col("link"), F.col("stem"), F.col("force")).alias("status"), "method").agg(F.count("*").alias("n"))


def match_near_miss(spark, sf_dir: str) -> DataFrame:
    """The three most similar translations (at least 0.5) of each clipping that no method links."""
    rows = _rows(spark, sf_dir)
    clips = _clips(rows).join(_cascade(rows).select("note_id"), "note_id", "left_anti")
    scored = _scores(rows, clips, NEAR)
    # Spark keeps three rows per clipping and task before the shuffle
    best = Window.partitionBy("left_id").orderBy(F.desc("score"), "path_parts", "right_id")
    top = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= 3)
    return top.select(F.col("left_id").alias("note_id"), "place", F.col("right_id").alias("target_id"), "score")


def match_stem(spark, sf_dir: str) -> DataFrame:
    """Analysis and figure notes of a clipping by its name with underscores."""
    rows = _rows(spark, sf_dir)
    claude = rows.filter("top = 'Claude'").select("note_id", "path_parts", "stem")
    figures = F.col("stem").endswith("_figures")
    analyses = last_path(claude.filter(~figures).withColumn("key", F.col("stem")), "key").withColumnRenamed("target_id", "analysis_id")
    drawn = last_path(claude.filter(figures).withColumn("key", F.regexp_replace("stem", "_figures$", "")), "key").withColumnRenamed("target_id", "figures_id")
    keyed = _clips(rows).select("note_id", F.replace("stem", F.lit(" "), F.lit("_")).alias("key"))
    return keyed.join(analyses, "key", "left").join(drawn, "key", "left").filter("analysis_id IS NOT NULL OR figures_id IS NOT NULL").select("note_id", "analysis_id", "figures_id")


QUERIES = {f.__name__: f for f in (match_source, match_first_ref, match_jaccard, match_cascade, match_status, match_near_miss, match_stem)}
