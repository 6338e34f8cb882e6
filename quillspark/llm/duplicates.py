"""Duplicates hidden by formatting differences.

Two records are copies if they consist of the same words and numbers, each equally often, whatever the letter case,
white space, punctuation, symbols and order of their parts. The canonical key of a record is the 128-bit digest of its
sorted folded words together with the columns within which copies count.

Copies of a key are collapsed with the smallest identifier as representative. Keys that are hot are found exactly by
counts that are combined before the shuffle; their members are salted and aggregated in two levels. All other keys take
one shuffle.

Defined results
    null text: never a copy; empty text or text without words: all such records of a group are copies of each other;
    a record delivered twice (same identifier): one record; ties: the smallest identifier; empty table: no rows; extra
    columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.tables import SALTS, Hot, cut, parallel, table

#: Words: runs of letters, marks and digits of any script.
WORD = r"[\p{L}\p{M}\p{N}]+"

def canonical_words(text: Column) -> Column:
    """The folded words of ``text``, sorted, each as often as it occurs."""
    # letters whose capital is that of another one, or two letters (the optimizer drops upper() within lower())
    folded = F.replace(F.translate(F.lower(text), "ςſıẞ", "σsiß"), F.lit("ß"), F.lit("ss"))
    return F.array_sort(F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1)))


def canonical_key(text: Column, *within: Column) -> Column:
    parts = [F.coalesce(w.cast("string"), F.lit("\x00")) for w in within]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts, F.array_join(canonical_words(text), " ")).cast("binary")))


def keyed(records: DataFrame, ident: str, text: str, within: list[str]) -> DataFrame:
    return parallel(records.filter(F.col(text).isNotNull() & F.col(ident).isNotNull()).select(ident, text, *within)).select(
        F.col(ident).alias("id"), canonical_key(F.col(text), *(F.col(w) for w in within)).alias("key")
    )


def copies(records: DataFrame, ident: str, text: str, within: list[str], limit: int | None = None) -> DataFrame:
    """(keep, id, n): each copy but the first of its group, the group's smallest identifier and its number of records.
    Keys with more than ``limit`` records are hot, however many records there are in all."""
    # 16 bytes and an identifier per record, read by each of the steps below: the keys are worked out once
    rows = cut(keyed(records, ident, text, within))
    hot = Hot(rows, "key", limit)
    is_hot = hot.test(F.col("key"))
    # Cold keys: one shuffle. A group holds no more identifiers than the limit.
    cold = (
        rows.filter(~is_hot)
        .groupBy("key")
        .agg(F.collect_set("id").alias("ids"))
        .filter(F.size("ids") > 1)
        .select(F.array_min("ids").alias("keep"), F.size("ids").cast("long").alias("n"), F.explode("ids").alias("id"))
    )
    if hot.n:
        # Hot keys: distinct members and their minimum per salt, then per key; the totals go back to each salt's members,
        # which never meet in one task. A cold key that the filter takes for a hot one fares the same.
        members = rows.filter(is_hot).select("key", "id", hot.salt(F.col("key"), F.col("id")).alias("salt")).distinct()
        level1 = members.groupBy("key", "salt").agg(F.min("id").alias("keep"), F.count("*").alias("n"))
        level2 = level1.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        warm = members.join(level2.withColumn("salt", hot.salts(F.col("key"))), ["key", "salt"]).select("keep", "n", "id")
        cold = cold.unionByName(warm)
    return cold.filter((F.col("n") > 1) & (F.col("id") != F.col("keep")))


def collapsed(records: DataFrame, ident: str, text: str, within: list[str]) -> DataFrame:
    """(keep, n_copies): one row for each record that stands for its group, and how many records the group has."""
    rows = keyed(records, ident, text, within)
    # Minimum and count need no members: two levels, the first one salted by the identifier so that repeats of one
    # identifier meet and no task gets all rows of a key.
    level1 = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("keep"), F.countDistinct("id").alias("n"))
    return level1.groupBy("key").agg(F.min("keep").alias("keep"), F.sum("n").alias("n_copies")).select("keep", "n_copies")


def p2_found(spark, sf_dir: str) -> DataFrame:
    rows = copies(table(spark, sf_dir, "refs"), "ref_id", "raw", ["note_id", "field"])
    return rows.select(F.col("keep").alias("keep_ref_id"), F.col("id").alias("ref_id"))


def p2_collapsed(spark, sf_dir: str) -> DataFrame:
    """Every entry once per note and list, with the number of times it stood there."""
    rows = collapsed(table(spark, sf_dir, "refs"), "ref_id", "raw", ["note_id", "field"])
    return rows.select(F.col("keep").alias("ref_id"), "n_copies")
