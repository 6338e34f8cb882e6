"""All similar pairs between set-valued records.

Two sets are similar if their Jaccard similarity reaches a threshold. Size-aware overlap join: for a pair of sizes
``(a, b)`` the threshold asks for an overlap of ``c(a, b)`` tokens. Small sets (those with few subsets of the sizes asked
for) are joined on their ``c``-sized subsets; pairs with a large set are found through inverted lists, read only for the
tokens of each set's prefix, rarest tokens first. The union of both is verified by the exact similarity.

Equal sets are collapsed into classes first, so a group of copies costs one set, however large it is.

Defined results
    null or empty set: takes no part; repeated tokens count once; a record delivered twice counts once; empty table: no
    rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import doi as D
from quillspark.tables import cut, parallel, spread_join, table

THRESHOLD = Fraction(85, 100)
#: A set is small if it has at most this many subsets of the sizes that its possible partners ask for.
MOST_SUBSETS = 40
#: Where rows of one key meet each other, a key with more rows than this is spread.
PAIR_LIMIT = 1000


def overlap(a: int, b: int, t: Fraction) -> int:
    """Least number of shared tokens of similar sets with ``a`` and ``b`` tokens."""
    return math.ceil(t * (a + b) / (1 + t))


def partners(a: int, t: Fraction) -> range:
    """Sizes of the sets that can be similar to one with ``a`` tokens."""
    return range(math.ceil(t * a), math.floor(a / t) + 1)


def meetings(a: int, t: Fraction) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, shared tokens) of each kind of pair that a set with ``a`` tokens can be in."""
    return [(min(a, b), max(a, b), overlap(a, b, t)) for b in partners(a, t) if overlap(a, b, t) <= min(a, b)]


def largest_small(t: Fraction, most: int = MOST_SUBSETS) -> int:
    """The largest size up to which every set is small."""
    a = 1
    while sum(math.comb(a + 1, c) for _, _, c in meetings(a + 1, t)) <= most:
        a += 1
    return a


def token_sets(entries: DataFrame, ident: str, tokens: Column) -> DataFrame:
    """(id, toks): distinct 64-bit token hashes of each record, sorted. Records without tokens are left out."""
    toks = F.array_sort(F.array_distinct(F.transform(F.filter(tokens, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    return entries.select(F.col(ident).alias("id"), toks.alias("toks")).filter(F.size("toks") > 0)


def classes(sets: DataFrame) -> DataFrame:
    """(class, toks, n): each distinct set once, its smallest identifier, and the number of records that have it."""
    # the digest is the key, so that the shuffle is by 16 bytes; min, first and the sketch-free count combine before it
    return (
        sets.groupBy(F.unhex(F.md5(F.to_json("toks").cast("binary"))).alias("fp"))
        .agg(F.min("id").alias("class"), F.any_value("toks").alias("toks"))
    )


_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _subset_keys(batches: Iterator[pa.RecordBatch], t: Fraction, small: int) -> Iterator[pa.RecordBatch]:
    """(key, role, class) of each subset that a small set is joined on.

    A key stands for the subset and the two sizes of the pair, so a list holds only sets of these two sizes, and two sets
    that meet on it as smaller (role 0) and larger (role 1) share enough tokens: the join makes no pair that is not
    similar.
    """
    memo: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for batch in batches:
        ids = batch.column("class").to_numpy(zero_copy_only=False)
        toks = batch.column("toks")
        sizes = toks.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        mixed = toks.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        mixed ^= mixed >> np.uint64(32)
        keys, roles, who = [], [], []
        for a in map(int, np.unique(sizes)):
            if a not in memo:
                memo[a] = [(lo, hi, np.array(list(combinations(range(a), c)))) for lo, hi, c in meetings(a, t) if hi <= small]
            rows = np.flatnonzero(sizes == a)
            at = mixed[starts[rows][:, None] + np.arange(a)]
            for lo, hi, combos in memo[a]:
                k = ((at[:, combos].sum(axis=2, dtype=np.uint64) ^ np.uint64(lo * 4096 + hi)) * _STEP).ravel()
                for role in ((0, 1) if lo == hi else (int(a == hi),)):
                    keys.append(k)
                    roles.append(np.full(len(k), role, np.int8))
                    who.append(np.repeat(ids[rows], len(combos)))
        if keys:
            columns = np.concatenate(keys).view(np.int64), np.concatenate(roles), np.concatenate(who)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int8()), pa.array(columns[2], pa.int64())], ["key", "role", "class"])


def similar_classes(distinct: DataFrame, t: Fraction = THRESHOLD, most: int = MOST_SUBSETS) -> DataFrame:
    """(a, b, shared, n_a, n_b): pairs of distinct sets with similarity of at least ``t``. ``distinct`` is (class, toks)."""
    small = largest_small(t, most)
    sized = distinct.withColumn("n", F.size("toks"))

    # small with small: on subsets
    keys = sized.filter(F.col("n") <= small).select("class", "toks").mapInArrow(lambda it: _subset_keys(it, t, small), "key long, role byte, class long")
    smaller = keys.filter(F.col("role") == 0).select("key", F.col("class").alias("x"))
    larger = keys.filter(F.col("role") == 1).select("key", F.col("class").alias("y"))
    by_subset = smaller.join(larger, "key").filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    # with a large set: inverted lists over prefixes; sets too small to be similar to any large one take no part
    least = math.ceil(t * (small + 1))
    listed = sized.filter(F.col("n") >= least)
    counts = listed.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    ranked = (
        listed.select("class", "n", F.explode("toks").alias("tok"))
        .join(counts, "tok")
        .groupBy("class", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("ranked"))
    )
    # two similar sets share a token among the first n - ceil(t * n) + 1 of each, in one common order
    length = (F.col("n") - F.ceil(F.col("n") * t.numerator / F.lit(float(t.denominator))) + 1).cast("int")
    # joined with itself and counted: written once
    prefixes = cut(ranked.select("class", "n", F.explode(F.slice("ranked", F.lit(1), length)).alias("r")).select("class", "n", F.col("r.tok").alias("key")))
    one, two = prefixes.select("key", F.col("class").alias("a"), F.col("n").alias("n_a")), prefixes.select("key", F.col("class").alias("b"), F.col("n").alias("n_b"))
    by_list = (
        # a token that stands in many prefixes is spread over tasks
        spread_join(one, two, "key", PAIR_LIMIT)
        .filter((F.col("a") < F.col("b")) & (F.greatest("n_a", "n_b") > small))
        .filter(F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator)
        .select("a", "b")
    )
    candidates = by_subset.unionByName(by_list).distinct()

    tokens = distinct.select("class", "toks")
    met = (
        candidates.join(tokens.select(F.col("class").alias("a"), F.col("toks").alias("toks_a")), "a")
        .join(tokens.select(F.col("class").alias("b"), F.col("toks").alias("toks_b")), "b")
    )
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    return (
        met.select("a", "b", shared.alias("shared"), F.size("toks_a").alias("n_a"), F.size("toks_b").alias("n_b"))
        .filter(F.col("shared") * t.denominator >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * t.numerator)
    )


def note_sets(frontmatter: DataFrame) -> DataFrame:
    """DOI sets of the notes, one row per note."""
    keys = F.transform("reference", lambda x: D.key_of_entry(x))
    return token_sets(parallel(frontmatter.select("note_id", "reference")), "note_id", keys).dropDuplicates(["id"])


def _membership(sets: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id, class): the class of each record."""
    fp = F.unhex(F.md5(F.to_json("toks").cast("binary"))).alias("fp")
    return sets.select("id", fp).join(distinct.select("fp", "class"), "fp").select("id", "class")


def p6_found(spark, sf_dir: str) -> DataFrame:
    sets = cut(note_sets(table(spark, sf_dir, "frontmatter")))
    distinct = cut(classes(sets))
    member = cut(_membership(sets, distinct))
    links = similar_classes(distinct).select("a", "b")
    # The pairs asked for are those of notes: links between classes meet the classes' members, and the members of a
    # class one another.
    # A class of many copies makes many pairs: its members are salted, so that no task makes them all.
    two = links.join(member.select(F.col("class").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("class").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    one = spread_join(member.select("class", F.col("id").alias("x")), member.select("class", F.col("id").alias("y")), "class", PAIR_LIMIT).filter(F.col("x") < F.col("y")).select("x", "y")
    return two.unionByName(one).select(F.least("x", "y").alias("note_id_a"), F.greatest("x", "y").alias("note_id_b"))


def p6_classes(spark, sf_dir: str) -> DataFrame:
    """One row per note: its class (smallest note with the same set), the notes in it, and the links of the class to
    other classes."""
    sets = cut(note_sets(table(spark, sf_dir, "frontmatter")))
    distinct = cut(classes(sets))
    links = similar_classes(distinct)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    member = _membership(sets, distinct)
    sizes = member.groupBy("class").agg(F.count("*").alias("n_same"))
    info = sizes.join(ends, "class", "left").select("class", "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return member.join(info, "class").select(F.col("id").alias("note_id"), F.col("class").alias("class_id"), "n_same", "n_links")
