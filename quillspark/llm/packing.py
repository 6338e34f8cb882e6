"""Filling fixed-capacity containers with items, by exact-complement hashing.

Only how many items have each length matters for the plan, and no length above the capacity remains once longer items
are cut: the plan is made from a histogram with at most ``capacity`` entries, whatever the number of items. Lengths that
fill a container exactly, alone, as pairs or as triples, are taken first, as often as both, or all three, are there; what
is left goes best fit, longest first, in bulk. Each step uses up at least one length or one kind of gap, so the plan is
short. Items find their places by their rank among the items of their length; ranks are counted per partition and then
shifted, so that no task gets all items of a length.

Defined results
    an item longer than the capacity fills whole containers and leaves its rest, the only items that are cut; an item of
    length 0 or with null text takes no room and lies in container 0; equal lengths: by partition and order; no items: no
    rows; items delivered twice are two items; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.encoding import VOCABULARY, encoder
from quillspark.tables import cut, parallel, table

#: containers made alike: how many, and how many items of each length in one
Kind = tuple[int, tuple[tuple[int, int], ...]]


def exact_fills(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Containers that single lengths, pairs and triples fill exactly; takes their items out of ``counts``."""
    kinds: list[Kind] = []
    if counts[capacity]:
        kinds.append((int(counts[capacity]), ((capacity, 1),)))
        counts[capacity] = 0
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        b = capacity - a
        n = int(counts[a] // 2 if a == b else min(counts[a], counts[b]))
        if n:
            kinds.append((n, ((a, 2),) if a == b else ((a, 1), (b, 1))))
            counts[a] -= n
            counts[b] -= n
    for a in range(capacity - 2, 0, -1):
        gap = capacity - a
        if 3 * a < capacity:
            break
        while counts[a]:
            # complements of the gap: index b against gap - b, both at hand
            b = np.arange((gap + 1) // 2, min(a, gap - 1) + 1)
            b = b[(counts[b] > 0) & (counts[gap - b] > 0)]
            fill = next((f for f in (_triple(counts, a, int(x), int(gap - x)) for x in b[::-1]) if f), None)
            if fill is None:
                break
            kinds.append(fill)
    return kinds


def _triple(counts: np.ndarray, *lengths: int) -> Kind | None:
    """As many containers with these three lengths as there are items for."""
    each: dict[int, int] = defaultdict(int)
    for x in lengths:
        each[x] += 1
    n = min(int(counts[x]) // k for x, k in each.items())
    if not n:
        return None
    for x, k in each.items():
        counts[x] -= n * k
    return n, tuple(each.items())


def best_fit(counts: np.ndarray, capacity: int) -> list[Kind]:
    """Best fit, longest first, for all items left in ``counts``; alike containers are filled together."""
    groups: dict[int, list[list]] = defaultdict(list)  # gap: [how many, content]
    gaps: list[int] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                n, content = groups[gap].pop()
                if not groups[gap]:
                    gaps.pop(at)
            else:
                gap, content = capacity, {}
                n = max(1, left // (capacity // length))
            each = min(gap // length, left)
            full = min(n, left // each)
            for many, rest, more in ((full, gap - each * length, each), (n - full, gap, 0)):
                if many:
                    if rest not in groups or not groups[rest]:
                        insort(gaps, rest)
                    groups[rest].append([many, content | {length: content.get(length, 0) + more} if more else content])
            left -= full * each
        counts[length] = 0
    return [(n, tuple(content.items())) for kinds in groups.values() for n, content in kinds]


def plan(histogram: dict[int, int], capacity: int) -> list[Kind]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    counts[0] = 0
    return exact_fills(counts, capacity) + best_fit(counts, capacity)


def places(kinds: list[Kind]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first container, items of the length in each), and the number of containers."""
    out, taken, base = [], defaultdict(int), 0
    for n, content in kinds:
        for length, each in content:
            lo = taken[length]
            taken[length] = lo + n * each
            out.append((length, lo, lo + n * each, base, each))
        base += n
    return out, base


def _measured(documents: DataFrame, capacities: list[int], ident: str, text: str, vocabulary: str) -> DataFrame:
    """(part, doc_id, n, and for each capacity: rank among its partition's rests of equal length, full containers before
    it in its partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        seen = [np.zeros(c + 1, np.int64) for c in capacities]
        whole = [0] * len(capacities)
        for batch in batches:
            n = np.diff(enc.encode_column(batch.column(1))[0])
            ranks, before = [], []
            for i, c in enumerate(capacities):
                rest, full = np.where(n > c, n % c, n), np.where(n > c, n // c, 0)
                order = np.argsort(rest, kind="stable")
                ordered = rest[order]
                first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
                start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(ordered)) - start + seen[i][ordered]
                np.add.at(seen[i], rest, 1)
                total = np.cumsum(full)
                ranks.append(rank)
                before.append(whole[i] + total - full)
                whole[i] += int(total[-1]) if len(total) else 0
            columns = [pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(n)]
            for x in (ranks, before):
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(capacities), pa.int32()), pa.array(np.stack(x, 1).ravel())))
            yield pa.RecordBatch.from_arrays(columns, ["part", "ident", "n", "ranks", "before"])

    kind = documents.schema[ident].dataType.simpleString()
    return parallel(documents.select(ident, text)).mapInArrow(run, f"part int, ident {kind}, n long, ranks array<long>, before array<long>")


def packed(documents: DataFrame, packs: list[tuple[str, int]], ident: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(pack, capacity, container, ident, piece, n_tokens) of each piece of each document, for each pack.

    ``packs`` are the container sizes, a short list.
    """
    packs = [(p, c) for p, c in packs if p is not None and c and c > 0]
    spark = documents.sparkSession
    items = cut(_measured(documents, [c for _, c in packs], ident, text, vocabulary))
    choice = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("pack"), F.lit(c).alias("capacity")) for i, (p, c) in enumerate(packs)))
    each = items.select("part", "ident", "n", F.explode(choice).alias("k"), "ranks", "before").select(
        "part", "ident", "n", "k.i", "k.pack", "k.capacity", F.get("ranks", F.col("k.i")).alias("rank"), F.get("before", F.col("k.i")).alias("before")
    )
    full = F.when(F.col("n") > F.col("capacity"), F.expr("n div capacity")).otherwise(0).cast("long")
    each = each.withColumn("full", full).withColumn("rest", F.col("n") - F.col("full") * F.col("capacity"))

    # histogram per partition, shifted: the items of a length in the partitions before
    local = each.groupBy("i", "part", "rest").agg(F.count("*").alias("items"), F.sum("full").alias("full"))
    local = cut(local)
    histogram: list[dict[int, int]] = [{} for _ in packs]
    for i, rest, n in local.groupBy("i", "rest").agg(F.sum("items")).collect():  # at most capacity + 1 rows per pack
        histogram[i][rest] = n
    rows, containers = [], []
    for i, (_, c) in enumerate(packs):
        own, n = places(plan(histogram[i], c))
        rows += [(i, *x) for x in own]
        containers.append(n)
    # one row per length, with the ranges of its ranks: bounded by the capacities
    ranges: dict[tuple[int, int], list[tuple[int, int, int, int]]] = defaultdict(list)
    for i, rest, *x in rows:
        ranges[i, rest].append(tuple(x))
    at = spark.createDataFrame([(i, rest, sorted(x)) for (i, rest), x in ranges.items()], "i int, rest long, ranges array<struct<lo: long, hi: long, base: long, each_holds: long>>")
    w = Window.partitionBy("i", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = local.select("i", "part", "rest", F.coalesce(F.sum("items").over(w), F.lit(0)).alias("shift"))
    per_part = local.groupBy("i", "part").agg(F.sum("full").alias("full"))
    v = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_shift = per_part.select("i", "part", F.coalesce(F.sum("full").over(v), F.lit(0)).alias("full_shift"))

    rests = (
        each.filter(F.col("rest") > 0)
        .join(shift, ["i", "part", "rest"])
        .withColumn("r", F.col("rank") + F.col("shift"))
        .join(F.broadcast(at), ["i", "rest"])
        .withColumn("in", F.get(F.filter("ranges", lambda x: (F.col("r") >= x["lo"]) & (F.col("r") < x["hi"])), F.lit(0)))
        .select("*", "in.*")
        .select("pack", "capacity", (F.col("base") + F.expr("(r - lo) div each_holds")).alias("container"), "ident", F.col("full").cast("int").alias("piece"), F.col("rest").cast("int").alias("n_tokens"))
    )
    first = F.array(*(F.lit(int(n)) for n in containers))
    whole = (
        each.filter(F.col("full") > 0)
        .join(full_shift, ["i", "part"])
        .select("pack", "capacity", "ident", (F.get(first, F.col("i")) + F.col("full_shift") + F.col("before")).cast("long").alias("start"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
        .select("pack", "capacity", (F.col("start") + F.col("piece")).alias("container"), "ident", "piece", F.col("capacity").cast("int").alias("n_tokens"))
    )
    nothing = each.filter(F.col("n") == 0).select("pack", "capacity", F.lit(0).cast("long").alias("container"), "ident", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"))
    return rests.unionByName(whole).unionByName(nothing).withColumnRenamed("ident", ident)


def _packs(spark, sf_dir: str) -> list[tuple[str, int]]:
    return [(r.pack, r.capacity) for r in table(spark, sf_dir, "pack_sizes").select("pack", "capacity").distinct().orderBy("capacity", "pack").collect()]


def p8_packed(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), _packs(spark, sf_dir))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """Per pack: containers, tokens, room left over, and the least number of containers that any packing needs."""
    rows = p8_packed(spark, sf_dir)
    return rows.groupBy("pack", "capacity").agg(F.max("container").alias("last"), F.sum("n_tokens").alias("tokens")).select(
        "pack", "capacity", (F.col("last") + 1).alias("containers"), "tokens",
        ((F.col("last") + 1) * F.col("capacity") - F.col("tokens")).alias("left_over"),
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
    )


def p8_sound(spark, sf_dir: str) -> DataFrame:
    """Per pack, what every packing must keep: the documents in it, containers that hold too much, documents that were cut though
    they fit, and pieces that stand in two containers."""
    rows = p8_packed(spark, sf_dir)
    fill = rows.groupBy("pack", "capacity", "container").agg(F.sum("n_tokens").alias("n")).groupBy("pack").agg(F.count_if(F.col("n") > F.col("capacity")).alias("n_overfull"))
    pieces = rows.groupBy("pack", "capacity", "doc_id").agg(F.count("*").alias("k"), F.countDistinct("piece").alias("d"), F.sum("n_tokens").alias("n"))
    kept = pieces.groupBy("pack").agg(F.count("*").alias("n_documents"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("capacity"))).alias("n_cut"), F.count_if(F.col("k") != F.col("d")).alias("n_twice"))
    return kept.join(fill, "pack")
