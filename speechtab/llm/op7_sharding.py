"""Sharding by longest-processing-time scheduling.

Documents of equal text form a group that stays together. Groups go, from the heaviest to the lightest, to the shard
with the least load, taken from a heap. Groups of one weight are interchangeable, so what is scheduled are the distinct
weights, each with its number of groups. Weights are exact, at every size: the loads are those of one heap step per
group. Steps that are many at once (more than two per shard at one weight) are counted in whole numbers rather than
taken singly, to the same result.

Bounds: k distinct weights add up to k * (k + 1) / 2 at least, so S bytes have at most sqrt(2 * S) of them (245,000 at
30 GB, 14 million at 100 TB). These rows of two numbers, not the groups, are sorted for one task, which streams them and
keeps one load per shard. Ranks and slots are numbered in two levels, by hash bucket and within it, so no task holds a
whole weight, shard or group. Repeated rows are counted before they are shuffled and numbered in pieces of at most
``PIECE``.

Null text counts as the empty text (size 1). Repeated rows are rows of their own, with slots of their own; an empty
table gives an empty result. Of the input's columns only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechtab.llm.common import crc32_utf8, materialize, partitions

#: Rows of one doc_id and text that are numbered as one.
PIECE = 10_000


def many_steps(loads: list[int], w: int, n: int) -> list[int]:
    """How many of ``n`` groups of weight ``w`` each shard gets, by the rule of one heap step per group.

    Shard i's steps start at loads[i], loads[i] + w, loads[i] + 2 * w, ...; the n least of all of these are taken, by
    shard number where they tie.
    """
    below = lambda level: [max(0, -((x - level) // w)) for x in loads]
    low, high = min(loads), max(loads) + 1
    if sum(below(high - 1)) <= n:
        low = high - 1  # every shard comes to within one weight of the highest, and then they take turns
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
    take = below(low)
    turns, rest = divmod(n - sum(take), len(loads))
    if low < max(loads):  # the steps at exactly ``low`` are more than are left
        turns, rest = 0, n - sum(take)
    for i, _ in sorted(enumerate(loads), key=lambda x: (x[1] + take[x[0]] * w, x[0]))[:rest]:
        take[i] += 1
    return [k + turns for k in take]


def schedule(classes: Iterator[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """LPT over (weight, groups), the heaviest first; weights are whole numbers over 0.

    Gives for each weight the upper rank bound of each shard: ranks below bound 0 go to shard 0, and so on.
    """
    heap = [(0, i) for i in range(shards)]
    for w, n in classes:
        take = [0] * shards
        if n > 2 * shards:
            loads = [x for x, _ in sorted(heap, key=lambda s: s[1])]
            take = many_steps(loads, w, n)
            heap = [(x + w * k, i) for i, (x, k) in enumerate(zip(loads, take, strict=True))]
            heapq.heapify(heap)
        else:
            for _ in range(n):
                x, i = heap[0]
                take[i] += 1
                heapq.heapreplace(heap, (x + w, i))
        bounds, so_far = [], 0
        for k in take:
            so_far += k
            bounds.append(so_far)
        yield w, bounds


def scheduled(weights: DataFrame, shards: int) -> DataFrame:
    """weight, bounds (see ``schedule``) of every row of ``weights`` (weight, groups), distinct weights over 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        part: list[tuple[int, list[int]]] = []
        for found in schedule(rows, shards):
            part.append(found)
            if len(part) == 4096:
                yield record(part)
                part = []
        if part:
            yield record(part)

    def record(part: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        w, bounds = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(bounds, pa.list_(pa.int64()))], ["weight", "bounds"])

    one = weights.select("weight", "groups").repartition(1).sortWithinPartitions(F.desc("weight"))
    return one.mapInArrow(run, "weight long, bounds array<long>")


def numbered(df: DataFrame, keys: list[str], order: list[str], buckets: int, name: str, count: str | None = None) -> DataFrame:
    """Adds ``name``: gapless from 0 within ``keys``, counted by hash bucket of ``order`` first, then by ``order``.

    A row takes as many numbers as its column ``count`` says (default 1), of which ``name`` is the first.
    """
    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("_k", F.col(count) if count else F.lit(1))
    cells = df.groupBy(*keys, "_b").agg(F.sum("_k").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_rn", F.coalesce(F.sum("_k").over(within), F.lit(0)))
        .join(cells, [*keys, "_b"])
        .withColumn(name, F.col("_off") + F.col("_rn"))
        .drop("_b", "_k", "_rn", "_off")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc32_utf8(F.col("text")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("g"),
    )
    base = materialize(rows.groupBy("doc_id", "size", "text_crc32", "g").agg(F.count("*").alias("copies")), "sharding")
    groups = base.groupBy("g").agg(F.sum(F.col("size") * F.col("copies")).alias("weight"))
    groups = materialize(groups, "groups")
    weights = groups.groupBy("weight").agg(F.count("*").alias("groups"))
    plan = materialize(scheduled(weights, shards), "schedule")
    total = base.agg(F.sum("copies")).first()[0] or 0
    buckets = max(16, partitions(spark), total // (shards * 100_000))
    ranked = numbered(groups, ["weight"], ["g"], buckets, "rank").join(plan, "weight")
    placed = ranked.select("g", F.size(F.filter("bounds", lambda b: b <= F.col("rank"))).alias("shard"))
    pieces = base.join(placed, "g").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long"))))
    pieces = pieces.withColumn("rows", F.least(F.lit(PIECE), F.col("copies") - F.col("piece")))
    slots = numbered(pieces, ["shard"], ["doc_id", "g", "piece"], buckets, "first", "rows")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("rows") - 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
