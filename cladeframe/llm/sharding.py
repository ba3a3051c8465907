"""Shards of nearly equal bytes: a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Capacities tried at once; each round of the search divides the range by this.
TRIED = 32


def _running(df: DataFrame, value: str, scratch: Scratch, name: str) -> tuple[DataFrame, list[int]]:
    """Write a sorted, range-partitioned table with the partition's number and the running sum of ``value``
    in it; and the total before each partition (one number each). Partition sums are all that is collected."""
    from pyspark import TaskContext

    schema = df.schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = pc.add(pc.cumulative_sum(b.column(value)), total)
            total = upto[-1].as_py() if len(b) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), upto], [*b.schema.names, "part", "upto"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    table = scratch.write(df.mapInArrow(add, f"{fields}, part int, upto long"), name)
    sums = {r[0]: r[1] for r in table.groupBy("part").agg(F.max("upto")).collect()}
    offsets, total = [], 0
    for p in range(max(sums, default=-1) + 1):
        offsets.append(total)
        total += sums.get(p, 0)
    return table, [*offsets, total]


def _lift(part: Column, offsets: list[int]) -> Column:
    """The total before a partition, as an array lookup."""
    return F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), part + 1)


def smallest_capacity(prefixes: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity at which taking groups greedily needs at most ``shards`` shards, and the
    totals at which the shards then end. ``prefixes`` has the running total ``upto`` after each group.

    The search is binary in spirit: each round tries ``TRIED`` capacities at once. One step of the greedy
    check finds, for all of them in one aggregation, the last group that still fits. Only those numbers
    reach the driver. As no group is above ``largest``, a step reads just a window of the prefixes.
    """

    def ends(capacities: list[int]) -> dict[int, list[int]]:
        at = {x: [0] for x in capacities}
        for _ in range(shards):
            reach = {x: a[-1] + x for x, a in at.items() if a[-1] < total}
            if not reach:
                break
            window = F.col("upto").between(min(reach.values()) - largest, max(reach.values()))
            row = prefixes.where(window).agg(*[F.max(F.when(F.col("upto") <= r, F.col("upto"))).alias(str(x)) for x, r in reach.items()]).first()
            for x in reach:
                at[x].append(max(row[str(x)] or 0, at[x][-1]))
        return at

    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    found = None
    while low < high or found is None:
        step = max(1, -(-(high - low) // (TRIED - 1)))
        tried = sorted({min(high, low + i * step) for i in range(TRIED)})
        at = ends(tried)
        k = next(i for i, x in enumerate(tried) if at[x][-1] == total)
        found = at[tried[k]][1:]
        high = tried[k]
        low = tried[k - 1] + 1 if k else high
    return high, found


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into shards of nearly equal bytes; equal texts stay together.

    A row's size is the UTF-8 bytes of its text plus 1. Rows of equal text (and all of null text) form
    a group, which is never cut. Groups are ordered by MD5 and length of the text, which mixes the
    corpus; shards are contiguous in this order and their largest is as small as can be. A group above
    an eighth of all bytes leaves its shard larger than the others.

    One row for each row of ``docs``: doc_id, size, text_crc32 (null for a null text), law, shard, slot
    (gapless within a shard, in the order of the group and doc_id), grown_shard (null). With fewer
    groups than shards some shards are empty. Repeated rows take slots of their own; an empty table
    gives no rows; other columns are not carried.

    Text is read once, into a slim table. It is then range-partitioned by (group, doc_id), so that a
    group of a third of all rows spreads over many tasks; groups are summed before they are shuffled.
    """
    spark, c = docs.sparkSession, F.col
    scratch = Scratch(spark, "sharding")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    slim = docs.select(c(id_col).alias("doc_id"), size.alias("size"), F.crc32(c(text_col).cast("binary")).alias("text_crc32"), F.coalesce(F.concat(F.md5(c(text_col).cast("binary")), F.lpad(F.hex(size), 16, "0")), F.lit("")).alias("grp"))
    slim = scratch.write(slim, "slim")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = slim.groupBy("grp").agg(F.sum("size").alias("bytes"))
    sizes, before = _running(groups.repartitionByRange(tasks, "grp").sortWithinPartitions("grp"), "bytes", scratch, "groups")
    total = before[-1]
    sizes = sizes.withColumn("upto", c("upto") + _lift(c("part"), before))
    largest = sizes.agg(F.max("bytes")).first()[0] or 0
    prefixes = sizes.select("upto")
    _, ends = smallest_capacity(prefixes, total, largest, shards) if total else (0, [])
    cuts = [r[0] for r in sizes.where(c("upto").isin(ends)).select("grp").orderBy("grp").collect()]
    shard = F.lit(len(cuts) - 1)
    for i in range(len(cuts) - 2, -1, -1):
        shard = F.when(c("grp") <= cuts[i], i).otherwise(shard)
    ordered = slim.withColumn("one", F.lit(1).cast("long")).repartitionByRange(tasks, "grp", "doc_id").sortWithinPartitions("grp", "doc_id")
    ranked, before = _running(ordered, "one", scratch, "ranked")
    ranked = ranked.withColumn("shard", shard.cast("int")).withColumn("rank", c("upto") + _lift(c("part"), before) - 1)
    counts = {r[0]: r[1] for r in ranked.groupBy("shard").count().collect()}
    starts = [sum(counts.get(j, 0) for j in range(i)) for i in range(shards)]
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (c("rank") - _lift(c("shard"), starts)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
