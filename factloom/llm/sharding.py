"""Sharding: minimax contiguous partition of ordered atomic groups.

Documents with equal texts form an atomic group; groups are ordered by a hash of the text.  The smallest capacity is
searched for at which cutting greedily along that order needs no more than the wanted number of shards; the groups are
cut there.

The groups never come to the driver.  It sees sums over ranges of the order: first of 4,096 equal ranges, then of parts
of only those ranges in which a cut can still lie.  Over known range ends, greedy cutting gives a lower and an upper
position for every cut, so a capacity is surely feasible, surely infeasible, or open; open ranges are divided 64-fold
until the smallest feasible capacity is known exactly.  Each round is one aggregation over (hash, size) rows and returns
at most a few thousand sums.

Defined results: a null text has no bytes and forms one group with no other text but null; an empty table gives an empty
result; repeated rows are each placed; slots of a shard count from 0 without gaps; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, durable

#: The order of groups is that of a hash shifted to 0 .. 2**62 - 1; so all bounds fit into a signed long.
BITS = 62
_FIRST, _STEP = 12, 6


def _greedy(ends: list[int], sums: list[int], whole: list[bool], capacity: int, shards: int) -> tuple[list[tuple[int, int]], bool, bool]:
    """(lowest, highest) position of each cut, and whether capacity surely or possibly suffices.

    ends: known positions in the order; sums[i]: size of all groups before ends[i]; whole[i]: the range from ends[i] to
    ends[i + 1] holds one group at most, so no cut lies inside it.
    """
    total, low, high, cuts = sums[-1], 0, 0, []
    for _ in range(shards):
        i = bisect_right(sums, low + capacity) - 1
        low = max(low, sums[i])
        i = bisect_right(sums, high + capacity) - 1
        high = sums[i] if i + 1 >= len(sums) or whole[i] else min(sums[i + 1] - 1, high + capacity)
        cuts.append((low, high))
    return cuts, low >= total, high >= total


def cut_points(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Positions (62-bit hashes) at which shards 1 .. shards - 1 start, and the smallest capacity.

    groups: columns ``at`` (long, 0 .. 2**62 - 1) and ``size`` (long); rows of equal ``at`` belong to one group.
    """
    width = BITS - _FIRST
    rows = groups.groupBy(F.shiftright("at", width).alias("part")).agg(F.sum("size").alias("size"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    known = sorted((r.part << width, width, r.size, r.lo == r.hi) for r in rows)
    while True:
        ends, sums, whole, total = [], [0], [], 0
        for start, w, size, one in known:
            ends.append(start)
            whole.append(one)
            total += size
            sums.append(total)
        whole.append(True)
        if not total:
            return [], 0

        def smallest(sure: bool) -> int:
            lo, hi = max(1, -(-total // shards)), total
            while lo < hi:
                mid = (lo + hi) // 2
                ok = _greedy(ends, sums, whole, mid, shards)
                lo, hi = (lo, mid) if ok[1 if sure else 2] else (mid + 1, hi)
            return lo

        least, most = smallest(False), smallest(True)
        low, high = _greedy(ends, sums, whole, least, shards)[0], _greedy(ends, sums, whole, most, shards)[0]
        open_ = set()
        if least < most:
            for (a, _), (_, b) in zip(low, high, strict=True):
                for i in range(max(0, bisect_right(sums, a) - 1), min(len(known), bisect_left(sums, b + 1) + 1)):
                    if not whole[i]:
                        open_.add(i)
        if not open_:
            break
        split = [(known[i][0], max(0, known[i][1] - _STEP)) for i in sorted(open_)]
        by_width: dict[int, list[int]] = {}
        for i in sorted(open_):
            by_width.setdefault(known[i][1], []).append(known[i][0])
        found: dict[int, list] = {start: [] for start, _ in split}
        for w, starts in by_width.items():
            finer = max(0, w - _STEP)
            part = F.shiftright("at", w)
            some = groups.where(part.isin([s >> w for s in starts]))
            for r in some.groupBy(F.shiftright("at", finer).alias("part")).agg(F.sum("size").alias("size"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect():
                start = r.part << finer
                found[(start >> w) << w].append((start, finer, r.size, r.lo == r.hi))
        known = sorted([k for i, k in enumerate(known) if i not in open_] + [x for v in found.values() for x in v])
    cuts, position = [], 0
    for _ in range(shards - 1):
        i = bisect_right(sums, position + most) - 1
        position = sums[i]
        cuts.append(ends[i] if i < len(ends) else 1 << BITS)
    return cuts, most


def shard_texts(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row: equal texts share a shard and the largest shard is as small as can be."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text, text.isNull()), 64 - BITS).alias("at"),
    )
    rows = durable(rows, "shard-rows")
    groups = durable(rows.groupBy("at").agg(F.sum("size").alias("size")), "shard-groups")
    cuts, _ = cut_points(groups, shards)
    drop(groups)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("at") >= F.lit(cut).cast("long")).cast("int")
    # slots: rows are numbered inside many small cells of a shard, and cells get offsets from their counts
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64(F.col(id_col), F.col("at"), F.lit(3)), F.lit(cells)).cast("int").alias("cell"))
    per_cell = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_cell.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(id_col, "at"))
    numbered = placed.withColumn("rank", rank)
    # offsets: one row per cell, at most shards * cells rows whatever the input
    return numbered.join(F.broadcast(offsets), ["shard", "cell"]).select(id_col, "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; equal texts stay together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_texts(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
