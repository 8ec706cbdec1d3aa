"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has POINTS points; each shard has virtual nodes on it. A text's hash
is its key and names its point, so equal texts share one. A key goes to the
first virtual node clockwise whose shard isn't full. Shards hold equally many
rows, give or take one, so balance is guaranteed; only keys that overflow move
on. Which rows those are follows from the points' row counts alone: the driver
plans POINTS counts, never rows, and each row finds its place by its rank
within its point.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import small_frame, written

POINTS = 4096
VIRTUAL_NODES = 48
#: Parts that each point's rows are ranked in, so that a hot point isn't one task.
PARTS = 256


def ring(shards: int, points: int = POINTS, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise; they depend on the shard's number alone."""
    spot = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:8], "big") % points
    return sorted((spot(s, v), s) for s in range(shards) for v in range(nodes))


def plan(counts: dict[int, int], shards: int, points: int = POINTS, nodes: int = VIRTUAL_NODES) -> list[dict]:
    """Runs of ranks of each point and where they go: ``point, low, shard, slot`` (slot of the run's first row).

    Shards get the whole part of the mean, and as many as are left over one
    more, first by number. Points are filled in clockwise order; what
    overflows goes on clockwise to the next virtual node with room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    wheel = ring(shards, points, nodes)
    at, out = 0, []
    for point in sorted(counts):
        while at < len(wheel) and wheel[at][0] < point:
            at += 1
        low, step = 0, at
        while low < counts[point]:
            shard = wheel[step % len(wheel)][1]
            take = min(room[shard] - used[shard], counts[point] - low)
            if take:
                out.append({"point": point, "low": low, "shard": shard, "slot": used[shard]})
                used[shard] += take
                low += take
            step += 1
    return out


def hashed(text: Column, of: int) -> Column:
    """The first 32 bits of the MD5 digest, modulo ``of``."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % of).cast("int")


def shards(documents: DataFrame, count: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    Law: ``rows`` (counts of shards are at most one apart). ``size`` is the
    text's UTF-8 bytes plus 16; a null text has no bytes and crc 0, and shares
    the empty text's point. Slots count from 0 in each shard. Repeated rows are
    rows like others; an empty table gives an empty one.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    # texts are read once; a row without doc_id has a part by its place, as such rows' ranks among themselves don't matter
    loose = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        hashed(text, POINTS).alias("point"),
        F.when(F.col("doc_id").isNull(), loose).otherwise(hashed(F.col("doc_id").cast("string"), PARTS)).alias("part"),
    )
    rows = written(rows, "shards")
    parts = rows.groupBy("point", "part").agg(F.count("*").alias("n"))
    # POINTS rows at most, whatever the input
    counts = {r.point: r.n for r in parts.groupBy("point").agg(F.sum("n").alias("n")).collect()}
    runs = small_frame(spark, plan(counts, count), "point:int,low:bigint,shard:int,slot:bigint")
    runs = runs.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("low", "shard", "slot"))).alias("runs"))
    earlier = Window.partitionBy("point").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("point", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = base.join(F.broadcast(runs), "point")  # at most POINTS rows by construction
    within = Window.partitionBy("point", "part").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(within) - 1).join(base, ["point", "part"])
    rank = F.col("rank") + F.col("base")
    run = F.element_at(F.filter("runs", lambda r: r["low"] <= rank), -1)
    placed = placed.withColumn("run", run)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("run.shard").alias("shard"),
        (F.col("run.slot") + rank - F.col("run.low")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
