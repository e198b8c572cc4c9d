"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a ring of 2^52 positions. A key belongs to the arc
that ends at the next point clockwise; a shard that is full passes the keys that no
longer fit on to the next points clockwise, until one of a shard with room is met. The
room of a shard is its exact share of the rows, so counts differ by one at most.

The walk itself needs no rows: it runs over how many keys each arc has (shards x vnodes
numbers, a fixed bound), and says which ranks of an arc go to which shard.
Rows alike in doc_id and text are counted first, and rank as one with many places. Within an arc, keys rank by a hash of
the whole row, in `SUBCELLS` parts, so that neither a repeated doc_id nor copies of a text nor equal rows meet in one task.

Edge cases: a null doc_id is a key like any other; a null text has size 1 and the crc32
of the empty text; equal rows are interchangeable, each takes a place of its own; an
empty table gives no rows; columns beyond doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import copies, rows_of
from lamella.tables import read, stored

POSITIONS = 52
CELL_BITS = 12
SUBCELLS = 64


def ring_arcs(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """arc (clockwise from 0), shard, and the half-open range of positions [lo, hi) of each; arc 0 has two."""
    points = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.conv(F.substring(F.md5(F.concat_ws("/", F.col("id") % shards, F.floor(F.col("id") / shards)).cast("binary")), 1, POSITIONS // 4), 16, 10).cast("long").alias("at"),
    )
    clockwise = Window.orderBy("at", "shard")  # shards x vnodes rows, however large the input
    arcs = points.select(
        (F.row_number().over(clockwise) - 1).cast("int").alias("arc"),
        "shard",
        (F.coalesce(F.lag("at").over(clockwise), F.lit(-1)) + 1).alias("lo"),
        (F.col("at") + 1).alias("hi"),
    )
    end = F.max("hi").over(Window.orderBy("hi").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wrapped = arcs.withColumn("lo", end).filter("arc = 0").withColumn("hi", F.lit(1 << POSITIONS))
    return arcs.unionByName(wrapped)


def walk(totals: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, shard, first rank, end rank, first slot) after all keys have found room."""
    room, used, out = list(room), [0] * len(room), []

    def put(arc: int, shard: int, lo: int, n: int) -> None:
        if n:
            out.append((arc, shard, lo, lo + n, used[shard]))
            used[shard] += n
            room[shard] -= n

    over = []
    for arc, n in enumerate(totals):
        fits = min(n, room[owners[arc]])
        put(arc, owners[arc], 0, fits)
        over.append((arc, fits, n - fits))
    carried: list[list[int]] = []
    for lap in range(2):
        for arc, shard in enumerate(owners):
            while carried and room[shard]:
                head = carried[0]
                fits = min(head[2], room[shard])
                put(head[0], shard, head[1], fits)
                head[1], head[2] = head[1] + fits, head[2] - fits
                if not head[2]:
                    carried.pop(0)
            if lap == 0 and over[arc][2]:
                carried.append(list(over[arc]))
    return out


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the row's place in its shard, from 0) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64("doc_id").bitwiseAND(F.lit((1 << POSITIONS) - 1)).alias("at"),
    ).withColumn("prio", F.xxhash64("doc_id", "text_crc32", "size"))
    keyed = keyed.withColumn("cell", F.shiftright("at", POSITIONS - CELL_BITS))
    arcs = stored(ring_arcs(spark, shards, vnodes))
    cells = arcs.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", POSITIONS - CELL_BITS), F.shiftright(F.col("hi") - 1, POSITIONS - CELL_BITS))))
    cells = F.broadcast(cells.drop("shard"))  # 2^CELL_BITS + shards x vnodes + 1 rows at most
    keyed = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    on_arc = keyed.join(cells, (keyed.cell == cells.cell) & (keyed["at"] >= cells.lo) & (keyed["at"] < cells.hi)).select(
        "doc_id", "size", "text_crc32", "prio", "n", "arc", F.pmod("prio", F.lit(SUBCELLS)).cast("int").alias("sub")
    )
    counts = stored(on_arc.groupBy("arc", "sub").agg(F.sum("n").alias("n")))
    totals = [0] * (shards * vnodes)
    for row in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # shards x vnodes rows at most
        totals[row.arc] = row.n
    owners = [row.shard for row in arcs.select("arc", "shard").distinct().orderBy("arc").collect()]
    each, more = divmod(sum(totals), shards)
    plan = walk(totals, owners, [each + (shard < more) for shard in range(shards)])
    ranges = F.broadcast(rows_of(spark, plan, "arc int, shard int, lo long, hi long, first long").withColumnRenamed("arc", "of"))
    before = Window.partitionBy("arc").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("arc", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))  # shards x vnodes x SUBCELLS rows at most
    order = Window.partitionBy("arc", "sub").orderBy("prio", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = on_arc.withColumn("place", F.coalesce(F.sum("n").over(order), F.lit(0))).join(offsets, ["arc", "sub"])
    ranked = copies(ranked, "n", "copy").withColumn("rank", F.col("place") + F.col("offset") + F.col("copy"))
    return ranked.join(ranges, (ranked.arc == ranges["of"]) & (ranked["rank"] >= ranges.lo) & (ranked["rank"] < ranges.hi)).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `rows`: counts are one apart at most."""
    return shard_rows(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
