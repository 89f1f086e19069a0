"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame expressions alone.

A ring of CELLS cells carries `nodes` points of each shard. A text's hash names its cell, so equal texts meet in one; the
arc that ends at the next point clockwise belongs to that point's shard. A shard takes its own arcs clockwise until it is
full; what overflows continues to the next point whose shard has room. Loads are exact: shares of the rows that differ by
at most one, or of the bytes.

The driver sees one load per arc, shards x nodes of them, whatever the data. A row finds its shard by its offset in its
arc: rows of an arc are ordered by a hash of their key and dealt by its leading bits into buckets, so that an arc which
holds a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, table, written

CELLS = 1 << 16
#: Each arc's rows are numbered in this many buckets.
BUCKETS = 256


@dataclass(frozen=True)
class Share:
    """Rows of an arc whose offset in it lies in [start, end) go to a shard."""

    arc: int
    start: int
    end: int
    shard: int


def points(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """arc, cell, shard: the points of all virtual nodes, numbered clockwise. A shard's points do not depend on how many
    shards there are."""
    node = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    placed = node.select(F.pmod(F.xxhash64(F.lit("point"), "shard", "node"), F.lit(CELLS)).cast("int").alias("cell"), "shard", "node")
    clockwise = Window.orderBy("cell", "shard", "node")  # as many rows as there are points
    return placed.select((F.row_number().over(clockwise) - 1).alias("arc"), "cell", "shard")


def arcs(ring: DataFrame) -> DataFrame:
    """cell, arc: the first point at or after each cell; behind the last point the ring begins again."""
    at = ring.groupBy("cell").agg(F.min("arc").alias("arc"))
    cells = ring.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(at, "cell", "left")
    following = F.min("arc").over(Window.orderBy(F.desc("cell")))  # CELLS rows
    return cells.select("cell", F.coalesce(following, F.lit(0)).alias("arc"))


def capacities(total: int, shards: int) -> list[int]:
    """Shares of a total that differ by at most one."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(owners: list[int], loads: list[int], room: list[int]) -> list[Share]:
    """Which offsets of each arc go where. owners and loads are those of the arcs, clockwise; room is what each shard may
    take, together no less than the loads."""
    room, out = list(room), []
    waiting = [[(arc, 0, load)] if load else [] for arc, load in enumerate(loads)]
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in owners]
        for place, parts in enumerate(waiting):
            shard = owners[place]
            for arc, start, end in parts:
                taken = min(room[shard], end - start)
                room[shard] -= taken
                if taken:
                    out.append(Share(arc, start, start + taken, shard))
                if start + taken < end:
                    moved[(place + 1) % len(owners)].append((arc, start + taken, end))
        waiting = moved
    return out


def shard_rows(
    docs: DataFrame, shards: int, load: str = "rows", key: str = "doc_id", text: str = "text", nodes: int = 64, buckets: int = BUCKETS
) -> DataFrame:
    """Per row of docs: key, size (UTF-8 bytes of the text plus 1; null is empty), text_crc32, shard, slot (gapless from 0
    in its shard).

    load "rows": counts differ by at most one. load "bytes": a shard takes rows until its share of the sizes is reached,
    so it exceeds or misses it by less than the largest row at either end of each of its runs. Equal texts are neighbours
    on the ring and share a shard unless it fills up among them. Equal rows are each placed; rows without a key, and extra
    columns, change nothing. An empty table gives no rows.
    """
    if load not in ("rows", "bytes"):
        raise ValueError(f"load is rows or bytes, not {load}")
    spark, whole = docs.sparkSession, F.coalesce(F.col(text), F.lit(""))
    ring = written(points(spark, shards, nodes), "ring")
    spin = F.xxhash64(F.lit("row"), key)
    rows = docs.select(
        F.col(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), spin.alias("spin"),
        F.pmod(F.xxhash64(F.lit("text"), whole), F.lit(CELLS)).cast("int").alias("cell"), F.pmod(F.shiftright(spin, 40), F.lit(buckets)).cast("int").alias("bucket"),
    )
    rows = rows.join(F.broadcast(arcs(ring)), "cell").drop("cell")  # CELLS rows of two numbers
    rows = written(rows, "ring_rows")
    weight = F.lit(1).cast("long") if load == "rows" else F.col("size")
    totals = rows.groupBy("arc", "bucket").agg(F.sum(weight).alias("load"))
    by_arc = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.withColumn("before", F.coalesce(F.sum("load").over(by_arc), F.lit(0))), "ring_loads")
    loads = {r.arc: r.load for r in totals.groupBy("arc").agg(F.sum("load").alias("load")).collect()}
    owners = [r.shard for r in ring.orderBy("arc").collect()]
    shares = deal(owners, [loads.get(a, 0) for a in range(len(owners))], capacities(sum(loads.values()), shards))
    offset = F.coalesce(F.sum(weight).over(_in_bucket("arc", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    placed = rows.join(totals.drop("load"), ["arc", "bucket"]).withColumn("offset", offset)
    parts = spark.createDataFrame([(s.arc, s.start, s.end, s.shard) for s in shares], "share_arc int, start long, end long, shard int")
    inside = (F.col("arc") == F.col("share_arc")) & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    placed = written(placed.join(F.broadcast(parts), inside).drop("share_arc", "start", "end", "before", "offset"), "ring_placed")  # an arc and the splits a shard can cause
    counts = placed.groupBy("shard", "arc", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("arc", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).drop("n")
    slot = F.col("first") + F.row_number().over(_in_bucket("shard", key)) - 1
    out = placed.join(counts, ["shard", "arc", "bucket"]).select(key, "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
    out = written(out, "sharded")
    discard(ring, rows, totals, placed)
    return out


def _in_bucket(first: str, key: str) -> Window:
    """A bucket's rows in an order that depends on the rows alone; rows equal in all of it are interchangeable."""
    names = ["arc", "bucket"] if first == "arc" else [first, "arc", "bucket"]
    return Window.partitionBy(*names).orderBy("spin", key, "size", "text_crc32")


def op12_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, whose counts are at most one apart. Where there are fewer rows or longer rows than
    usual nothing changes."""
    out = shard_rows(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
