"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has ``RING_SLOTS`` slots. Every shard stands on it ``nodes`` times, at hashes of (shard, number). A row stands at
the hash of its id and belongs to the next node clockwise; if that shard is full, to the next one that has room, and so
on round the ring. Rows come in ring order, so the result is that of inserting them one by one in that order.

No row is compared with another for that. The rows between two nodes (an arc) share their way round the ring, so one sum
for each arc, shards * nodes numbers whatever the size of the table, settles how much of each arc goes to which shard.
Rows then find their place in the arc from the sums of ranges of the ring, which are so fine that each holds a bounded
number of rows. Ranges that one id fills beyond that are split by row number.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evitrust.llm.storage import written

RING_BITS = 16
NODES = 128                   # virtual nodes of a shard
ROWS_PER_RANGE = 20_000       # rows of a ring range that one task numbers, about


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null, and 8 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def ring(spark: SparkSession, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise. Nodes of one slot stand in order of their hashes."""
    place = F.xxhash64(F.lit("node"), "shard", "number")
    rows = (spark.range(shards * nodes).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("number"))
            .select(F.shiftrightunsigned(place, 64 - RING_BITS).alias("slot"), place.alias("place"), "shard").collect())
    return [(r.slot, r.shard) for r in sorted(rows)]


def fill(nodes: list[tuple[int, int]], load: dict[int, int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc (named by the node at its end), the shards that take it one after the other, and how much each takes.

    ``room`` is what each shard can take. An arc that finds no shard with room left goes to its own shard.
    """
    n, room = len(nodes), list(room)
    after = list(range(n))                       # the first node from here on whose shard may have room

    def with_room(i: int) -> int | None:
        way = []
        for _ in range(n + 1):
            if room[nodes[i][1]] > 0:
                break
            way.append(i)
            i = after[i] if after[i] != i else (i + 1) % n
        else:
            return None
        for j in way:
            after[j] = i
        return i

    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for arc in range(n):
        left = load.get(arc, 0)
        while left:
            i = with_room(arc)
            shard = nodes[arc if i is None else i][1]
            part = left if i is None else min(left, room[shard])
            room[shard] -= part
            left -= part
            out[arc].append((shard, part))
    return out


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from the driver, as an expression on one row."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shard(docs: DataFrame, shards: int, by: str = "rows", slack: float = 0.0, nodes: int = NODES, id_col: str = "doc_id",
          text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    ``by="rows"``: a shard takes at most ceil((1 + slack) * rows / shards) rows; with slack 0 exactly the floor or the
    ceiling of that, so that counts are at most one apart. ``by="bytes"``: a shard is full once it holds
    (1 + slack) * bytes / shards, and the row that fills it may go beyond. The id alone gives a row its place on the
    ring; equal texts are not kept together. Rows with one id (or a null id) stand at one place and spread clockwise like
    any others once a shard is full; which of several rows with equal id and text takes which slot is left open. Null
    text has size 8 and checksum 0. An empty table gives an empty result, other columns are ignored.
    """
    if by not in ("rows", "bytes"):
        raise ValueError("by must be 'rows' or 'bytes'")
    spark = docs.sparkSession
    rows = written(docs.select(
        F.col(id_col).alias("id"), text_bytes(text_col).alias("size"), F.crc32(F.coalesce(text_col, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(F.lit("row"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("at"),
        F.monotonically_increasing_id().alias("n")))
    n_rows = rows.count()
    bits = min(48, max(RING_BITS, (n_rows // rows_per_range).bit_length()))
    weight = F.lit(1).cast("long") if by == "rows" else F.col("size")
    part = F.shiftrightunsigned("at", 64 - bits)
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(weight).alias("load")]

    # Every range of the ring, its arc and how finely it is split; a range never crosses a node.
    places = ring(spark, shards, nodes)
    arcs, begin = [], 0
    for i, (slot, _) in enumerate(places):
        if slot >= begin:
            arcs.append({"arc": i, "a": begin, "b": slot})
            begin = slot + 1
    if begin < 1 << RING_BITS:                   # behind the last node the ring begins again
        arcs.append({"arc": 0, "a": begin, "b": (1 << RING_BITS) - 1})
    slots = _table(spark, arcs, "arc int, a int, b int").select("arc", F.explode(F.sequence("a", "b")).alias("slot"))
    slots = F.broadcast(slots.select("arc", "slot", (F.col("slot") < begin).alias("inside")))   # 2**RING_BITS rows
    large = (rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * rows_per_range)
             .select("part", F.ceil(F.col("rows") / rows_per_range).alias("split")))   # at most rows / (4 * rows_per_range) rows
    cell = rows.withColumn("part", part).join(F.broadcast(large), "part", "left").withColumn(
        "cell", F.coalesce(F.pmod("n", "split"), F.lit(0)))
    cells = written(cell.groupBy("part", "cell").agg(*sums).withColumn("slot", F.shiftright("part", bits - RING_BITS)).join(slots, "slot"))
    load = {r.arc: r.load for r in cells.groupBy("arc").agg(F.sum("load").alias("load")).collect()}  # shards * nodes rows
    total = sum(load.values())
    if by == "rows" and slack == 0:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        room = [int(-(-total * (1 + slack) // shards))] * shards

    # How many rows and how much weight of the same arc stand before each cell; what lies behind the last node comes first.
    before = Window.partitionBy("arc").orderBy("inside", "part", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("part", "cell", "arc", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "load")))
    inner = Window.partitionBy("part", "cell").orderBy("at", "id", "crc", "size", "n")
    numbered = cell.select("id", "size", "crc", "part", "cell", F.row_number().over(inner).alias("number"),
                           (F.sum(weight).over(inner.rowsBetween(Window.unboundedPreceding, 0)) - weight).alias("run")
                           ).join(starts, ["part", "cell"])
    pieces, base = [], [0] * shards
    for arc, takes in enumerate(fill(places, load, room)):
        upto = 0
        if takes:
            steps = []
            for s, part_of in takes:
                upto += part_of
                steps.append({"stop": upto, "shard": s, "base": base[s] - (upto - part_of)})
                base[s] += part_of
            pieces.append({"arc": arc, "steps": steps})
    pieces = _table(spark, pieces, "arc int, steps array<struct<stop: long, shard: int, base: long>>")
    found = numbered.join(F.broadcast(pieces), "arc").select(   # at most shards * (nodes + 1) steps
        "id", "size", "crc", "arc", (F.col("rows_before") + F.col("number") - 1).alias("rank"), (F.col("load_before") + F.col("run")).alias("run"),
        "steps").withColumn("step", F.filter("steps", lambda x: F.col("run") < x.stop)[0])
    out = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("step.shard").alias("shard")]
    if by == "rows":
        return found.select(*out, (F.col("rank") + F.col("step.base")).alias("slot"))
    # By bytes the rows of each piece are counted first.
    found = written(found.select("id", "size", "crc", "arc", "rank", "step"))
    ahead = Window.partitionBy("shard").orderBy("arc", "stop").rowsBetween(Window.unboundedPreceding, -1)
    counted = (found.groupBy("arc", F.col("step.shard").alias("shard"), F.col("step.stop").alias("stop"))
               .agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("rows"))
               .select("arc", "stop", (F.coalesce(F.sum("rows").over(ahead), F.lit(0)) - F.col("first")).alias("move")))
    return found.withColumn("stop", F.col("step.stop")).join(F.broadcast(counted), ["arc", "stop"]).select(
        *out, (F.col("rank") + F.col("move")).alias("slot"))
