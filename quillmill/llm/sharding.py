"""Sharding by a k-d tree over document metadata.

The unit is a group of equal texts, which always stays together. The tree splits the groups at
distributed weighted medians: for each node the widest of the metadata dimensions is taken, its
range is cut into equal bins, one aggregation sums the bytes per bin for all nodes at once, and a
second one, by hash, settles the bin that holds the median. A node of ``a`` and ``b`` leaves is
split in proportion to them, until every leaf is one shard.

Groups of more than 1/64 of a shard cannot be split and would spoil a median, so those (at most 64
per shard, by arithmetic) are dealt first, heaviest to the emptiest shard, and the tree gives each
shard what it still lacks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.storage import cut, written

BINS = 4096
HEAVY_PARTS = 64
SLOT_ROWS = 20_000
#: Most nodes of a level that are broadcast.
BROADCAST_NODES = 100_000
#: Most nodes of a level that are kept as a literal.
LITERAL_NODES = 2_000
N_SHARDS = 16
_UNIT = ["text_hash", "text_crc32", "size"]


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("x_id"),
        F.log2(F.octet_length(text) + F.lit(1.0)).alias("x_length"),
        (F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20)).alias("x_source"),
        (F.pmod(F.xxhash64("lang"), F.lit(1 << 20)) / float(1 << 20)).alias("x_lang"),
    )


DIMENSIONS = ("x_length", "x_id", "x_source", "x_lang")


def _inline(spark, rows: list[tuple], names: str) -> DataFrame:
    """A few rows as a literal table, which needs no Python on executors."""
    kinds = {int: "{}L", float: "{!r}D"}
    values = ", ".join("(" + ", ".join(kinds[type(v)].format(v) if abs(v) < 1 << 63 and v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


def _small(nodes: DataFrame, n: int) -> DataFrame:
    """A table of at most ``n`` nodes, broadcast if that is few."""
    return F.broadcast(nodes) if n <= BROADCAST_NODES else nodes


def _fixed(nodes: DataFrame, n: int) -> DataFrame:
    """A table of at most ``n`` nodes, computed once: as a literal if that is few, else checkpointed."""
    if n > LITERAL_NODES:
        return cut(nodes)
    rows = nodes.collect()
    return _inline(nodes.sparkSession, [tuple(r) for r in rows], ", ".join(nodes.columns)) if rows else nodes


def _deal_heavy(heavy: list[tuple[int, ...]], total: int, shards: int) -> tuple[dict, list[int], float]:
    """Shard of each heavy group, the shards' loads, and the level to which the rest fills them."""
    loads, queue, to = [0] * shards, [(0, s) for s in range(shards)], {}
    for *unit, weight in sorted(heavy, key=lambda g: (-g[-1], g)):
        load, s = heapq.heappop(queue)
        to[tuple(unit)], loads[s] = s, load + weight
        heapq.heappush(queue, (loads[s], s))
    light = total - sum(loads)
    low = sorted(loads)
    level, used = 0.0, 0
    for i, x in enumerate(low):
        used += x
        level = (light + used) / (i + 1)
        if i + 1 == shards or level <= low[i + 1]:
            break
    return to, loads, level


def _room(spark, loads: list[int], level: float) -> DataFrame:
    """(at, before): bytes that the shards before ``at`` still take from the tree, for 0 to the last end."""
    every = spark.range(len(loads) + 1).select(F.col("id").alias("at"))
    held = [(s, x) for s, x in enumerate(loads) if x]
    took = F.lit(0)
    if held:
        every = every.join(F.broadcast(_inline(spark, held, "shard, load")), F.col("at") == F.col("shard"), "left")
        took = F.coalesce("load", F.lit(0))
    before = F.sum(F.greatest(F.lit(0.0), F.lit(level) - took)).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return _fixed(every.select("at", F.coalesce(before, F.lit(0.0)).alias("before")), len(loads) + 1)


def _split(groups: DataFrame, room: DataFrame, shards: int) -> DataFrame:
    """Split every node of several leaves once; a node is its first leaf and its ``end``."""
    sides = [f(x).alias(f"{n}_{x}") for x in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    seen = groups.filter("end - node > 1").groupBy("node", "end", "room_node", "room_end").agg(F.sum("weight").alias("weight"), *sides)
    # the widest dimension, as a share of the whole table's range
    widths = [F.struct((F.col(f"high_{x}") - F.col(f"low_{x}")).alias("width"), F.lit(-i).alias("order"), F.col(f"low_{x}").alias("low")) for i, x in enumerate(DIMENSIONS)]
    plan = seen.withColumn("middle", F.floor((F.col("node") + F.col("end")) / 2)).withColumn("d", F.greatest(*widths))
    plan = plan.join(_small(room, shards + 1).select(F.col("at").alias("middle"), F.col("before").alias("room_middle")), "middle")
    here, there = F.col("room_middle") - F.col("room_node"), F.col("room_end") - F.col("room_node")
    goal = F.when(there > 0, F.col("weight") * here / there).otherwise(F.col("weight") / 2)
    width = F.when(F.col("d.width") > 0, F.col("d.width")).otherwise(1.0)
    plan = _fixed(plan.select("node", "middle", "room_middle", (-F.col("d.order")).alias("dim"), F.col("d.low").alias("low"), width.alias("width"), goal.alias("goal")), shards)
    value = F.get(F.array(*[F.col(x) for x in DIMENSIONS]), F.col("dim").cast("int"))
    bin_ = F.least(F.floor((value - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1)).cast("int")
    cell = F.shiftrightunsigned(F.xxhash64("text_hash", "text_crc32"), 52).cast("int")
    binned = groups.join(_small(plan, shards), "node", "left").withColumn("bin", bin_).withColumn("cell", cell)

    def crossing(table: DataFrame, by: str, goal: Column) -> DataFrame:
        """Of each node, the step in whose sum the goal falls, and the sum before it."""
        upto = Window.partitionBy("node").orderBy(by)
        run = table.groupBy("node", by).agg(F.sum("weight").alias("w"), F.first(goal).alias("g"))
        run = run.withColumn("upto", F.sum("w").over(upto)).withColumn("last", F.max(by).over(Window.partitionBy("node")))
        at = F.min_by(F.struct(by, (F.col("upto") - F.col("w")).alias("before")), by)
        return run.filter((F.col("upto") >= F.col("g")) | (F.col(by) == F.col("last"))).groupBy("node").agg(at.alias("x")).select("node", F.col(f"x.{by}").alias(f"cut_{by}"), F.col("x.before").alias("before"))

    open_ = binned.filter(F.col("dim").isNotNull())
    bins = _fixed(crossing(open_, "bin", F.col("goal")), shards)
    inside = open_.join(_small(bins, shards), "node").filter("bin = cut_bin")
    cells = crossing(inside, "cell", F.col("goal") - F.col("before")).select("node", "cut_cell")
    edges = _fixed(bins.join(cells, "node").select("node", "cut_bin", "cut_cell"), shards)
    right = (F.col("bin") > F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("cell") > F.col("cut_cell")))
    moved = binned.join(_small(edges, shards), "node", "left")
    left = F.col("dim").isNotNull() & ~F.coalesce(right, F.lit(False))
    sides = {"node": F.when(right, F.col("middle")).otherwise(F.col("node")), "room_node": F.when(right, F.col("room_middle")).otherwise(F.col("room_node"))}
    sides |= {"end": F.when(left, F.col("middle")).otherwise(F.col("end")), "room_end": F.when(left, F.col("room_middle")).otherwise(F.col("room_end"))}
    return written(moved.withColumns(sides).select(groups.columns), "shard-level")


def shard(docs: DataFrame, *, shards: int = N_SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: the shards' sizes are near equal. ``target_bytes`` sets the number of shards
    instead. Slots count from 0 in each shard. Null texts count as empty ones, null ids and
    metadata have coordinates of their own, repeated rows and equal texts share a shard, ties of a
    median are settled by hash, other columns are not read, and an empty table gives no rows. A
    level of the tree is one written table, and its nodes are a table too, broadcast while small.
    The driver holds the heavy groups, at most 64 a shard, and a number per shard.
    """
    base = written(_base(docs), "shard-base")
    ends = [f(x).alias(f"{n}_{x}") for x in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]
    whole = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).first()
    total = whole["bytes"] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    weighed = base.groupBy(*_UNIT).agg(F.sum("size").alias("weight"), *[F.min(x).alias(x) for x in DIMENSIONS])
    scaled = [((F.col(x) - (whole[f"low_{x}"] or 0.0)) / (((whole[f"high_{x}"] or 0.0) - (whole[f"low_{x}"] or 0.0)) or 1.0)).alias(x) for x in DIMENSIONS]
    root = [F.lit(0).cast("long").alias("node"), F.lit(shards).cast("long").alias("end")]
    groups = written(weighed.select(*_UNIT, "weight", *root, *scaled), "shard-groups")
    edge = total / shards / HEAVY_PARTS
    heavy = [tuple(r) for r in groups.filter(F.col("weight") > edge).select(*_UNIT, "weight").collect()]
    dealt, loads, level = _deal_heavy(heavy, total, shards)
    room = _room(docs.sparkSession, loads, level)
    light = groups.filter(F.col("weight") <= edge).withColumns({"room_node": F.lit(0.0), "room_end": F.lit(float(sum(max(0.0, level - x) for x in loads)))})
    for _ in range((shards - 1).bit_length()):
        light = _split(light, room, shards)
    placed = light.select(*_UNIT, F.col("node").alias("shard"))
    if dealt:
        rows = [(*unit, s) for unit, s in dealt.items()]
        placed = placed.unionByName(_inline(docs.sparkSession, rows, "text_hash, text_crc32, size, shard"))
    rows = base.select("doc_id", *_UNIT).join(placed, _UNIT)
    buckets = max(1, -(-whole["n"] // (shards * SLOT_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_hash"))
    return rows.withColumn("nth", nth).join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
