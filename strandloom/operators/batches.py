"""Batches, chunks, tiles and worker totals: index arithmetic that stays distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, into: str = "_n", ranges: int = 64) -> DataFrame:
    """rows with their places from 0 in an order, without one task for all: they are cut into ranges of the order, numbered within each, and moved on by the sizes of those before.

    The cuts come from a sample by hash, a few thousand values at most, and are literals from then on, so every run of a
    task finds the same ranges; a poor sample makes them uneven, never wrong. Rows that tie are in any order.
    """
    n = rows.count()
    some = rows.where(F.col(order).isNotNull()).where(F.pmod(F.xxhash64(order), F.lit(max(1, n // 2000))) == 0).select(order).limit(4096).collect()
    values = sorted({r[0] for r in some})
    step = max(1, len(values) // ranges)
    kind = rows.schema[order].dataType.simpleString()
    cuts = F.array(*(F.lit(v) for v in values[step::step])).cast(f"array<{kind}>")
    placed = rows.withColumn("_p", F.size(F.filter(cuts, lambda c: c <= F.col(order))))
    within = placed.withColumn("_w", F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1)
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return within.join(F.broadcast(before), "_p").withColumn(into, F.col("_b") + F.col("_w")).drop("_p", "_w", "_b")


def contiguous(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with batch: consecutive ranges of ceil(n / parts) rows."""
    n = rows.count()
    return numbered(rows, order).withColumn("batch", F.floor(F.col("_n") / max(1, -(-n // parts)))).drop("_n")


def round_robin(rows: DataFrame, order: str, devices: int) -> DataFrame:
    return numbered(rows, order).withColumn("device", F.col("_n") % devices).drop("_n")


def chunks(rows: DataFrame, order: str, size: int) -> DataFrame:
    return numbered(rows, order).withColumn("chunk", F.floor(F.col("_n") / size)).drop("_n")


def node_statistics(tasks: DataFrame) -> DataFrame:
    """(node, tasks, online, pending, mean_ms) of (node, status, ms)."""
    return tasks.groupBy("node").agg(F.count(F.lit(1)).alias("tasks"), F.bool_or(F.col("status") != "Offline").alias("online"), F.sum((F.col("status") == "Busy").cast("int")).alias("pending"), F.round(F.avg("ms"), 6).alias("mean_ms"))


def tiles(pairs: DataFrame, m: str, n: str, size: int) -> DataFrame:
    """A row for each tile of each pair's matrix in raster order, with its height and width."""
    count = lambda c: F.ceil(F.col(c) / size).cast("int")
    grid = pairs.withColumn("tile_row", F.explode(F.sequence(F.lit(0), count(m) - 1))).withColumn("tile_col", F.explode(F.sequence(F.lit(0), count(n) - 1)))
    edge = lambda c, at: F.least(F.lit(size), F.col(c) - F.col(at) * size).cast("int")
    return grid.withColumn("raster", (F.col("tile_row") * count(n) + F.col("tile_col")).cast("int")).withColumn("height", edge(m, "tile_row")).withColumn("width", edge(n, "tile_col"))


def device_memory(m: Column | str, n: Column | str) -> Column:
    """Bytes for a pair's matrix, sequences, scores and a buffer."""
    m, n = (F.col(x) if isinstance(x, str) else x for x in (m, n))
    return 4 * (m + 1) * (n + 1) + m + n + 24 * 24 * 4 + (1 << 20)


# How much faster than a plain loop each kernel is taken to be, and the tilings of known devices.
SPEEDUP = {"Scalar": 1.0, "Simd": 8.0, "Banded": 4.0, "GpuFull": 50.0, "GpuTiled": 30.0}
TILINGS = {
    "V100": {"tile": 32, "batch": 256, "shared_kb": 96, "double_buffer": True},
    "A100": {"tile": 32, "batch": 512, "shared_kb": 192, "double_buffer": True},
    "RTX3090": {"tile": 16, "batch": 128, "shared_kb": 96, "double_buffer": False},
    "Generic": {"tile": 16, "batch": 64, "shared_kb": 48, "double_buffer": False},
}
TILED_BYTES, CELLS_A_SECOND = 512 << 20, 1e9


def speedup(strategy: Column | str) -> Column:
    """The factor of a kernel by its name; null for others."""
    table = F.create_map(*(F.lit(x) for kv in SPEEDUP.items() for x in kv))
    return table[F.col(strategy) if isinstance(strategy, str) else strategy]


def tiling_statistics(pairs: DataFrame, m: str, n: str, device: str = "Generic") -> DataFrame:
    """pairs with tiles, tile_bytes (cells of four bytes, a tile having a margin of one on each side), beneficial, estimated_ms and tiles_a_second on a device of TILINGS."""
    size = TILINGS[device]["tile"]
    count = F.ceil(F.col(m) / size) * F.ceil(F.col(n) / size)
    ms = (F.col(m) + 1).cast("double") * (F.col(n) + 1) / CELLS_A_SECOND * 1000
    out = pairs.withColumn("tiles", count.cast("long")).withColumn("tile_bytes", F.col("tiles") * ((size + 2) ** 2 * 4)).withColumn("estimated_ms", ms)
    return out.withColumn("beneficial", F.col("tile_bytes") < TILED_BYTES).withColumn("tiles_a_second", F.col("tiles") / (F.col("estimated_ms") / 1000))


def stream_chunk(memory_mb: Column | int) -> Column:
    """Sequences of a chunk that a memory budget allows, at a kB each, 100 at least."""
    mb = memory_mb if isinstance(memory_mb, Column) else F.lit(memory_mb)
    return F.greatest(F.lit(100), F.floor(mb * (1 << 20) / 1000)).cast("long")
