"""Painted selections: tile ranges, cell ranges, id ranges, and the values of big maps inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.tables import finite
from .cover import disjoint_tiles

TILE = ("order", "face", "x", "y")


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.dropDuplicates(list(TILE))


def canonical_tile_order(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("order", "face", "y", "x")


def coalesce_tile_ranges(tiles: DataFrame) -> DataFrame:
    """(order, face, y, x0, x1, tile_count): runs of neighbouring x."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("order", "face", "y").orderBy("x"))
    return distinct_tiles(tiles).withColumn("run", run).groupBy("order", "face", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("tile_count")).drop("run")


def cell_ranges_from_tiles(ranges: DataFrame, tile_shift: int) -> DataFrame:
    """(order, face, ix0, ix1, iy0, iy1, cell_count) of tile ranges."""
    side = 1 << tile_shift
    out = ranges.select("order", "face", (F.col("x0") * side).alias("ix0"), ((F.col("x1") + 1) * side - 1).alias("ix1"), (F.col("y") * side).alias("iy0"), ((F.col("y") + 1) * side - 1).alias("iy1"))
    return out.withColumn("cell_count", (F.col("ix1") - F.col("ix0") + 1) * (F.col("iy1") - F.col("iy0") + 1))


def coverage_summary(ranges: DataFrame, tile_shift: int) -> DataFrame:
    """One row: tile_count, range_count, cell_count, orders, faces, and the order where it is the only one."""
    out = ranges.agg(F.sum("tile_count").alias("tile_count"), F.count("*").alias("range_count"), F.sort_array(F.collect_set("order")).alias("orders"), F.sort_array(F.collect_set("face")).alias("faces"))
    return out.withColumns({"cell_count": (F.col("tile_count") * 4**tile_shift).cast("decimal(38,0)"), "order": F.when(F.size("orders") == 1, F.element_at("orders", 1))})


def selection_expand_tiles(ranges: DataFrame) -> DataFrame:
    return ranges.select("order", "face", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def selection_expand(cell_ranges: DataFrame, max_cells: int | None = 1_000_000, distinct: bool = False) -> DataFrame:
    """Cells (order, face, ix, iy) of cell ranges; an error beyond max_cells, which is a sum over ranges."""
    if max_cells is not None:
        total = cell_ranges.agg(F.sum("cell_count")).first()[0] or 0
        if total > max_cells:
            raise ValueError(f"the selection has {total} cells, over {max_cells}")
    rows = cell_ranges.withColumn("iy", F.explode(F.sequence("iy0", "iy1")))
    out = rows.select("order", "face", F.explode(F.sequence("ix0", "ix1")).alias("ix"), "iy")
    return out.distinct() if distinct else out


def selection_to_order(cell_ranges: DataFrame, order: int) -> DataFrame:
    """Cell ranges at another order: finer is exact, coarser floors; `exact` says which."""
    finer, coarser = F.greatest(F.lit(order) - F.col("order"), F.lit(0)), F.greatest(F.col("order") - F.lit(order), F.lit(0))
    first = lambda c: C.down(C.up(c, finer), coarser)
    last = lambda c: C.down(C.up(F.col(c) + 1, finer) - 1, coarser)
    out = cell_ranges.withColumns({"ix0": first("ix0"), "ix1": last("ix1"), "iy0": first("iy0"), "iy1": last("iy1"), "exact": F.col("order") <= order, "order": F.lit(order)})
    return out.withColumn("cell_count", (F.col("ix1") - F.col("ix0") + 1) * (F.col("iy1") - F.col("iy0") + 1))


def selection_nested_ranges(tiles: DataFrame, tile_shift: int, order: int) -> DataFrame:
    """Tiles with start, stop, count of their nested ids at `order`; an error for tiles finer than it."""
    levels = F.lit(order) - F.col("order") + tile_shift
    safe = F.when(F.col("order") <= order, levels).otherwise(F.raise_error(F.lit("order is coarser than a selected tile")))
    start = C.up(C.nested_id("face", "x", "y", F.col("order") - tile_shift), safe * 2)
    count = C.up(1, safe * 2)
    return tiles.select(*TILE, start.alias("start"), (start + count).alias("stop"), count.alias("count"))


def select_values_nested(field: DataFrame, tiles: DataFrame, tile_shift: int, order: int) -> DataFrame:
    """(cell, value) of a full map at `order` inside tiles of one or more orders.

    A tile is an aligned run of ids, so tiles and field meet in one left-semi equi join on (order, cell >> bits): never a range
    join. Tiles may repeat and lie in each other: their normal form holds each cell in one tile, so no cell comes twice.
    """
    tiles, orders = disjoint_tiles(tiles, tile_shift, order)
    keys = tiles.select("order", C.nested_id("face", "x", "y", F.col("order") - tile_shift).alias("__tile"))
    if len(orders) <= 1:
        bits = 2 * (order - orders[0] + tile_shift) if orders else 0
        return field.withColumn("__tile", C.down("cell", bits)).join(keys.select("__tile"), "__tile", "left_semi").drop("__tile")
    at = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), C.down("cell", 2 * (order - o + tile_shift)).alias("__tile")) for o in orders]))
    return field.withColumn("__k", at).join(keys, (F.col("__k.order") == keys["order"]) & (F.col("__k.__tile") == keys["__tile"]), "left_semi").drop("__k")


def select_values_block(blocks: DataFrame, tiles: DataFrame, tile_shift: int, order: int, block_order: int, prefix: dict[str, object] | None = None) -> DataFrame:
    """(cell, value) inside tiles from (block, values[]): only touched blocks are read and only their slices are exploded.

    Tiles may repeat and lie in each other; their normal form gives each cell once.
    prefix: one value for each leading axis (column) that `blocks` has besides, as a filter of the scan.
    """
    if not 0 <= block_order <= order:
        raise ValueError("the block order must lie between 0 and the order")
    for axis, value in (prefix or {}).items():
        blocks = blocks.where(F.col(axis) == F.lit(value))
    each, bits = 4 ** (order - block_order), 2 * (order - block_order)
    ids = selection_nested_ranges(disjoint_tiles(tiles, tile_shift, order)[0], tile_shift, order)
    part = ids.withColumn("block", F.explode(F.sequence(C.down("start", bits), C.down(F.col("stop") - 1, bits))))
    part = part.withColumns({"low": F.greatest(F.col("start"), F.col("block") * each) - F.col("block") * each, "high": F.least(F.col("stop"), (F.col("block") + 1) * each) - F.col("block") * each})
    hit = blocks.join(part.select("block", "low", "high"), "block")
    cut = hit.select("block", "low", F.posexplode(F.slice("values", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))).alias("at", "value"))
    return cut.select((F.col("block") * each + F.col("low") + F.col("at")).alias("cell"), F.col("value").cast("float").alias("value"))


def selection_stats(values: DataFrame) -> DataFrame:
    """One row: n, mean, min and max of the finite selected values."""
    v = F.when(finite("value"), F.col("value").cast("double"))
    return values.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


SELECTION = "selectionType string, tiles struct<coverage: struct<order: int, tileShift: int, tileRanges: array<struct<order: int, face: int, y: bigint, x0: bigint, x1: bigint>>>>"


def selection_parse(df: DataFrame, text: str = "selection") -> DataFrame:
    """Tile ranges of selection JSON, one row each; anything but a tile selection is an error."""
    s = F.from_json(text, SELECTION)
    ranges = F.when(s["selectionType"] == "tiles", s.getField("tiles").getField("coverage").getField("tileRanges")).otherwise(F.raise_error(F.lit("not a tile selection")))
    shift = s.getField("tiles").getField("coverage").getField("tileShift")
    return df.select(*[c for c in df.columns if c != text], shift.alias("tile_shift"), F.explode(ranges).alias("r")).select("*", "r.*").drop("r")
