"""The tile table: enumerate, read with defaults, write, check, resolve to coarser tiles, inspect points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.scratch import written
from ..sources.tile_files import save_tile_files
from .algebra import points_to_cells, tile_ancestors

TILE = ("order", "face", "x", "y")


def enumerate_tiles(spark: SparkSession, coarsest: int, finest: int, tile_shift: int) -> DataFrame:
    """Every tile of an order range, from one distributed range."""
    out = None
    for order in range(coarsest, finest + 1):
        side = 1 << max(0, order - tile_shift)
        part = spark.range(12 * side * side).select(F.lit(order).alias("order"), F.expr(f"id div {side * side}").cast("int").alias("face"), (F.col("id") % side).alias("x"), (F.expr(f"id div {side}") % side).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


def union_orders(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def address_reason(coarsest: int, finest: int, tile_shift: int):
    """Why a tile address is not valid, or null."""
    side = C.grid("order", tile_shift)
    outside = lambda c: (F.col(c) < 0) | (F.col(c) >= side)
    return (
        F.when((F.col("order") < coarsest) | (F.col("order") > finest), "order outside range")
        .when((F.col("face") < 0) | (F.col("face") >= 12), "face outside range")
        .when(F.col("order") < tile_shift, "order below tile shift")
        .when(outside("x") | outside("y"), "x or y outside grid")
    )


def valid_tile_filter(tiles: DataFrame, coarsest: int, finest: int, tile_shift: int) -> DataFrame:
    """Adds valid and reason."""
    reason = address_reason(coarsest, finest, tile_shift)
    return tiles.withColumns({"valid": reason.isNull(), "reason": reason})


def read_tiles(wanted: DataFrame, stored: DataFrame, size: int, sparse: bool = True, empty: float | None = None) -> DataFrame:
    """(order, face, x, y, values): of wanted tiles. Sparse layers fill missing or wrong-sized tiles with `empty` (None: NaN);
    dense ones raise. Of a tile that is stored more than once the largest array of the right size counts."""
    fill = F.lit(float("nan") if empty is None else empty).cast("float")
    whole = F.when(F.size("values") == size, F.col("values"))
    joined = wanted.join(stored.groupBy(*TILE).agg(F.max(whole).alias("values")), list(TILE), "left")
    other = F.array_repeat(fill, size) if sparse else F.raise_error(F.lit("a tile of a dense layer is missing or has a wrong size"))
    return joined.withColumn("values", F.coalesce("values", other))


def write_tiles(tiles: DataFrame, path: str, force: bool = False) -> None:
    """One row per tile, by layer, order and face; refuses to touch a stored dataset unless `force`."""
    tiles.sortWithinPartitions("layer", "order", "face", "y", "x").write.partitionBy("layer", "order", "face").mode("overwrite" if force else "errorifexists").parquet(path)


def export_tile_files(tiles: DataFrame, path: str, dtype: str = "<f4", force: bool = False) -> None:
    """One little-endian binary file per tile below `path`, written by tasks, in place when the job commits: see TileFiles."""
    save_tile_files(tiles, path, dtype, force)


def missing_tiles(expected: DataFrame, stored: DataFrame) -> DataFrame:
    return expected.join(stored, list(TILE), "left_anti").select(*TILE)


def pending_tiles(expected: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Tiles still to fill."""
    return expected.select(*TILE) if force else missing_tiles(expected, cached)


def validate_tiles(expected: DataFrame, stored: DataFrame, size: int, repeats: bool = False) -> DataFrame:
    """One row: checked, missing, wrong_size (stored tiles carry n_values), and with `repeats` how many are stored more than once.

    A tile counts once however often it is stored; it has a wrong size if any copy has."""
    each = stored.groupBy(*TILE).agg(F.count("*").alias("copies"), F.bool_or(~F.col("n_values").eqNullSafe(size)).alias("wrong"))
    both = expected.select(*TILE).distinct().join(each, list(TILE), "left")
    out = both.agg(F.count("*").alias("checked"), F.count_if(F.col("copies").isNull()).alias("missing"), F.count_if("wrong").alias("wrong_size"), F.count_if(F.col("copies") > 1).alias("repeated"))
    return out if repeats else out.drop("repeated")


def resolve_ancestors(wanted: DataFrame, stored: DataFrame, coarsest: int) -> DataFrame:
    """For each wanted tile the finest stored tile that is it or above it: source_order (null: none), exact."""
    keys = stored.select(F.col("order").alias("source_order"), "face", F.col("x").alias("source_x"), F.col("y").alias("source_y")).distinct()
    found = tile_ancestors(wanted.select(*TILE), coarsest).join(keys, ["source_order", "face", "source_x", "source_y"], "left_semi")
    best = found.groupBy(*TILE).agg(F.max("source_order").alias("source_order"))
    out = wanted.join(best, list(TILE), "left")
    up = F.col("order") - F.col("source_order")
    return out.withColumns({"source_x": C.down("x", up), "source_y": C.down("y", up), "exact": F.coalesce(F.col("source_order") == F.col("order"), F.lit(False))})


def inspect_points(points: DataFrame, stored: DataFrame, order: int, tile_shift: int, coarsest: int, axes: str = "odd_x") -> DataFrame:
    """Points (lon, lat) with cell, value, exact and the source tile's order: the value of the finest stored tile there.

    Other columns pass through, nulls in them or not; points that repeat stay; one without a position has no value. Of a tile
    that is stored more than once the largest array counts. Ancestors are looked up once a tile, not once a point.
    """
    placed = points_to_cells(points, order, axes=axes, tile_shift=tile_shift).drop("u", "v").withColumnsRenamed({"x": "__x", "y": "__y"})
    # written: filters that later joins infer would be pushed into the long expressions of positions, and take minutes to plan
    seen = written(placed.select(F.lit(order).alias("order"), "face", F.col("__x").alias("x"), F.col("__y").alias("y")).distinct())
    found = resolve_ancestors(seen, stored, coarsest).select(F.col("face").alias("__f"), F.col("x").alias("__tx"), F.col("y").alias("__ty"), "source_order", "source_x", "source_y", "exact")
    tiles = stored.groupBy(*TILE).agg(F.max("values").alias("values"))
    tiles = tiles.select(F.col("order").alias("source_order"), F.col("face").alias("__f"), F.col("x").alias("source_x"), F.col("y").alias("source_y"), "values")
    held = found.join(tiles, ["source_order", "__f", "source_x", "source_y"], "left")
    met = placed.join(held, (F.col("face") == F.col("__f")) & (F.col("__x") == F.col("__tx")) & (F.col("__y") == F.col("__ty")), "left")
    up = F.lit(order) - F.col("source_order")
    local = C.up(C.low_bits(C.down("iy", up), tile_shift), tile_shift) + C.low_bits(C.down("ix", up), tile_shift)
    kept = [c for c in placed.columns if c not in ("__x", "__y")]
    return met.select(*kept, "source_order", F.get("values", local.cast("int")).alias("value"), F.coalesce("exact", F.lit(False)).alias("exact"))


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """One row: visible, exact, fallback, missing, max_source_order."""
    known = F.col("source_order").isNotNull()
    return resolved.agg(
        F.count("*").alias("visible"), F.count_if("exact").alias("exact"), F.count_if(known & ~F.col("exact")).alias("fallback"),
        F.count_if(~known).alias("missing"), F.max("source_order").alias("max_source_order"),
    )


def order_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("order").agg(F.count("*").alias("tiles"))


def fill_summary(work: DataFrame) -> DataFrame:
    """(status, tiles): generated, skipped, errors."""
    return work.groupBy("status").agg(F.count("*").alias("tiles"))
