"""Pyramids and profiles. Values are float, sums double, results float; NaN never enters a sum."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.tables import finite, not_nan


def nan():
    return F.lit(float("nan")).cast("float")


def particle_count(particles: DataFrame, order: int, to: int) -> DataFrame:
    """Rows per cell at `to`; particles were filtered by read_particles, so a value column has dropped non-finite rows."""
    return particles.groupBy(C.parent("cell", order - to).alias("cell")).agg(F.count("*").alias("n"))


def particle_sum(particles: DataFrame, order: int, to: int) -> DataFrame:
    return particles.groupBy(C.parent("cell", order - to).alias("cell")).agg(F.sum(F.col("value").cast("double")).alias("total"))


def particle_mean(particles: DataFrame, order: int, to: int) -> DataFrame:
    return _partials(particles, order, to).select("cell", (F.col("total") / F.col("n")).cast("float").alias("value"))


def _partials(particles: DataFrame, order: int, to: int) -> DataFrame:
    return particles.groupBy(C.parent("cell", order - to).alias("cell")).agg(F.sum(F.col("value").cast("double")).alias("total"), F.count("*").alias("n"))


def cascade(partials: DataFrame, finest: int, coarsest: int) -> DataFrame:
    """(order, cell, total, n) for every order, each from the next finer one: a third more rows than the finest has.

    The partials are read once: levels share their shuffles (Spark reuses equal exchanges).
    """
    levels, now = [partials.withColumn("order", F.lit(finest))], partials
    for order in range(finest - 1, coarsest - 1, -1):
        now = now.groupBy(C.parent("cell", 1).alias("cell")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        levels.append(now.withColumn("order", F.lit(order)))
    return reduce(DataFrame.unionByName, levels).select("order", "cell", "total", "n")


def particle_pyramid(particles: DataFrame, order: int, coarsest: int, finest: int) -> DataFrame:
    """(order, cell, n, total, value): one aggregation of particles to the finest order, then its few rows to all others."""
    out = cascade(_partials(particles, order, finest), finest, coarsest)
    return out.select("order", "cell", "n", "total", (F.col("total") / F.col("n")).cast("float").alias("value"))


def mean_pyramid(field: DataFrame, order: int, coarsest: int) -> DataFrame:
    """(order, cell, value) of a dense map: mean of the finest valid values of each block; NaN where there is none."""
    v = F.when(not_nan("value"), F.col("value").cast("double"))
    partials = field.select("cell", F.coalesce(v, F.lit(0.0)).alias("total"), F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    return cascade(partials, order, coarsest).select("order", "cell", F.when(F.col("n") > 0, (F.col("total") / F.col("n")).cast("float")).otherwise(nan()).alias("value"))


def slice_pyramid(cube: DataFrame, picks: dict[str, int], order: int, to: int, tile_shift: int, budget: int = 4_194_304) -> DataFrame:
    """Mean of one cube slice at order `to`; refuses tiles that would read over `budget` cells each.

    cube: cells (time, level, cell, value), or a stored cube's face rows, of which only the slice's folder is read."""
    from ..sources.cube import slice_cells
    from ..sources.tables import read_cube_slice

    if 4 ** (order - to) * 4**tile_shift > budget:
        raise ValueError(f"a tile of order {to} reads over {budget} cells")
    cells = slice_cells(cube, picks, order) if "values" in cube.columns else read_cube_slice(cube, picks)
    return mean_pyramid(cells, order, to).where(F.col("order") == to).select("cell", "value")


def assemble_tiles(cells: DataFrame, order: int, tile_shift: int, empty: float | None = None, axes: str = "even_x") -> DataFrame:
    """(order, face, x, y, values[]): row-major arrays of non-empty tiles; gaps hold `empty` (None: NaN).

    A tile is a run of nested ids, so rows meet by cell >> 2 * tile_shift; a tile has 4**tile_shift cells at most. Its
    cells are sorted and the gaps between neighbours filled, in one pass. A cell that is given twice is an error.
    """
    from .algebra import cell_to_tile

    fill = nan() if empty is None else F.lit(empty).cast("float")
    placed = cell_to_tile(cells, order, tile_shift, axes=axes)
    groups = placed.groupBy("face", "x", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("local_index").cast("int").alias("i"), F.col("value").cast("float").alias("v")))).alias("found"))
    ends = F.concat(F.slice(F.transform("found", lambda c: c["i"]), 2, 4**tile_shift), F.array(F.lit(4**tile_shift)))
    twice = F.raise_error(F.lit("a tile has a cell twice"))
    runs = F.zip_with("found", ends, lambda c, end: F.when(end > c["i"], F.concat(F.array(c["v"]), F.array_repeat(fill, end - c["i"] - 1))).otherwise(twice))
    values = F.concat(F.array_repeat(fill, F.element_at("found", 1)["i"]), F.flatten(runs))
    return groups.select(F.lit(order).alias("order"), "face", "x", "y", values.alias("values"))


def assemble_tiles_arrow(cells: DataFrame, order: int, tile_shift: int, empty: float | None = None, axes: str = "even_x") -> DataFrame:
    """assemble_tiles for large tiles: one group of rows becomes one array in an Arrow task."""
    import numpy as np
    import pandas as pd

    from .algebra import cell_to_tile

    fill, size = np.nan if empty is None else empty, 4**tile_shift

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        values = np.full(size, fill, np.float32)
        values[rows["local_index"].to_numpy()] = rows["value"].to_numpy()
        return pd.DataFrame({"order": [order], "face": [key[0]], "x": [key[1]], "y": [key[2]], "values": [values]})

    placed = cell_to_tile(cells, order, tile_shift, axes=axes).select("face", "x", "y", "local_index", "value")
    return placed.groupBy("face", "x", "y").applyInPandas(build, "order int, face int, x long, y long, values array<float>")


def stride_sample(cells: DataFrame, target: int = 2048, keys: tuple[str, ...] = ("order", "face", "x", "y")) -> DataFrame:
    """Per tile the finite values in row-major order, every max(1, n // target)-th from the first."""
    by = Window.partitionBy(*keys)
    ranked = cells.where(finite("value")).withColumns({"__n": F.count("*").over(by), "__i": F.row_number().over(by.orderBy("local_index")) - 1})
    return ranked.where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / target)) == 0).drop("__n", "__i")


def exact_percentiles(df: DataFrame, percents: tuple[float, ...]) -> list[float | None]:
    """Percentiles of `value` with linear interpolation, by rank: distinct values are dealt by range, never to one task.

    Only counts of partitions and two values for each percentile come to the driver.
    """
    from ..sources.scratch import folder

    counts = df.groupBy("value").agg(F.count("*").alias("n")).repartitionByRange("value").withColumn("part", F.spark_partition_id())
    path = folder(df.sparkSession)
    counts.write.parquet(path)
    ranged = df.sparkSession.read.schema(counts.schema).parquet(path)
    before, total = {}, 0
    for part, n in sorted(ranged.groupBy("part").agg(F.sum("n")).collect()):  # a row a partition
        before[part], total = total, total + n
    if not total:
        return [None] * len(percents)
    places = [p / 100 * (total - 1) for p in percents]
    ranks = sorted({r for at in places for r in (floor(at), ceil(at))})
    start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")]
    upto = start + F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    hit = F.filter(F.array(*map(F.lit, ranks)), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    value = {r["rank"]: float(r["value"]) for r in ranged.withColumn("upto", upto).select("value", F.explode(hit).alias("rank")).collect()}
    return [value[floor(at)] + (value[ceil(at)] - value[floor(at)]) * (at - floor(at)) for at in places]


def layer_stats(cells: DataFrame, percents: tuple[float, ...] = (1, 50, 99), target: int = 2048) -> DataFrame:
    """One row: min and max of finite values, percentiles (linear interpolation) of the strided sample; null if none."""
    found = exact_percentiles(stride_sample(cells, target).select("value"), percents)
    named = [F.lit(v).cast("double").alias(f"p{p:g}") for p, v in zip(percents, found, strict=True)]
    return cells.where(finite("value")).agg(F.min("value").alias("min"), F.max("value").alias("max")).select("min", "max", *named)


def order_stats(cells: DataFrame) -> DataFrame:
    """Per order, and in total (order null): min, max and number of tiles."""
    tile = F.struct("order", "face", "x", "y")
    v = F.when(finite("value"), F.col("value"))
    return cells.rollup("order").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.countDistinct(tile).alias("tiles"))


def finite_range(df: DataFrame, value: str = "value") -> tuple[float, float]:
    """(min, max) of finite values; an error if none is finite or max <= min."""
    low, high = df.where(finite(value)).agg(F.min(value), F.max(value)).first()
    if low is None:
        raise ValueError("no finite value")
    if high <= low:
        raise ValueError("the largest value must be above the smallest")
    return low, high


def auto_max_order(count: int, order: int, tile_shift: int, target: float) -> int:
    """Smallest order with mean occupancy of at most `target` particles."""
    if target <= 0:
        raise ValueError("the target must be positive")
    if count <= 0:
        return tile_shift
    return min(order, max(tile_shift, ceil(log(max(1.0, count / target / 12), 4))))


def auto_max_order_table(particles: DataFrame, order: int, tile_shift: int, target: float) -> DataFrame:
    """auto_max_order as one row (particles, max_order), computed in Spark."""
    n = F.count("*")
    wanted = F.ceil(F.log(4.0, F.greatest(F.lit(1.0), n / target / 12)))
    return particles.agg(n.alias("particles"), F.least(F.lit(order), F.greatest(F.lit(tile_shift), wanted)).cast("int").alias("max_order"))
