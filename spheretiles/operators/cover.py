"""Normal form of a multi-order selection: the one set of tiles that covers the same cells, none inside another, no four
siblings all there.

A tile is an aligned run of nested ids. Runs are joined where they touch or lie in each other (gaps and islands by a window),
and a joined run falls into the largest aligned tiles in closed form. This goes by rounds of `STEP` levels, from the finest
up: a round looks at tiles below one ancestor of its base level, at most about 4**STEP of them however large the selection
is, and what fills that ancestor goes on to the next round as one tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.scratch import written

STEP = 8


def normal_form(tiles: DataFrame, tile_shift: int) -> DataFrame:
    """(order, face, x, y) of the cover of `tiles`, which may repeat and lie in each other; orders from tile_shift up.

    A null in an address makes no tile; an empty selection has an empty cover.
    """
    address = F.when(F.col("order") >= tile_shift, F.col("order") - tile_shift).otherwise(F.raise_error(F.lit("a tile's order is below the tile shift")))
    valid = tiles.select("order", "face", "x", "y").dropna()
    now = valid.select(address.cast("int").alias("level"), C.nested_id("face", "x", "y", F.col("order") - tile_shift).alias("id"))
    now = written(now.distinct())
    low, high = now.agg(F.min("level"), F.max("level")).first()
    if low is None:
        return valid.select(F.col("order").cast("int").alias("order"), F.col("face").cast("int").alias("face"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).limit(0)
    done = []
    for base in range((max(high, 1) - 1) // STEP * STEP, -1, -STEP):
        fine, coarse = now.where(F.col("level") > base), now.where(F.col("level") <= base)
        fine = fine.withColumn("above", C.down("id", (F.col("level") - base) * 2))
        if low <= base:
            fine = fine.join(_covered(fine, coarse, low, base), "above", "left_anti")
        pieces = written(_pieces(_runs(fine, high), base, high))
        done.append(pieces.where(F.col("level") > base))
        now = coarse.unionByName(pieces.where(F.col("level") == base))
    out = reduce(DataFrame.unionByName, [*done, now.distinct()])
    x, y = C.cell_xy("id", F.col("level"))
    return out.select((F.col("level") + tile_shift).alias("order"), C.down("id", F.col("level") * 2).cast("int").alias("face"), x.alias("x"), y.alias("y"))


def _covered(fine: DataFrame, coarse: DataFrame, low: int, base: int) -> DataFrame:
    """(above): ancestors of `fine` that a tile of `coarse` is or holds, by one equi join on their own ancestors."""
    each = fine.select("above").distinct().withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(base))))
    each = each.withColumn("id", C.down("above", (F.lit(base) - F.col("level")) * 2))
    return each.join(coarse, ["level", "id"], "left_semi").select("above").distinct()


def _runs(fine: DataFrame, high: int) -> DataFrame:
    """(above, start, stop): maximal runs of ids of level `high` that the tiles below one ancestor cover."""
    size = (F.lit(high) - F.col("level")) * 2
    ids = fine.select("above", C.up("id", size).alias("start"), C.up(F.col("id") + 1, size).alias("stop"))
    by = Window.partitionBy("above").orderBy("start", F.desc("stop"))
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = ids.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    numbered = opens.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("above", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def _pieces(runs: DataFrame, base: int, high: int) -> DataFrame:
    """(level, id): the largest aligned tiles of each run, of levels `base` to `high`.

    At each level the run holds the whole tiles low to high; those inside a whole tile of the level above belong to it.
    """
    first = lambda level: C.down(F.col("start") + (4 ** (high - level) - 1), 2 * (high - level))
    last = lambda level: C.down("stop", 2 * (high - level))
    parts = []
    for level in range(base, high + 1):
        low, top = first(level), last(level)
        if level == base:
            parts.append(F.struct(F.lit(level).alias("level"), low.alias("low"), top.alias("top")))
            continue
        inner = first(level - 1) < last(level - 1)
        parts.append(F.struct(F.lit(level).alias("level"), low.alias("low"), F.when(inner, first(level - 1) * 4).otherwise(top).alias("top")))
        parts.append(F.struct(F.lit(level).alias("level"), F.when(inner, last(level - 1) * 4).otherwise(top).alias("low"), top.alias("top")))
    held = F.filter(F.array(*parts), lambda p: p["low"] < p["top"])
    return runs.select(F.explode(held).alias("p")).select("p.level", F.explode(F.sequence("p.low", F.col("p.top") - 1)).alias("id"))


def disjoint_tiles(tiles: DataFrame, tile_shift: int, finest: int) -> tuple[DataFrame, list[int]]:
    """`tiles` so that none repeats or lies in another, and their orders; of one order alone, without a pass over ids.

    A tile of an order above `finest` is an error."""
    orders = lambda df: sorted(r[0] for r in df.select("order").dropna().distinct().collect())  # noqa: E731 (30 at most)
    found = orders(tiles)
    if found and found[-1] > finest:
        raise ValueError(f"order {finest} is coarser than a selected tile of order {found[-1]}")
    if len(found) <= 1:
        return tiles.select("order", "face", "x", "y").distinct(), found
    covered = normal_form(tiles, tile_shift)
    return covered, orders(covered)


def cover_cells(tiles: DataFrame, tile_shift: int, order: int, max_cells: int | None = 1_000_000) -> DataFrame:
    """(cell): the nested ids at `order` inside `tiles`, each once; an error beyond max_cells cells."""
    from .select import selection_nested_ranges

    ids = selection_nested_ranges(disjoint_tiles(tiles, tile_shift, order)[0], tile_shift, order)
    if max_cells is not None:
        total = ids.agg(F.sum("count")).first()[0] or 0
        if total > max_cells:
            raise ValueError(f"the selection has {total} cells, over {max_cells}")
    return ids.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("cell"))
