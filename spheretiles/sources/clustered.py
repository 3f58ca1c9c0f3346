"""Cells stored so that a selection reads what it needs: folders by a coarse ancestor, files sorted by id, small row groups.

A tile is one run of nested ids. A selection becomes a list of ancestors, which prunes folders (so files) before any is
opened, and a bounded list of id ranges, which the Parquet reader holds against the least and largest id of each row group. An
equi join with the selection's normal form then keeps exactly its cells.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C

FOLDER = "ancestor_"  # and the order of the ancestors, so that readers need not be told


def write_clustered(cells: DataFrame, path: str, order: int, part_order: int = 2, files: int | None = None, row_group: int = 1 << 20, force: bool = False) -> None:
    """Stores (cell, ...) at `order` below one folder for each ancestor of `part_order` that holds cells.

    Rows are dealt by ranges of ids (as many as `files`, else as shuffles have partitions), so a file holds neighbours, a crowded
    region gets more files, and a folder no more than it needs. row_group: bytes of a row group, before compression.
    """
    n = files or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{FOLDER}{part_order}"
    rows = cells.withColumn(folder, C.parent("cell", order - part_order)).repartitionByRange(n, "cell").sortWithinPartitions(folder, "cell")
    rows.write.partitionBy(folder).option("parquet.block.size", row_group).mode("overwrite" if force else "errorifexists").parquet(path)


def read_clustered(spark: SparkSession, path: str, tiles: DataFrame, tile_shift: int, order: int, most: int = 64) -> DataFrame:
    """The stored cells inside `tiles` (order, face, x, y), which may repeat and lie in each other; columns as they were stored.

    At most `most` id ranges are pushed to the scan: those of the selection itself, or of the finest common ancestors that are
    few enough. An empty selection reads nothing.
    """
    from ..operators.cover import disjoint_tiles
    from ..operators.select import select_values_nested, selection_nested_ranges
    from .scratch import written

    tiles = written(disjoint_tiles(tiles, tile_shift, order)[0])
    ids = selection_nested_ranges(tiles, tile_shift, order)
    runs = _runs(ids, order, most)
    stored = spark.read.parquet(path)
    folder = next(c for c in stored.columns if c.startswith(FOLDER))
    if not runs:
        return stored.drop(folder).limit(0)
    parts = sorted({p for a, b in runs for p in _parts(a, b, order, int(folder.removeprefix(FOLDER)))})
    ranged = reduce(or_, [(F.col("cell") >= a) & (F.col("cell") < b) for a, b in runs])
    return select_values_nested(stored.where(F.col(folder).isin(parts)).where(ranged).drop(folder), tiles, tile_shift, order)


def _parts(start: int, stop: int, order: int, part_order: int) -> range:
    bits = 2 * (order - part_order)
    return range(start >> bits, ((stop - 1) >> bits) + 1)


def _runs(ids: DataFrame, order: int, most: int) -> list[tuple[int, int]]:
    """At most `most` ranges [start, stop) that hold all of `ids` (start, stop), joined where they touch."""
    held = lambda level: F.struct(F.lit(level).alias("level"), C.down("start", 2 * (order - level)).alias("a"), (C.down(F.col("stop") - 1, 2 * (order - level)) + 1).alias("b"))
    each = ids.select(F.explode(F.array(*map(held, range(order + 1)))).alias("r")).select("r.*").distinct()
    few = [r["level"] for r in each.groupBy("level").count().where(F.col("count") <= most).collect()]
    level = max(few, default=0)  # at level 0 there are twelve at most
    bits = 2 * (order - level)
    found = each.where(F.col("level") == level).collect()
    out: list[list[int]] = []
    for a, b in sorted((r["a"] << bits, r["b"] << bits) for r in found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
