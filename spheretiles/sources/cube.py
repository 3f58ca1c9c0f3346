"""Cubes stored by axis: one partition for each index of the leading axes, rows of faces inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C

AXES = ("time", "level")


def cube_rows(cells: DataFrame, order: int, axes: tuple[str, ...] = AXES, bits: str = "even_x") -> DataFrame:
    """(*axes, face, iy, values[]) of cube cells (*axes, cell, value): one array for each row of a face; absent cells are NaN."""
    ix, iy = C.cell_xy("cell", order, bits)
    placed = cells.select(*axes, C.face_of("cell", order).alias("face"), ix.cast("int").alias("ix"), iy.cast("int").alias("iy"), F.col("value").cast("float").alias("value"))
    rows = placed.groupBy(*axes, "face", "iy").agg(F.array_sort(F.collect_list(F.struct("ix", "value"))).alias("found"))
    whole = F.transform("found", lambda s: s["value"])
    known = F.map_from_entries("found")
    filled = F.transform(F.sequence(F.lit(0), F.lit((1 << order) - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(float("nan")).cast("float")))
    return rows.select(*axes, "face", "iy", F.when(F.size("found") == 1 << order, whole).otherwise(filled).alias("values"))


def write_cube(rows: DataFrame, path: str, axes: tuple[str, ...] = AXES, force: bool = False) -> None:
    """Stores face rows in one folder for each index of `axes`, a face to a task, so that a slice reads its own files alone."""
    dealt = rows.repartition(*axes, "face").sortWithinPartitions(*axes, "face", "iy")
    dealt.write.partitionBy(*axes).mode("overwrite" if force else "errorifexists").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(face, iy, values[], *axes): a filter on an axis, as read_cube_slice and slice_rows set it, prunes folders."""
    return spark.read.parquet(path)


def slice_rows(cube: DataFrame, picks: dict[str, int], axes: tuple[str, ...] = AXES) -> DataFrame:
    """(face, iy, values[]) of one slice of a stored cube; `picks` as in read_cube_slice."""
    from .tables import read_cube_slice

    return read_cube_slice(cube, picks, axes)


def slice_cells(cube: DataFrame, picks: dict[str, int], order: int, axes: tuple[str, ...] = AXES, bits: str = "even_x") -> DataFrame:
    """(cell, value) of one slice of a stored cube; a row whose length is not a face's side is an error."""
    rows = slice_rows(cube, picks, axes)
    values = F.when(F.size("values") == 1 << order, F.col("values")).otherwise(F.raise_error(F.lit("a row of the cube has a wrong length")))
    out = rows.select("face", F.col("iy").cast("long").alias("iy"), F.posexplode(values).alias("ix", "value"))
    return out.select(C.nested_id("face", F.col("ix").cast("long"), "iy", order, bits).alias("cell"), F.col("value").cast("float").alias("value"))
