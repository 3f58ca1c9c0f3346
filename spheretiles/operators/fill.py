"""Bulk fill: the tiles that many requests ask of a stored cube, computed together and stored; a bad tile spoils no other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.scratch import written
from .tiles import address_reason

KEYS = ("time", "level", "order", "face", "x", "y")
ADDRESS = "time int, level int, `order` int, face int, x long, y long"


def stored_fills(spark: SparkSession, cache: str) -> DataFrame | None:
    """(*KEYS, values, run) of all runs' good tiles, None where no run has written yet."""
    try:
        return spark.read.schema(f"{ADDRESS}, values array<float>, message string, run int, ok boolean").parquet(cache).where("ok").drop("ok", "message")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def filled_tiles(spark: SparkSession, cache: str) -> DataFrame:
    """(*KEYS, values) of the cache; of a tile that a forced run made again, the newest."""
    return stored_fills(spark, cache).groupBy(*KEYS).agg(F.max_by("values", "run").alias("values"))


def _row_sums(order: int, tile_shift: int):
    """Task: a row segment of the cube, under one tile, becomes the sums and counts of its not-NaN values by tile column."""
    side = 1 << tile_shift

    def run(batches):
        for b in batches:
            sums, counts, row, wrong = [], [], [], []
            for o, iy, x, values in zip(*[b.column(c).to_pylist() for c in ("order", "iy", "x")], b.column("values"), strict=True):
                factor = 1 << (order - o)
                line = values.values.to_numpy(zero_copy_only=False).astype(np.float64) if values.is_valid else np.empty(0)
                bad = len(line) != 1 << order
                part = np.full(side * factor, np.nan) if bad else line[x * side * factor : (x + 1) * side * factor]
                part = part.reshape(side, factor)
                valid = ~np.isnan(part)
                sums.append(np.where(valid, part, 0).sum(axis=1))
                counts.append(valid.sum(axis=1))
                row.append((iy >> (order - o)) & (side - 1))
                wrong.append(bad)
            kept = [b.column(c) for c in KEYS]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row, pa.int32()), pa.array(wrong, pa.bool_()), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64()))], names=[*KEYS, "row", "wrong", "sums", "counts"])

    return run


def _tile_of(order: int, tile_shift: int):
    """Task: the rows of one tile as its values, or the reason why there are none."""
    side = 1 << tile_shift

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        values, message = None, None
        try:
            due = side << (order - key[2].as_py())
            if any(rows.column("wrong").to_pylist()):
                message = "a row of the slice has a wrong length"
            elif rows.num_rows != due:
                message = f"{rows.num_rows} of {due} rows of the slice are there"
            else:
                at = rows.column("row").to_numpy()
                sums, counts = np.zeros((side, side)), np.zeros((side, side), np.int64)
                np.add.at(sums, at, np.array(rows.column("sums").to_pylist()))
                np.add.at(counts, at, np.array(rows.column("counts").to_pylist()))
                with np.errstate(invalid="ignore"):
                    values = (sums / np.where(counts > 0, counts, np.nan)).astype(np.float32).ravel()
        except Exception as error:  # noqa: BLE001 (one tile's trouble is a row of the result)
            values, message = None, f"{type(error).__name__}: {error}"
        out = [pa.array([k.as_py()], k.type) for k in key]
        return pa.table([*out, pa.array([values], pa.list_(pa.float32())), pa.array([message], pa.string())], names=[*KEYS, "values", "message"])

    return build


def bulk_fill(requests: DataFrame, cube: DataFrame, cache: str, order: int, tile_shift: int, coarsest: int = 0, budget: int = 4_194_304, force: bool = False) -> DataFrame:
    """Computes and stores every requested tile (time, level, order, face, x, y) that `cache` lacks; (*KEYS, status, message).

    cube: face rows (time, level, face, iy, values[]) at `order`, as read_cube gives them; a tile's value is the NaN-aware mean
    of the finest cells. status is `generated`, `skipped` (stored before, unless `force`) or `error`, with the reason: an address
    outside the orders, faces or grid, a tile that would read over `budget` cells, a slice without rows there, rows that are
    missing, repeated or of a wrong length. Errors are not stored, so a later run tries them again. Repeated requests count once.

    Requests and rows meet by an equi join on (slice, face, order, tile row), so folders of other slices and rows under no tile
    are left out; row segments are summed before they travel, and a task holds one tile's rows, which the budget bounds.
    """
    spark = requests.sparkSession
    asked = requests.select(*[F.col(c).cast("int" if c in ("time", "level", "order", "face") else "long").alias(c) for c in KEYS]).distinct()
    unknown = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in KEYS]) == 1, "a part of the address is null")
    cells = F.lit(4**tile_shift) * C.up(1, (F.lit(order) - F.col("order")) * 2)
    reason = F.coalesce(unknown, address_reason(max(coarsest, tile_shift), order, tile_shift), F.when(cells > budget, F.lit(f"the tile reads over {budget} cells")))
    asked = asked.withColumn("reason", reason)
    held = stored_fills(spark, cache)
    run = 0 if held is None else 1 + (held.agg(F.max("run")).first()[0] or 0)
    asked = written(asked)
    good = asked.where("reason is null").drop("reason")
    pending = written(good if force or held is None else good.join(held.select(*KEYS), list(KEYS), "left_anti"))
    orders = sorted(r[0] for r in pending.select("order").distinct().collect())  # 30 at most
    if orders:
        at = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), C.down("iy", order - o + tile_shift).alias("y")) for o in orders])).alias("at")
        slices = pending.select("time", "level").distinct()
        rows = cube.join(slices, ["time", "level"], "left_semi").select("time", "level", "face", F.col("iy").cast("long").alias("iy"), "values", at)
        met = rows.select("time", "level", "face", "iy", "values", "at.order", "at.y").join(pending, ["time", "level", "face", "order", "y"])
        sums = met.select(*KEYS, "iy", "values").mapInArrow(_row_sums(order, tile_shift), f"{ADDRESS}, row int, wrong boolean, sums array<double>, counts array<long>")
        made = sums.groupBy(*KEYS).applyInArrow(_tile_of(order, tile_shift), f"{ADDRESS}, values array<float>, message string")
    else:
        made = pending.select(*KEYS, F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("string").alias("message"))
    made = pending.join(made, list(KEYS), "left").withColumn("message", F.when(F.col("values").isNull(), F.coalesce("message", F.lit("the slice has no rows there"))))
    here = f"{cache}/run={run}"
    made.withColumn("ok", F.col("message").isNull()).write.partitionBy("ok").parquet(here)
    done = spark.read.schema(made.withColumn("ok", F.lit(True)).schema).parquet(here).select(*KEYS, F.col("ok").alias("__ok"), F.col("message").alias("__why"))
    told = asked.join(done, list(KEYS), "left")
    status = F.when(F.col("reason").isNotNull() | ~F.coalesce("__ok", F.lit(True)), "error").when(F.col("__ok"), "generated").otherwise("skipped")
    return told.select(*KEYS, status.alias("status"), F.coalesce("reason", "__why").alias("message"))
