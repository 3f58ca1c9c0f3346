"""Blocks of a raster against the plain 4 x 4 rule: date line, poles, edges of blocks, holes."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spheretiles.operators import algebra, raster
from spheretiles.sources.tables import read_raster


def weights(t):
    return [(-t + 2 * t * t - t**3) / 2, (2 - 5 * t * t + 3 * t**3) / 2, (t + 4 * t * t - 3 * t**3) / 2, (t**3 - t * t) / 2]


def plain(pixels, width, height, kind, lon, lat):
    cycle = width - 1 if kind == "gridline" else width
    x, y = ((lon + 180) * cycle / 360 % cycle, (90 - lat) * (height - 1) / 180) if kind == "gridline" else (((lon + 180) * width / 360 - 0.5) % width, (90 - lat) * height / 180 - 0.5)
    y = min(max(y, 0.0), height - 1.0)
    x1, y1 = math.floor(x), math.floor(y)
    wx, wy = weights(x - x1), weights(y - y1)
    return sum(wx[i] * wy[j] * pixels.get((min(max(y1 + j - 1, 0), height - 1), (x1 + i - 1) % cycle), math.nan) for j in range(4) for i in range(4))


@pytest.mark.parametrize(("width", "height", "side"), [(37, 19, 5), (36, 18, 64), (36, 18, 4), (9, 5, 1), (8, 4, 3), (21, 11, 10), (6, 3, 2)])
def test_every_cell_equals_the_plain_rule(spark, width, height, side):
    draw = random.Random(width * side)
    pixels = {(r, c): draw.randrange(-800, 800) / 8 for r in range(height) for c in range(width)}
    if width == 2 * height - 1:
        pixels |= {(r, width - 1): pixels[r, 0] for r in range(height)}
    for gone in draw.sample(sorted(k for k in pixels if 0 < k[0] < height - 1 and 0 < k[1] < width - 1), 2):
        del pixels[gone]
    df, info = read_raster(spark.createDataFrame([(r, c, v) for (r, c), v in pixels.items()], "row int, col int, value double"), None)
    assert (info["width"], info["height"]) == (width, height)
    cells = spark.range(12 * 4**4).withColumnRenamed("id", "cell")
    got = {r["cell"]: r["value"] for r in raster.resample_raster(df, info, cells, 4, side=side).collect()}
    places = {r["cell"]: (r["lon"], r["lat"]) for r in algebra.cells_to_lonlat(cells, 4).collect()}
    want = {c: plain(pixels, width, height, info["registration"], *p) for c, p in places.items()}
    assert sorted(got) == sorted(want)
    order = sorted(want)
    assert np.allclose([got[c] for c in order], [want[c] for c in order], rtol=0, atol=1e-6, equal_nan=True)


def test_blocks_meet_each_cell_once(spark):
    df, info = read_raster(spark.range(90 * 180).select(F.floor(F.col("id") / 180).alias("row"), (F.col("id") % 180).alias("col"), F.col("id").cast("float").alias("value")), None)
    blocks = raster.raster_blocks(df, info)
    sizes = {(r["by"], r["bx"]): len(r["values"]) for r in blocks.collect()}
    assert sizes == {(y, x): 67 * 67 for y in range(2) for x in range(3)}
    plan = raster.resample_blocks(blocks, info, spark.range(3072).withColumnRenamed("id", "cell"), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan.split("Join")[1].split("\n")[1]


def test_a_pixel_given_twice_is_an_error(spark):
    rows = [(r, c, 1.0) for r in range(3) for c in range(6)] + [(1, 1, 2.0)]
    df, info = read_raster(spark.createDataFrame(rows, "row int, col int, value double"), None)
    with pytest.raises(PySparkException, match="given twice"):
        raster.raster_blocks(df, info).collect()


def test_filters_on_positions_plan_fast(spark):
    import time

    placed = algebra.cells_to_lonlat(spark.range(3072).withColumnRenamed("id", "cell"), 4)
    start = time.perf_counter()
    n = placed.where("lon between 10 and 40 and lat > 20 and vx * vy + vz < 0.9").count()
    assert time.perf_counter() - start < 30 and 0 < n < 300
