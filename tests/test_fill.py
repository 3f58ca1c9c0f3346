"""Bulk fill of a stored cube: errors tile by tile, runs that skip and retry, folders that are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spheretiles.functions import cells as C
from spheretiles.operators import aggregate
from spheretiles.operators.fill import KEYS, bulk_fill, filled_tiles
from spheretiles.sources.cube import cube_rows, read_cube, slice_cells, slice_rows, write_cube

ORDER, SHIFT = 4, 1
ASK = "time int, level int, `order` int, face int, x long, y long"


@pytest.fixture(scope="module")
def cells(spark):
    at = spark.range(6 * 12 * 4**ORDER).selectExpr(f"cast(id div {12 * 4**ORDER * 3} as int) as time", f"cast(id div {12 * 4**ORDER} % 3 as int) as level", f"id % {12 * 4**ORDER} as cell")
    return at.withColumn("value", F.when(F.col("cell") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("cell") % 101 + F.col("time") * 1000 + F.col("level") * 300).cast("float"))


@pytest.fixture
def cube(spark, cells, tmp_path):
    write_cube(cube_rows(cells, ORDER), str(tmp_path / "cube"))
    return read_cube(spark, str(tmp_path / "cube"))


def told(df):
    return {tuple(r[k] for k in KEYS): (r["status"], r["message"]) for r in df.collect()}


def test_a_bad_tile_spoils_no_other(spark, cube, cells, tmp_path):
    cache = str(tmp_path / "cache")
    ask = [(t, lv, o, f, x, 0) for t in range(2) for lv in range(3) for o in (2, 4) for f in (0, 11) for x in (0, 1)]
    wrong = [(0, 0, 5, 0, 0, 0), (0, 0, 3, 12, 0, 0), (0, 0, 2, 0, 2, 0), (7, 0, 2, 0, 0, 0), (None, 0, 2, 0, 0, 0)]
    broken = cube.withColumn("values", F.when(~F.expr("time = 1 and level = 1 and face = 11 and iy = 3"), F.col("values")))
    got = told(bulk_fill(spark.createDataFrame(ask + ask + wrong, ASK), broken, cache, ORDER, SHIFT))
    assert set(got) == set(ask) | set(wrong)
    assert got[wrong[0]] == ("error", "order outside range") and got[wrong[1]] == ("error", "face outside range")
    assert got[wrong[2]] == ("error", "x or y outside grid") and got[wrong[3]] == ("error", "the slice has no rows there")
    assert got[wrong[4]] == ("error", "a part of the address is null")
    bad = [k for k in ask if k[:2] == (1, 1) and k[3] == 11 and k[2] == 2]
    assert bad and all(got[k] == ("error", "a row of the slice has a wrong length") for k in bad)
    assert all(got[k] == ("generated", None) for k in ask if k not in bad)
    again = told(bulk_fill(spark.createDataFrame(ask, ASK), cube, cache, ORDER, SHIFT))  # the cube is whole now
    assert all(again[k] == (("generated", None) if k in bad else ("skipped", None)) for k in ask)
    third = told(bulk_fill(spark.createDataFrame(ask, ASK), cube, cache, ORDER, SHIFT))
    assert all(v == ("skipped", None) for v in third.values())
    stored = {tuple(r[k] for k in KEYS): r["values"] for r in filled_tiles(spark, cache).collect()}
    assert set(stored) == set(ask)
    for o in (2, 4):
        for t, lv in ((0, 0), (1, 1), (1, 2)):
            mean = aggregate.mean_pyramid(cells.where(f"time = {t} and level = {lv}").select("cell", "value"), ORDER, o).where(F.col("order") == o).select("cell", "value")
            tiles = {(r["face"], r["x"], r["y"]): r["values"] for r in aggregate.assemble_tiles(mean, o, SHIFT).collect()}
            for k in ask:
                if k[:3] == (t, lv, o):
                    assert np.array_equal(np.float32(stored[k]), np.float32(tiles[k[3:]]), equal_nan=True)


def test_force_makes_tiles_again_and_the_newest_counts(spark, cube, tmp_path):
    cache, ask = str(tmp_path / "cache"), spark.createDataFrame([(0, 0, 4, 0, 0, 0)], ASK)
    bulk_fill(ask, cube, cache, ORDER, SHIFT)
    more = cube.withColumn("values", F.transform("values", lambda v: (v + 1).cast("float")))
    assert told(bulk_fill(ask, more, cache, ORDER, SHIFT, force=True)) == {(0, 0, 4, 0, 0, 0): ("generated", None)}
    old, new = cube.where("time = 0 and level = 0 and face = 0 and iy = 0").first()["values"][0], filled_tiles(spark, cache).first()["values"][0]
    assert new == old + 1 and filled_tiles(spark, cache).count() == 1


def test_rows_that_are_missing_or_repeated_and_the_budget(spark, cube, tmp_path):
    ask = [(0, 0, 3, 0, 0, 0), (0, 0, 3, 1, 0, 0), (0, 0, 1, 2, 0, 0), (0, 0, 3, 3, 0, 0)]
    odd = cube.where("not (time = 0 and level = 0 and face = 0 and iy = 1)")
    odd = odd.unionByName(odd.where("time = 0 and level = 0 and face = 1 and iy = 2"))
    got = told(bulk_fill(spark.createDataFrame(ask, ASK), odd, str(tmp_path / "cache"), ORDER, SHIFT, budget=64))
    assert [got[k] for k in ask] == [("error", "3 of 4 rows of the slice are there"), ("error", "5 of 4 rows of the slice are there"), ("error", "the tile reads over 64 cells"), ("generated", None)]


def test_no_requests(spark, cube, tmp_path):
    assert bulk_fill(spark.createDataFrame([], ASK), cube, str(tmp_path / "cache"), ORDER, SHIFT).collect() == []


def test_a_slice_reads_its_own_folder(spark, cube, cells):
    df = slice_rows(cube, {"time": 1, "level": -1})
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "time" in filters and "level" in filters
    assert len(df.select(F.input_file_name()).distinct().collect()) <= 12 and all("time=1/level=2" in r[0] for r in df.select(F.input_file_name()).distinct().collect())
    got = {r["cell"]: r["value"] for r in slice_cells(cube, {"time": 1, "level": -1}, ORDER).collect()}
    want = {r["cell"]: r["value"] for r in cells.where("time = 1 and level = 2").collect()}
    assert got.keys() == want.keys() and all(got[c] == v or v != v and got[c] != got[c] for c, v in want.items())
    mean = aggregate.slice_pyramid(cube, {"time": 1, "level": 2}, ORDER, 2, SHIFT)
    assert "time" in mean._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert mean.count() == 12 * 4**2


def test_rows_of_a_cube_with_absent_cells(spark, cells):
    one = cells.where("time = 0 and level = 0 and cell % 2 = 0")
    r = cube_rows(one, ORDER).where("face = 0 and iy = 0").first()
    held = {x["ix"]: x["value"] for x in one.withColumns({"ix": C.cell_xy("cell", ORDER)[0], "iy": C.cell_xy("cell", ORDER)[1]}).where(f"iy = 0 and cell < {4**ORDER}").collect()}
    assert len(r["values"]) == 16 and all((i in held and (v == held[i] or v != v)) or v != v for i, v in enumerate(r["values"]))
