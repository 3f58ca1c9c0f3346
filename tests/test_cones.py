"""Covers of tables of cones: how they are dealt, deep orders, odd directions and angles."""

import math
import random
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from spheretiles.functions import caps
from spheretiles.operators import algebra
from spheretiles.operators.tiles import enumerate_tiles

CONES = "id int, vx double, vy double, vz double, cone double"


def drawn(n, angles, seed=3):
    draw = random.Random(seed)
    for i in range(n):
        v = [draw.gauss(0, 1) for _ in range(3)]
        norm = math.sqrt(sum(c * c for c in v))
        yield (i, *[c / norm for c in v], draw.choice(angles))


def addresses(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_cones_of_one_file_are_dealt_to_all_tasks(spark):
    cones = spark.createDataFrame(list(drawn(400, [0.1])), CONES).coalesce(1)
    found = algebra.tiles_in_cones(cones, 3, 5).selectExpr("spark_partition_id() as p", "id").distinct().groupBy("p").count().collect()
    assert len(found) == int(spark.conf.get("spark.sql.shuffle.partitions")) and all(40 <= r["count"] <= 60 for r in found)


def test_caps_are_those_of_column_expressions(spark):
    for level in (0, 1, 3, 6):
        tiles = enumerate_tiles(spark, level + 2, level + 2, 2)
        got = algebra.tile_caps(tiles.where(f"(x * 7 + y * 3) % {max(1, 1 << level - 3 if level > 3 else 1)} = 0"), 2).toPandas()
        mine = caps.caps(*(got[c].to_numpy(np.int64) for c in ("face", "x", "y")), level)
        assert len(got) and np.abs(mine - got[["cx", "cy", "cz", "cap"]].to_numpy().T).max() < 1e-15


def test_levels_beyond_one_step_and_the_table(spark):
    assert 6 > max(caps.STEP, caps.TABLE)
    rows = list(drawn(3, [0.0, 0.01, 0.3]))
    every = enumerate_tiles(spark, 8, 8, 2).cache()
    got = algebra.tiles_in_cones(spark.createDataFrame(rows, CONES), 2, 8)
    want = sorted((i, r["face"], r["x"], r["y"]) for i, *v, cone in rows for r in algebra.tiles_in_cone(every, 2, tuple(v), cone).collect())
    assert addresses(got, "id", "face", "x", "y") == want and {r["order"] for r in got.select("order").distinct().collect()} == {8}


def test_odd_cones_and_other_columns(spark):
    nan = math.nan
    rows = [(0, 0.0, 1.0, 0.0, 0.1), (0, 0.0, 1.0, 0.0, 0.1), (1, None, 0.0, 1.0, 0.1), (2, 1.0, 0.0, 0.0, None), (3, nan, 0.0, 1.0, 0.1), (4, 1.0, 0.0, 0.0, nan), (5, 1.0, 0.0, 0.0, 4.0), (6, 1.0, 0.0, 0.0, -9.0)]
    cones = spark.createDataFrame(rows, CONES).selectExpr("*", "make_interval(id) as `a ``b.c`", "'kept' as above")
    for order in (2, 4):  # 2: the twelve coarsest tiles themselves
        every = enumerate_tiles(spark, order, order, 2).cache()
        got = algebra.tiles_in_cones(cones, 2, order)
        want = sorted((i, r["face"], r["x"], r["y"]) for i, *v, cone in rows if None not in (*v, cone) for r in algebra.tiles_in_cone(every, 2, tuple(v), cone).collect())
        assert set(got.columns) == {*cones.columns, "order", "face", "x", "y"}
        assert addresses(got, "id", "face", "x", "y") == want and got.where("above <> 'kept' or `a ``b.c` is null").isEmpty()
    assert algebra.tiles_in_cones(cones.limit(0), 2, 4).collect() == []


def test_adaptive_covers_are_dealt_and_go_beyond_one_step(spark):
    rows = [(0, 0.48, 0.6, 0.64, 0.002), (1, 0.0, 1.0, 0.0, 0.01), (2, -1.0, 0.0, 0.0, 0.0)]
    odd = [(3, None, 0.0, 1.0, 0.1), (4, 1.0, 0.0, 0.0, None)]
    cones = spark.createDataFrame(rows + odd, CONES).withColumnRenamed("cone", "base").coalesce(1)
    df = algebra.tiles_in_cones_adaptive(cones, 2, 8)
    roots = spark.createDataFrame([(2, f, 0, 0) for f in range(12)], "`order` int, face int, x long, y long")
    got = addresses(df, "id", "order", "face", "x", "y")
    for i, *v, base in rows:
        each = algebra.tiles_in_cone_adaptive(roots, 2, tuple(v), 8, base)
        assert [r[1:] for r in got if r[0] == i] == addresses(each, "order", "face", "x", "y")
    assert [r[1:] for r in got if r[0] > 2] == [(2, f, 0, 0) for f in range(12)] * 2
    assert df.selectExpr("spark_partition_id() as p").distinct().count() > 1 and {r[1] for r in got} == set(range(2, 9))
    assert addresses(algebra.tiles_in_cones_adaptive(cones, 2, 2), "id", "order", "x") == [(i, 2, 0) for i in range(5) for _ in range(12)]


def test_tasks_need_not_have_this_package():
    sent = cloudpickle.dumps(caps._descend)
    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); import numpy as np; print(f(slice(0, 1), np.array([[1.0], [0], [0], [9], [1]]), [np.zeros(1, int)] * 3, 0, 1, 2.0, 1.0, None).shape)"
    done = subprocess.run([sys.executable, "-I", "-c", code], input=sent, capture_output=True, cwd="/")
    assert done.stdout.decode().strip() == "(4, 4)", done.stderr.decode()
