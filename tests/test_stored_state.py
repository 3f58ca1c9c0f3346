"""Stored layers that are swapped, totals that are compacted, caches that are not read again, cells stored by place, many cones."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from spheretiles.operators import algebra
from spheretiles.operators.layers import LayerStore
from spheretiles.sources.clustered import read_clustered, write_clustered
from spheretiles.sources.versions import Versions
from spheretiles.streaming import jobs

TILES = "`order` int, face int, x long, y long, values array<float>"


def tiles(spark, add=0.0):
    return spark.createDataFrame([(3, f, 0, 0, [f + add, add, float("nan"), 2.5]) for f in range(12)], TILES)


def values(df):
    return sorted((r["face"], repr([round(v, 2) for v in r["values"]])) for r in df.collect())


def test_a_layer_is_swapped_with_its_entry(spark, tmp_path):
    store = LayerStore(spark, str(tmp_path))
    assert store.entries().collect() == []
    with pytest.raises(KeyError):
        store.read("a")
    store.write("a", tiles(spark))
    store.write("b", tiles(spark, 1.0))
    q = store.requantize("a", "uint16", step=0.5)
    entry = {r["layer"]: (r["dtype"], r["scale"], r["nodata"]) for r in store.entries().collect()}
    assert entry == {"a": ("uint16", 0.5, 65535), "b": ("float32", None, None)} and q["scale"] == 0.5
    assert values(store.read("a")) == values(tiles(spark)) and values(store.read("b")) == values(tiles(spark, 1.0))
    assert "codes" in store.stored("a").columns
    store.requantize("a", "int16", step=0.25)  # from codes, through values
    assert values(store.read("a")) == values(tiles(spark))
    assert store.vacuum() == 2 and values(store.read("a")) == values(tiles(spark))


@pytest.mark.parametrize("step", ["write", "publish"])
def test_a_failure_leaves_the_old_layer_readable(spark, tmp_path, monkeypatch, step):
    store = LayerStore(spark, str(tmp_path))
    store.write("a", tiles(spark))

    def broken(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", broken) if step == "publish" else m.setattr("spheretiles.operators.layers.requantize_layer", broken)
        with pytest.raises(OSError, match="lost"):
            store.requantize("a")
    again = LayerStore(spark, str(tmp_path))
    assert values(again.read("a")) == values(tiles(spark)) and again.entries().first()["dtype"] == "float32"
    again.requantize("a", "int16", step=0.5)
    assert values(again.read("a")) == values(tiles(spark)) and again.entries().first()["dtype"] == "int16"


def test_of_two_jobs_from_one_state_the_later_fails(spark, tmp_path):
    states = Versions(spark, str(tmp_path), "n int")
    states.publish(None, n=F.lit(1))
    before = states.current()
    states.publish(before, n=F.lit(2))
    with pytest.raises(RuntimeError, match="exists"):
        states.publish(before, n=F.lit(3))
    assert [r["n"] for r in states.all()] == [1, 2]
    few = Versions(spark, str(tmp_path), "n int", keep=2)
    for n in range(3, 6):
        few.publish(few.current(), n=F.lit(n))
    assert [r["n"] for r in few.all()] == [4, 5] and few.current()["version"] == 4


def stream_of(spark, rows, path, files, at_once):
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(path)


@pytest.mark.parametrize(("files", "at_once"), [(1, 1), (6, 2), (7, 1)])
def test_totals_are_compacted_and_do_not_depend_on_batches(spark, tmp_path, files, at_once):
    rows = spark.createDataFrame([(i * 977 % 12288, float(i % 50)) for i in range(3000)], "cell long, value double")
    stream = stream_of(spark, rows, str(tmp_path / "in"), files, at_once)
    want = {r["cell"]: (r["n"], r["total"]) for r in jobs.particle_state(rows, 5, 3).collect()}
    out = str(tmp_path / "out")
    totals = jobs.stream_particle_totals(stream, 5, 3, out, str(tmp_path / "checkpoint"), fanout=2)
    state = lambda: {r["cell"]: (r["n"], r["total"]) for r in totals.read().collect()}
    batches = -(-files // at_once)
    assert state() == want
    assert sum(map(len, totals.states.current()["levels"])) == bin(batches).count("1")  # parts of a binary counter
    jobs.stream_particle_totals(stream, 5, 3, out, str(tmp_path / "again"), fanout=2)  # the same batches after a lost checkpoint
    assert state() == want


def test_a_batch_that_fails_before_it_is_published_counts_once(spark, tmp_path, monkeypatch):
    totals = jobs.ParticleTotals(spark, str(tmp_path), fanout=2)
    part = spark.createDataFrame([(1, 2, 3.0)], "cell long, n long, total double")
    totals.add(part, 0)
    with monkeypatch.context() as m:
        m.setattr(Versions, "publish", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            totals.add(part, 1)
    assert totals.read().collect() == part.collect()
    totals.add(part, 1)
    totals.add(part, 1)
    assert list(map(tuple, totals.read().collect())) == [(1, 4, 6.0)]


def test_reading_does_not_grow_with_batches(spark, tmp_path):
    totals = jobs.ParticleTotals(spark, str(tmp_path), fanout=3)
    part = spark.range(40).selectExpr("id as cell", "cast(1 as long) as n", "cast(2 as double) as total").coalesce(1)
    parts = []
    for batch in range(13):
        totals.add(part, batch)
        parts.append(sum(map(len, totals.states.current()["levels"])))
    assert max(parts) <= 6 and totals.read().where("n <> 13 or total <> 26").isEmpty() and totals.read().count() == 40
    assert len(totals.states.all()) <= 8 and totals.vacuum() > 0 and len(glob.glob(str(tmp_path / "part-*"))) == parts[-1]
    assert totals.read().where("n <> 13 or total <> 26").isEmpty()
    assert jobs.ParticleTotals(spark, str(tmp_path / "none")).read().collect() == []


def test_a_tile_stream_reads_no_cache(spark, tmp_path):
    """The cache's files can go while the stream runs: its state knows what was asked for."""
    asked = spark.createDataFrame([(3, i % 3, i % 4, 0) for i in range(60)], "`order` int, face int, x long, y long")
    stream = stream_of(spark, asked, str(tmp_path / "in"), 5, 1)
    filled = []

    def fill(df):
        filled.append(sorted(map(tuple, df.collect())))
        for f in glob.glob(str(tmp_path / "cache/batch=*/*.parquet")):
            os.remove(f)
        return df

    jobs.stream_tile_fill(stream, fill, str(tmp_path / "cache"), str(tmp_path / "checkpoint"))
    assert sorted(sum(filled, [])) == sorted(map(tuple, asked.distinct().collect()))
    more = spark.createDataFrame([(3, 0, 0, 0), (3, 9, 0, 0)], asked.schema)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    filled.clear()
    jobs.stream_tile_fill(stream, fill, str(tmp_path / "cache"), str(tmp_path / "checkpoint"))  # goes on where it was
    assert sum(filled, []) == [(3, 9, 0, 0)]


def test_a_cache_without_its_checkpoint_is_looked_up(spark, tmp_path):
    asked = spark.createDataFrame([(3, i % 3, 0, 0) for i in range(9)], "`order` int, face int, x long, y long")
    stream = stream_of(spark, asked, str(tmp_path / "in"), 1, 1)
    asked.where("face = 1").distinct().write.parquet(str(tmp_path / "cache/batch=77"))
    filled = []
    jobs.stream_tile_fill(stream, lambda t: filled.extend(r["face"] for r in t.collect()) or t, str(tmp_path / "cache"), str(tmp_path / "checkpoint"))
    assert sorted(filled) == [0, 2]


def scanned(df):
    """(files, rows) that the scan of `df` read."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    metrics = leaves.apply(0).metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_a_selection_skips_files_and_row_groups(spark, tmp_path):
    n, path = 12 * 4**8, str(tmp_path / "cells")
    cells = spark.range(n).select(F.xxhash64("id").alias("z"), F.col("id").alias("cell"), F.rand(3).alias("value")).orderBy("z").drop("z")
    write_clustered(cells, path, 8, part_order=1, files=24, row_group=16 << 10)
    every = len(glob.glob(f"{path}/ancestor_1=*/*.parquet"))
    picked = spark.createDataFrame([(6, 5, 3, 4), (6, 5, 3, 5), (7, 5, 6, 8), (5, 11, 0, 0)], "`order` int, face int, x long, y long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = read_clustered(spark, path, picked, 3, 8)
        found = got.collect()
        files, rows = scanned(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ancestor_1" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(cell" in plan
    assert len(found) == len({r["cell"] for r in found}) == 2 * 4**5 + 4**6
    assert every >= 24 and files <= 4 and rows < n / 20
    assert read_clustered(spark, path, picked.where("face = 77"), 3, 8).collect() == []
    few = read_clustered(spark, path, picked, 3, 8, most=1)
    assert sorted(r["cell"] for r in few.collect()) == sorted(r["cell"] for r in found)


def test_cones_of_a_table_meet_the_tiles_that_each_meets(spark):
    draw = random.Random(5)
    rows = []
    for i in range(8):
        v = [draw.gauss(0, 1) for _ in range(3)] if i > 3 else [(0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 1e-9, 0)][i]
        norm = sum(c * c for c in v) ** 0.5
        rows.append((i, *[c / norm for c in v], draw.choice([0.0, 0.001, 0.05, 0.4, 3.2])))
    cones = spark.createDataFrame(rows + [(99, None, 0.0, 1.0, 0.1)], "id int, vx double, vy double, vz double, cone double")
    from spheretiles.operators.tiles import enumerate_tiles

    every = enumerate_tiles(spark, 5, 5, 2).cache()
    df = algebra.tiles_in_cones(cones, 2, 5)
    got = sorted((r["id"], r["face"], r["x"], r["y"]) for r in df.collect())
    want = sorted((i, r["face"], r["x"], r["y"]) for i, *v, cone in rows for r in algebra.tiles_in_cone(every, 2, tuple(v), cone).collect())
    assert got == want and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_adaptive_covers_of_a_table_equal_those_of_each(spark):
    rows = [(1, 0.48, 0.6, 0.64, 0.05), (2, 0.0, 1.0, 0.0, 0.3)]
    df = algebra.tiles_in_cones_adaptive(spark.createDataFrame(rows, "id int, vx double, vy double, vz double, base double"), 2, 5)
    roots = spark.createDataFrame([(2, f, 0, 0) for f in range(12)], "`order` int, face int, x long, y long")
    for i, *v, base in rows:
        want = algebra.tiles_in_cone_adaptive(roots, 2, tuple(v), 5, base).select("order", "face", "x", "y")
        assert sorted(map(tuple, df.where(f"id = {i}").select("order", "face", "x", "y").collect())) == sorted(map(tuple, want.collect()))


def test_many_cones_against_a_fine_order(spark):
    cones = algebra.lonlat_to_vector(spark.range(10_000).selectExpr("id", "(id * 137.50776405D) % 360 - 180 as lon", "degrees(asin((id * 0.61803398875D) % 1 * 1.998 - 0.999)) as lat")).withColumn("cone", F.lit(0.0005))
    found = algebra.tiles_in_cones(cones, 3, 10)
    n, ids = found.agg(F.count("*"), F.countDistinct("id")).first()
    assert ids == 10_000 and n < 80_000
