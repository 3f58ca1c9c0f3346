"""Operators on made-up rows: large tiles, percentiles by rank, big ids, stored tiles, streams cut into batches."""

import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spheretiles.operators import aggregate, algebra, catalog, select, tiles
from spheretiles.plans import algebra as plans
from spheretiles.streaming import jobs


def test_a_large_tile_assembles_fast(spark):
    cells = spark.range(12 * 65536, 13 * 65536).where("id % 3 <> 1").select(F.col("id").alias("cell"), F.col("id").cast("float").alias("value"))
    aggregate.assemble_tiles(cells.limit(10), 9, 8).collect()
    start = time.perf_counter()
    r = aggregate.assemble_tiles(cells, 9, 8).first()
    took = time.perf_counter() - start
    placed = {x["local_index"]: x["value"] for x in algebra.cell_to_tile(cells, 9, 8).collect()}
    want = np.array([placed.get(i, np.nan) for i in range(65536)], np.float32)
    assert np.array_equal(np.array(r["values"], np.float32), want, equal_nan=True)
    assert took < 5


def test_edges_of_a_tile_and_a_repeated_cell(spark):
    one = spark.createDataFrame([(5, 1.5)], "cell long, value float")
    assert [v for v in aggregate.assemble_tiles(one, 3, 2, empty=0).first()["values"] if v] == [1.5]
    with pytest.raises(PySparkException):
        aggregate.assemble_tiles(one.unionAll(one), 3, 2).collect()


@pytest.mark.parametrize("n", [1, 2, 99, 5000])
def test_percentiles_by_rank(spark, n):
    values = np.round(np.random.default_rng(n).normal(size=n), 1).astype(np.float32)
    got = aggregate.exact_percentiles(spark.createDataFrame([(float(v),) for v in values], "value float"), (0, 1, 50, 99, 100))
    assert np.allclose(got, np.percentile(values.astype(float), [0, 1, 50, 99, 100]), atol=1e-9)


def test_percentiles_of_nothing(spark):
    assert aggregate.exact_percentiles(spark.createDataFrame([], "value float"), (1, 50)) == [None, None]


def test_large_ids_divide_exactly(spark):
    side = 1 << 26
    code = 11 * side * side + (side - 1) * side + side - 1
    r = algebra.tile_code_decode(spark.createDataFrame([(code,)], "tile_code long"), side).first()
    assert (r["face"], r["x"], r["y"]) == (11, side - 1, side - 1)
    big = spark.createDataFrame([(29, 11, (1 << 26) - 1, (1 << 26) - 1)], "`order` int, face int, x long, y long")
    ids = select.selection_nested_ranges(big, 3, 29).first()
    block = (ids["stop"] - 1) // 16
    blocks = spark.createDataFrame([(block, [float(i) for i in range(16)])], "block long, values array<double>")
    assert select.select_values_block(blocks, big, 3, 29, 27).agg(F.max("cell")).first()[0] == ids["stop"] - 1


def test_stored_tiles_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 0, 0, 1, [1.0, float("nan")]), ("a", 5, 1, 2, 3, [3.0, 4.0])], "layer string, `order` int, face int, x long, y long, values array<float>")
    path = str(tmp_path / "tiles")
    tiles.write_tiles(rows, path)
    with pytest.raises(PySparkException):
        tiles.write_tiles(rows, path)
    tiles.write_tiles(rows.where("face = 1"), path, force=True)
    assert [(r["face"], r["x"], r["y"], list(r["values"])) for r in spark.read.parquet(path).collect()] == [(1, 2, 3, [3.0, 4.0])]


def test_tiles_stored_more_than_once(spark):
    """The cases of the last review: a null in a passed-through column, repeated stored tiles."""
    address = "`order` int, face int, x long, y long"
    stored = spark.createDataFrame([(3, f, 0, 0, [float(f)] * 64) for f in range(12)] * 2, address + ", values array<float>")
    points = spark.createDataFrame([(1, 10.0, 20.0, "a"), (2, 10.0, 20.0, None), (2, 10.0, 20.0, None), (3, None, 20.0, "b")], "id int, lon double, lat double, note string")
    got = sorted((r["id"], r["note"], r["value"], r["source_order"], r["exact"]) for r in tiles.inspect_points(points, stored, 5, 3, 3).collect())
    value = got[0][2]
    assert value is not None and got == [(1, "a", value, 3, False), (2, None, value, 3, False), (2, None, value, 3, False), (3, "b", None, None, False)]
    wanted = stored.select("order", "face", "x", "y").distinct()
    assert tiles.read_tiles(wanted, stored, 64).count() == 12
    short = stored.unionByName(stored.where("face = 1").selectExpr("`order`", "face", "x", "y", "slice(values, 1, 3) as values"))
    assert all(len(r["values"]) == 64 and r["values"][0] == r["face"] for r in tiles.read_tiles(wanted, short, 64, sparse=False).collect())
    counted = short.withColumn("n_values", F.size("values"))
    assert tuple(tiles.validate_tiles(wanted, counted, 64, repeats=True).first()) == (12, 0, 1, 12)


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_ring_ids_are_bijective_and_sorted_by_latitude(spark, order):
    n = 12 * 4**order
    placed = algebra.cells_to_lonlat(plans.ring_ids(spark.range(n).withColumnRenamed("id", "cell"), order), order).select("ring", "lat").toPandas().sort_values("ring")
    assert placed["ring"].tolist() == list(range(n))
    assert (np.diff(placed["lat"]) <= 1e-9).all()


@pytest.mark.parametrize(("files", "at_once"), [(1, 1), (6, 2), (7, 1)])
def test_stream_sums_do_not_depend_on_batches(spark, tmp_path, files, at_once):
    rows = spark.createDataFrame([(i * 977 % 12288, float(i % 50)) for i in range(3000)], "cell long, value double").repartition(files)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", at_once).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.stream_particles(stream, 5, 3, out, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(out).select("batch").distinct().count() == -(-files // at_once)
    want = {r["cell"]: (r["n"], r["total"]) for r in jobs.particle_state(rows, 5, 3).collect()}
    state = lambda: {r["cell"]: (r["n"], r["total"]) for r in jobs.read_particle_state(spark, out).collect()}
    assert state() == want
    jobs.stream_particles(stream, 5, 3, out, str(tmp_path / "again"))  # the same batches once more, as after a lost checkpoint
    assert state() == want


def test_repeated_requests_come_from_the_cache(spark, tmp_path):
    asked = spark.createDataFrame([(3, i % 2, i % 4, 0) for i in range(40)], "`order` int, face int, x long, y long").repartition(4)
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    filled = []
    jobs.stream_tile_fill(stream, lambda t: filled.append(t.count()) or t, str(tmp_path / "cache"), str(tmp_path / "checkpoint"))
    assert len(filled) == 4 and sum(filled) == asked.distinct().count()


def test_a_broken_cache_is_an_error(spark, tmp_path):
    (tmp_path / "part.parquet").write_text("no parquet")
    assert jobs._stored(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception):  # noqa: B017
        jobs._stored(spark, str(tmp_path)).count()


def test_integer_layers_need_a_quantization(spark):
    stats = spark.createDataFrame([("a", 0.0, 1.0, 0.1, 0.9)], "layer string, min double, max double, p1 double, p99 double")
    with pytest.raises(ValueError):
        catalog.write_manifest(stats, "d", 3, 5, 3, "uint16")
    good = catalog.write_manifest(stats, "d", 3, 5, 3, "uint16", quantization={"scale": 0.5, "offset": 0, "nodata": 65535})
    assert catalog.manifest_check(good).count() == 0
