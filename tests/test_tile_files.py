"""The sink of tile files: bytes on disk, tasks that run twice, jobs that fail."""

import os

import numpy as np
import pyarrow as pa
import pytest

from spheretiles.operators import tiles
from spheretiles.sources import tile_files as S

SCHEMA = "layer string, `order` int, face int, x long, y long, values array<float>"


def rows(spark, n=40, add=0.0):
    return spark.createDataFrame([("a" if i % 3 else "b", 5, i % 12, i // 12, i % 7, [i + add, float("nan")]) for i in range(n)], SCHEMA).repartition(5)


def on_disk(path):
    found = {}
    for top, _, names in os.walk(path):
        for n in names:
            with open(os.path.join(top, n), "rb") as f:
                found[os.path.relpath(os.path.join(top, n), path)] = f.read()
    return {k: v for k, v in found.items() if not k.endswith(".crc")}


def wanted(df, dtype="<f4"):
    return {f"layers/{r['layer']}/{r['order']}/{r['face']}/{r['x']}/{r['y']}.bin": np.array(r["values"], dtype).tobytes() for r in df.collect()}


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_files_equal_the_tiles(spark, tmp_path, scheme):
    path = str(tmp_path / "out")
    tiles.export_tile_files(rows(spark), scheme + path, dtype="<f8")
    found = on_disk(path)
    assert b'"files": 40' in found.pop("_SUCCESS")
    assert found == wanted(rows(spark), "<f8")
    back = S.read_tile_files(spark, path, "<f8")
    same = lambda df: sorted(repr((r["layer"], r["order"], r["face"], r["x"], r["y"], list(r["values"]))) for r in df.collect())
    assert same(back) == same(rows(spark))


def test_old_files_stay_without_force_and_go_with_it(spark, tmp_path):
    path = str(tmp_path / "out")
    tiles.export_tile_files(rows(spark), path)
    with pytest.raises(Exception, match="already"):
        tiles.export_tile_files(rows(spark, add=1.0), path)
    assert set(on_disk(path)) - {"_SUCCESS"} == set(wanted(rows(spark)))
    tiles.export_tile_files(rows(spark, 10, 1.0), path, force=True)
    assert {k: v for k, v in on_disk(path).items() if k != "_SUCCESS"} == wanted(rows(spark, 10, 1.0))


def test_a_task_that_runs_twice_leaves_the_same_files(spark, tmp_path):
    path = str(tmp_path / "out")
    writer = S.TileFileWriter(path, "<f4", False)
    batches = [pa.RecordBatch.from_pandas(rows(spark).toPandas())]
    halfway = iter(batches)

    def lost():
        yield next(halfway).slice(0, 7)
        raise OSError("executor lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(lost())
    assert not os.path.exists(f"{path}/layers")
    told = [writer.write(iter(batches)), writer.write(iter(batches))]  # a speculative copy
    writer.commit(told[:1])
    assert {k: v for k, v in on_disk(path).items() if k != "_SUCCESS"} == wanted(rows(spark))


def test_a_job_that_fails_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "out")
    tiles.export_tile_files(rows(spark), path)
    before = on_disk(path)
    from pyspark.sql import functions as F

    bad = rows(spark, add=5.0).withColumn("values", F.when(F.col("face") < 11, F.col("values")))
    with pytest.raises(Exception):  # noqa: B017
        tiles.export_tile_files(bad, path, force=True)
    assert on_disk(path) == before


def test_a_tile_that_comes_twice_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="twice"):
        tiles.export_tile_files(rows(spark).unionAll(rows(spark)), str(tmp_path / "out"))
