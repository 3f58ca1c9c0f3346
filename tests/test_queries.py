"""Registered queries against their SQL twins, and properties that SQL does not state."""

import math
import os

import duckdb
import pytest

from spheretiles.operators import algebra
from spheretiles.operators.tiles import enumerate_tiles
from spheretiles.plans import registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return str(v)


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("axes", ["even_x", "odd_x"])
@pytest.mark.parametrize("order", [0, 1, 5, 13, 29])
def test_ids_round_trip(spark, order, axes):
    n = 12 << (2 * order)
    ids = spark.createDataFrame([(i,) for i in sorted({0, n // 3, n // 2, n - 1, 7 * n // 12})], "id long")
    there = algebra.nested_to_cell(ids, order, "id", axes)
    assert algebra.cell_to_nested(there, order, axes).where("id <> cell or ix >= {0} or iy >= {0} or face not between 0 and 11".format(1 << order)).isEmpty()


def test_position_inverts_centre(spark):
    cells = spark.range(12 * 4**5).withColumnRenamed("id", "cell0")
    at = algebra.cells_to_lonlat(cells, 5, "cell0").select("cell0", "lon", "lat").toPandas()
    back = algebra.points_to_cells(spark.createDataFrame(at), 5).select("cell0", "cell").toPandas()
    assert len(back) == 12 * 4**5 and (back["cell0"] == back["cell"]).all()


def test_children_tile_their_parent(spark):
    tiles = enumerate_tiles(spark, 4, 4, 3)
    children = algebra.tile_children(tiles)
    assert children.count() == 4 * tiles.count() == children.distinct().count()
    assert algebra.tile_parent(children, 0).select("face", "parent_x", "parent_y").distinct().count() == tiles.count()


def test_adaptive_cover_is_disjoint_and_whole(spark):
    roots = enumerate_tiles(spark, 4, 4, 3)
    cover = algebra.tiles_in_cone_adaptive(roots, 3, (0.48, 0.6, 0.64), 6, 0.2)
    at_six = cover.selectExpr("face", "`order`", "x", "y", "power(4, 6 - `order`) as n").groupBy().sum("n").first()[0]
    assert at_six == 12 * 8 * 8


def test_unknown_axes_are_refused(spark):
    with pytest.raises(ValueError):
        algebra.nested_to_cell(spark.range(1), 3, "id", "sideways")
