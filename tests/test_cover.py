"""Normal form of selections against brute force over cells, and values that are given once."""

import random

import pytest
from pyspark.errors import PySparkException

from spheretiles.operators import cover, select

SHIFT = 3
TILES = "`order` int, face int, x long, y long"


def bits(x, y):
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(30))


def split(level, i):
    x = sum((i >> 2 * b & 1) << b for b in range(level))
    y = sum((i >> 2 * b + 1 & 1) << b for b in range(level))
    return x, y


def plain(tiles):
    """The normal form of (order, face, x, y), level by level."""
    now = {(o - SHIFT, f * 4 ** (o - SHIFT) + bits(x, y)) for o, f, x, y in tiles}
    above = lambda t: [(t[0] - k, t[1] >> 2 * k) for k in range(1, t[0] + 1)]
    while True:
        now = {t for t in now if not any(a in now for a in above(t))}
        full = {(lv - 1, i >> 2) for lv, i in now if lv and all((lv, i >> 2 << 2 | k) in now for k in range(4))}
        if not full:
            break
        now |= full
    return sorted((lv + SHIFT, i >> 2 * lv, *split(lv, i & (4**lv - 1))) for lv, i in now)


def made(seed, deepest):
    draw, out = random.Random(seed), []
    for _ in range(60):
        level = draw.randrange(deepest + 1)
        i = draw.choice([0, 5, 11]) * 4**level + draw.randrange(4 ** min(level, 3)) * 4 ** max(0, level - 3)
        out.append((level, i))
        if draw.random() < 0.5 and level < deepest:  # all that lies in it, at one or two levels below
            for k in range(4):
                out += [(level + 1, i * 4 + k)] if draw.random() < 0.6 or level + 2 > deepest else [(level + 2, (i * 4 + k) * 4 + j) for j in range(4)]
    return [(lv + SHIFT, i >> 2 * lv, *split(lv, i & (4**lv - 1))) for lv, i in out]


@pytest.mark.parametrize(("seed", "deepest"), [(1, 2), (2, 5), (3, 9), (4, 18), (5, 25)])
def test_normal_form_equals_brute_force(spark, seed, deepest):
    tiles = made(seed, deepest)
    small = [t for t in tiles if draw_keeps(t, seed)]
    got = cover.normal_form(spark.createDataFrame(small + small[:9], TILES), SHIFT)
    assert sorted(map(tuple, got.collect())) == plain(small)


def draw_keeps(tile, seed):
    """Leaves out the coarsest tiles, so that siblings below them have something to merge to."""
    return tile[0] > SHIFT or seed % 2 == 0


def test_a_whole_sphere_of_fine_tiles_is_twelve(spark):
    n = 12 * 4**9
    ids = spark.range(n).selectExpr("cast(12 as int) as `order`", f"cast(id div {4**9} as int) as face", f"(id % {4**9}) div 512 as x", f"(id % {4**9}) % 512 as y")
    assert sorted(map(tuple, cover.normal_form(ids, SHIFT).collect())) == [(3, f, 0, 0) for f in range(12)]


def test_edges(spark):
    none = spark.createDataFrame([], TILES)
    assert cover.normal_form(none, SHIFT).collect() == [] and cover.cover_cells(none, SHIFT, 6).collect() == []
    odd = spark.createDataFrame([(3, 0, 0, 0), (None, 1, 0, 0), (4, None, 0, 0), (4, 0, 1, 1)], TILES)
    assert list(map(tuple, cover.normal_form(odd, SHIFT).collect())) == [(3, 0, 0, 0)]
    with pytest.raises(PySparkException, match="below the tile shift"):
        cover.normal_form(spark.createDataFrame([(2, 0, 0, 0)], TILES), SHIFT).collect()
    with pytest.raises(ValueError, match="over 100"):
        cover.cover_cells(odd.where("face = 0 and `order` = 3"), SHIFT, 6, max_cells=100)


def test_overlapping_tiles_give_each_value_once(spark):
    """The selections of the last review: 16 values from both readers."""
    picked = spark.createDataFrame([(3, 0, 0, 0), (3, 0, 0, 0), (2, 0, 0, 0)], TILES)
    field = spark.range(12 * 4**3).selectExpr("id as cell", "cast(id as float) as value")
    blocks = field.groupBy((field["cell"] / 16).cast("long").alias("block")).agg({"value": "collect_list"}).withColumnRenamed("collect_list(value)", "values")
    blocks = blocks.selectExpr("block", "array_sort(values) as values")
    for shift, order in ((1, 3), (2, 3)):
        nested = sorted(map(tuple, select.select_values_nested(field, picked, shift, order).collect()))
        block = sorted(map(tuple, select.select_values_block(blocks, picked, shift, order, 1).collect()))
        assert nested == block and len(nested) == len(set(nested)) == 4**shift * (4 if shift == 1 else 4)
    with pytest.raises(ValueError, match="coarser"):
        select.select_values_nested(field, picked, 1, 2)
