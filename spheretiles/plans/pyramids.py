"""Queries on sources, aggregations and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import codec, raster
from ..operators.algebra import cell_to_tile
from ..sources import tables as S
from . import fixtures as X
from .fixtures import MAP_ORDER, ORDER, SHIFT, even, morton, odd, sql
from .registry import query

D = "double"


def as_double(df, *names):
    return df.withColumns({n: F.col(n).cast(D) for n in names})


# --- sources


@query("read_flat_map", sql("dense_map", "SELECT cell, value::DOUBLE AS value, 6 AS map_order FROM dense_map"))
def _(spark, d):
    df, order = S.read_flat_map(X.dense_map(spark, d))
    return as_double(df, "value").withColumn("map_order", F.lit(order))


def blocks(spark, d, block_order=3):
    each = 4 ** (MAP_ORDER - block_order)
    rows = X.dense_map(spark, d).groupBy(F.floor(F.col("cell") / each).alias("block"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda s: s["value"]).alias("values"))


@query("read_block_map", sql("dense_map", "SELECT cell, value::DOUBLE AS value, 6 AS map_order FROM dense_map"))
def _(spark, d):
    df, order = S.read_block_map(blocks(spark, d))
    return as_double(df, "value").withColumn("map_order", F.lit(order))


@query("read_face_grid", sql("dense_map", "SELECT cell, value::DOUBLE AS value, 6 AS map_order FROM dense_map"))
def _(spark, d):
    from ..operators.algebra import nested_to_cell

    rows = nested_to_cell(X.dense_map(spark, d), MAP_ORDER).groupBy("face", "iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "value"))), lambda s: s["value"]).alias("values"))
    df, order = S.read_face_grid(rows)
    return as_double(df, "value").withColumn("map_order", F.lit(order))


_RING = f"""SELECT cell, CAST(before + CASE WHEN jp > 4*64 THEN jp - 4*64 WHEN jp < 1 THEN jp + 4*64 ELSE jp END - 1 AS BIGINT) AS ring FROM (
 SELECT *, CASE WHEN jr < 64 THEN 2*nr*(nr-1) WHEN jr > 192 THEN 12*64*64 - 2*nr*(nr+1) ELSE 2*64*63 + 256*(jr-64) END AS before,
  (p*nr + ix - iy + 1 + CASE WHEN jr < 64 OR jr > 192 THEN 0 ELSE (jr - 64) & 1 END) // 2 AS jp FROM (
 SELECT *, CASE WHEN jr < 64 THEN jr WHEN jr > 192 THEN 256 - jr ELSE 64 END AS nr FROM (
 SELECT *, r*64 - ix - iy - 1 AS jr FROM (
 SELECT cell, [2,2,2,2,3,3,3,3,4,4,4,4][cell // 4096 + 1] AS r, [1,3,5,7,0,2,4,6,1,3,5,7][cell // 4096 + 1] AS p, {even("cell % 4096", 6)} AS ix, {odd("cell % 4096", 6)} AS iy FROM dense_map))))"""


@query("read_ring_map", sql("dense_map", "SELECT r.cell, m.value::DOUBLE AS value FROM rings r JOIN dense_map m ON r.ring = m.cell", rings=_RING))
def _(spark, d):
    df, _ = S.read_ring_map(X.dense_map(spark, d).withColumnRenamed("cell", "ring"))
    return as_double(df, "value")


@query("read_particles", sql("particles", "SELECT cell, value::DOUBLE AS value FROM particles"))
def _(spark, d):
    return as_double(X.particles(spark, d), "value")


@query("read_cube_slice", sql("cube", """SELECT cell, value::DOUBLE AS value FROM cube WHERE "time" = 1 AND "level" = 1"""))
def _(spark, d):
    return as_double(S.read_cube_slice(X.cube(spark, d), {"Time": -1, "1": 1}), "value")


def stored_cube(spark, d):
    """The cube as face rows, stored by time and level."""
    from ..sources.cube import cube_rows, read_cube, write_cube
    from ..sources.scratch import folder

    path = folder(spark)
    write_cube(cube_rows(X.cube(spark, d), MAP_ORDER), path)
    return read_cube(spark, path)


@query("read_cube_slice_stored", sql("cube", """SELECT cell, value::DOUBLE AS value FROM cube WHERE "time" = 1 AND "level" = 1"""))
def _(spark, d):
    from ..sources.cube import slice_cells

    return as_double(slice_cells(stored_cube(spark, d), {"Time": -1, "1": 1}, MAP_ORDER), "value")


@query("read_raster", sql("raster", """SELECT "row", col, CASE WHEN value = -99999 THEN 'NaN'::DOUBLE ELSE value::DOUBLE END AS value, 'gridline' AS registration FROM raster"""))
def _(spark, d):
    df, info = S.read_raster(X.raster(spark, d), -99999)
    return as_double(df, "value").withColumn("registration", F.lit(info["registration"]))


@query(
    "mosaic_raster",
    """SELECT CAST(round((90 - north) / 15.0) * 4 + part AS BIGINT) AS "row", CAST(round((west + 180) / 15.0) * 4 + o_orderkey % 4 AS BIGINT) AS col, count(*) AS n, min(o_totalprice) AS low
 FROM (SELECT *, (o_orderkey // 4) % 4 AS part, 90 - 15 * (o_custkey % 12) AS north, -180 + 15 * (o_orderkey % 24) AS west FROM orders) GROUP BY 1, 2""",
)
def _(spark, d):
    """Pieces of 15 degrees with 4 x 4 pixels, named by their north-west corner."""
    north, west = 90 - 15 * (F.col("o_custkey") % 12), -180 + 15 * (F.col("o_orderkey") % 24)
    name = F.format_string("grid_%s%02d%s%03d_surface", F.when(north >= 0, "N").otherwise("S"), F.abs(north), F.when(west >= 0, "E").otherwise("W"), F.abs(west))
    pieces = X.table(spark, d, "orders").select(name.alias("name"), (F.floor(F.col("o_orderkey") / 4) % 4).alias("row"), (F.col("o_orderkey") % 4).alias("col"), F.col("o_totalprice").alias("value"))
    return S.mosaic_raster(pieces, 3.75).groupBy("row", "col").agg(F.count("*").alias("n"), F.min("value").alias("low"))


# --- filters


@query("finite_filter", sql("raw_particles", "SELECT cell, value::DOUBLE AS value FROM raw_particles WHERE NOT isnan(value) AND NOT isinf(value)"))
def _(spark, d):
    return as_double(X.raw_particles(spark, d).where(S.finite("value")), "value")


@query("valid_cell_filter", sql("raw_particles", "SELECT count(*) AS n, sum(cell)::BIGINT AS cells FROM raw_particles WHERE cell >= 0 AND cell < 12582912"))
def _(spark, d):
    return S.read_particles(X.raw_particles(spark, d), ORDER, value=None).agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))


# --- aggregations


@query("particle_count", sql("particles", "SELECT cell >> 8 AS cell, count(*) AS n FROM particles GROUP BY 1"))
def _(spark, d):
    return A.particle_count(X.particles(spark, d), ORDER, 6)


@query("particle_sum", sql("particles", "SELECT cell >> 8 AS cell, sum(value::DOUBLE) AS total FROM particles GROUP BY 1"))
def _(spark, d):
    return A.particle_sum(X.particles(spark, d), ORDER, 6)


_TILED = f"""SELECT CAST(cell // 4096 AS INTEGER) AS face, {even("cell % 4096", 6)} AS ix, {odd("cell % 4096", 6)} AS iy, value FROM means"""


@query(
    "particle_mean",
    sql(
        "particles",
        """SELECT 6 AS "order", face, ix // 8 AS x, iy // 8 AS y, (iy % 8) * 8 + ix % 8 AS local_index, value::DOUBLE AS value FROM placed""",
        means="SELECT cell >> 8 AS cell, CAST(sum(value::DOUBLE) / count(*) AS FLOAT) AS value FROM particles GROUP BY 1",
        placed=_TILED,
    ),
)
def _(spark, d):
    placed = cell_to_tile(A.particle_mean(X.particles(spark, d), ORDER, 6), 6, SHIFT)
    return as_double(placed.select(F.lit(6).alias("order"), "face", "x", "y", "local_index", "value"), "value")


_PYRAMID = " UNION ALL ".join(f"""SELECT {o} AS "order", cell >> {2 * (ORDER - o)} AS cell, count(*) AS n, sum(value::DOUBLE) AS total, CAST(CAST(sum(value::DOUBLE) / count(*) AS FLOAT) AS DOUBLE) AS value FROM {{src}} GROUP BY 2""" for o in (4, 5, 6, 7))


@query("particle_pyramid", sql("particles", _PYRAMID.format(src="particles")))
def _(spark, d):
    return as_double(A.particle_pyramid(X.particles(spark, d), ORDER, 4, 7), "value")


@query("particle_pyramid_clustered", sql("clustered", _PYRAMID.format(src="clustered")))
def _(spark, d):
    return as_double(A.particle_pyramid(X.clustered(spark, d), ORDER, 4, 7), "value")


@query(
    "mean_pyramid",
    sql("dense_map", " UNION ALL ".join(f"""SELECT {o} AS "order", cell >> {2 * (6 - o)} AS cell, coalesce(CAST(CAST(avg(value::DOUBLE) FILTER (NOT isnan(value)) AS FLOAT) AS DOUBLE), 'NaN'::DOUBLE) AS value FROM dense_map GROUP BY 2""" for o in (3, 4, 5, 6))),
)
def _(spark, d):
    return as_double(A.mean_pyramid(X.dense_map(spark, d), MAP_ORDER, 3), "value")


@query("slice_pyramid", sql("cube", """SELECT cell >> 4 AS cell, coalesce(CAST(CAST(avg(value::DOUBLE) FILTER (NOT isnan(value)) AS FLOAT) AS DOUBLE), 'NaN'::DOUBLE) AS value FROM cube WHERE "time" = 0 AND "level" = 2 GROUP BY 1"""))
def _(spark, d):
    return as_double(A.slice_pyramid(X.cube(spark, d), {"time": 0, "level": -1}, MAP_ORDER, 4, SHIFT), "value")


_GAPS = """SELECT 6 AS "order", t.face, t.x, t.y, r.range AS local_index, coalesce(p.n, 0)::DOUBLE AS value FROM (SELECT DISTINCT face, ix // 8 AS x, iy // 8 AS y FROM placed) t, range(64) r
 LEFT JOIN (SELECT face, ix // 8 AS x, iy // 8 AS y, (iy % 8) * 8 + ix % 8 AS i, value AS n FROM placed) p ON p.face = t.face AND p.x = t.x AND p.y = t.y AND p.i = r.range"""


def _counts(spark, d):
    counts = A.particle_count(X.clustered(spark, d), ORDER, 6)
    return counts.select("cell", F.col("n").cast("float").alias("value"))


@query("assemble_tiles", sql("clustered", _GAPS, means="SELECT cell >> 8 AS cell, count(*) AS value FROM clustered GROUP BY 1", placed=_TILED))
def _(spark, d):
    tiles = A.assemble_tiles(_counts(spark, d), 6, SHIFT, empty=0)
    return as_double(tiles.select("order", "face", "x", "y", F.posexplode("values").alias("local_index", "value")).withColumn("local_index", F.col("local_index").cast("long")), "value")


@query("assemble_tiles_arrow", sql("clustered", _GAPS, means="SELECT cell >> 8 AS cell, count(*) AS value FROM clustered GROUP BY 1", placed=_TILED))
def _(spark, d):
    tiles = A.assemble_tiles_arrow(_counts(spark, d), 6, SHIFT, empty=0)
    return as_double(tiles.select("order", "face", "x", "y", F.posexplode("values").alias("local_index", "value")).withColumn("local_index", F.col("local_index").cast("long")), "value")


def placed_pyramid(spark, d):
    """(order, face, x, y, local_index, value) of orders 5 and 6."""
    p = A.particle_pyramid(X.particles(spark, d), ORDER, 5, 6)
    out = None
    for o in (5, 6):
        part = cell_to_tile(p.where(F.col("order") == o).select("cell", "value"), o, SHIFT).select(F.lit(o).alias("order"), "face", "x", "y", "local_index", "value")
        out = part if out is None else out.unionByName(part)
    return out


_PLACED = " UNION ALL ".join(
    f"""SELECT {o} AS "order", CAST(c // {4**o} AS INTEGER) AS face, {even(f'c % {4**o}', o)} // 8 AS x, {odd(f'c % {4**o}', o)} // 8 AS y, ({odd(f'c % {4**o}', o)} % 8) * 8 + {even(f'c % {4**o}', o)} % 8 AS local_index, value
 FROM (SELECT cell >> {2 * (ORDER - o)} AS c, CAST(sum(value::DOUBLE) / count(*) AS FLOAT) AS value FROM particles GROUP BY 1)"""
    for o in (5, 6)
)
_SAMPLED = """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY "order", face, x, y) AS n, row_number() OVER (PARTITION BY "order", face, x, y ORDER BY local_index) - 1 AS i FROM placed WHERE NOT isnan(value)) WHERE i % greatest(1, n // 20) = 0"""


@query("stride_sample", sql("particles", """SELECT "order", face, x, y, local_index, value::DOUBLE AS value FROM sampled""", placed=_PLACED, sampled=_SAMPLED))
def _(spark, d):
    return as_double(A.stride_sample(placed_pyramid(spark, d), 20), "value")


_STATS = """SELECT a.low AS "min", a.high AS "max", s.p1, s.p50, s.p99 FROM (SELECT min(value)::DOUBLE AS low, max(value)::DOUBLE AS high FROM placed WHERE NOT isnan(value)) a,
 (SELECT quantile_cont(value::DOUBLE, 0.01) AS p1, quantile_cont(value::DOUBLE, 0.5) AS p50, quantile_cont(value::DOUBLE, 0.99) AS p99 FROM sampled) s"""


@query("layer_stats", sql("particles", _STATS.replace("s.p1, s.p50, s.p99", "round(s.p1, 6) AS p1, round(s.p50, 6) AS p50, round(s.p99, 6) AS p99"), placed=_PLACED, sampled=_SAMPLED.replace("n // 20", "n // 2048")))
def _(spark, d):
    s = as_double(A.layer_stats(placed_pyramid(spark, d)), "min", "max")
    return s.withColumns({p: F.round(p, 6) for p in ("p1", "p50", "p99")})


@query("order_stats", sql("particles", """SELECT "order", min(value)::DOUBLE AS "min", max(value)::DOUBLE AS "max", count(DISTINCT ("order", face, x, y)) AS tiles FROM placed GROUP BY ROLLUP ("order")""", placed=_PLACED))
def _(spark, d):
    return as_double(A.order_stats(placed_pyramid(spark, d)), "min", "max")


@query("finite_range", sql("dense_map", """SELECT min(value)::DOUBLE AS "min", max(value)::DOUBLE AS "max" FROM dense_map WHERE NOT isnan(value)"""))
def _(spark, d):
    return as_double(X.dense_map(spark, d).where(S.finite("value")).agg(F.min("value").alias("min"), F.max("value").alias("max")), "min", "max")


@query("auto_max_order", sql("particles", "SELECT count(*) AS particles, CAST(least(10, greatest(3, ceil(ln(greatest(1.0, count(*) / 4.0 / 12)) / ln(4.0)))) AS INTEGER) AS max_order FROM particles"))
def _(spark, d):
    return A.auto_max_order_table(X.particles(spark, d), ORDER, SHIFT, 4.0)


# --- encodings

def _q_sql(select: str) -> str:
    return sql("dense_map", select, q="SELECT min(value)::DOUBLE AS low, max(value)::DOUBLE AS high FROM dense_map WHERE NOT isnan(value)")


_U16 = "CASE WHEN isnan(value) THEN 65535 ELSE CAST(least(greatest(round_even((value::DOUBLE - low) / ((high - low) / 65534), 0), 0.0), 65534.0) AS INTEGER) END"
_I16 = "CASE WHEN isnan(value) THEN -32768 ELSE CAST(least(greatest(round_even((value::DOUBLE - (low + high) / 2) / ((high - low) / 65534), 0), -32767.0), 32767.0) AS INTEGER) END"


@query("quantize_layer", _q_sql(f"SELECT cell, {_U16} AS code FROM dense_map, q"))
def _(spark, d):
    return codec.quantize_layer(X.dense_map(spark, d))[0].select("cell", "code")


@query("dequantize_layer", _q_sql(f"SELECT cell, CASE WHEN code = 65535 THEN 'NaN'::DOUBLE ELSE CAST(CAST(code * ((high - low) / 65534) + low AS FLOAT) AS DOUBLE) END AS decoded FROM (SELECT cell, {_U16} AS code FROM dense_map, q), q"))
def _(spark, d):
    coded, q = codec.quantize_layer(X.dense_map(spark, d))
    return as_double(codec.dequantize_layer(coded, q).select("cell", "decoded"), "decoded")


_REQUANTIZED = _q_sql(f"""SELECT CAST(cell // 4096 AS INTEGER) AS face, {even("cell % 4096", 6)} // 8 AS x, {odd("cell % 4096", 6)} // 8 AS y, ({odd("cell % 4096", 6)} % 8) * 8 + {even("cell % 4096", 6)} % 8 AS local_index, {_I16} AS code FROM dense_map, q""")


@query("requantize_layer", _REQUANTIZED)
def _(spark, d):
    tiles = A.assemble_tiles(X.dense_map(spark, d), MAP_ORDER, SHIFT)
    coded, _ = codec.requantize_layer(tiles)
    return coded.select("face", "x", "y", F.posexplode("codes").alias("local_index", "code")).withColumn("local_index", F.col("local_index").cast("long"))


@query("requantize_stored_layer", _REQUANTIZED)
def _(spark, d):
    """A stored layer, put in place of itself as codes."""
    from ..operators.layers import LayerStore
    from ..sources.scratch import folder

    store = LayerStore(spark, folder(spark))
    store.write("price", A.assemble_tiles(X.dense_map(spark, d), MAP_ORDER, SHIFT))
    store.requantize("price")
    return store.stored("price").select("face", "x", "y", F.posexplode("codes").alias("local_index", "code")).withColumn("local_index", F.col("local_index").cast("long"))


def _t_sql(expr: str) -> str:
    return f"CASE WHEN isnan(value) THEN 'NaN'::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {expr})) END"


_LOW, _HIGH = 2000.0, 90000.0
_T = {
    "linear": _t_sql("(value::DOUBLE - 2000) / 88000"),
    "log": _t_sql("(ln(greatest(value::DOUBLE, 2000.0)) - ln(2000.0)) / (ln(90000.0) - ln(2000.0))"),
    "symlog": _t_sql("(sign(value::DOUBLE) * ln(1 + abs(value::DOUBLE) / 0.03) - ln(1 + 2000.0 / 0.03)) / (ln(1 + 90000.0 / 0.03) - ln(1 + 2000.0 / 0.03))"),
}


@query("normalize_values", sql("dense_map", "SELECT cell, " + ", ".join(f"round({_T[k]}, 9) AS t_{k}" for k in _T) + " FROM dense_map"))
def _(spark, d):
    df = X.dense_map(spark, d)
    for k in _T:
        df = codec.normalize_values(df, _LOW, _HIGH, k).withColumn(f"t_{k}", F.round("t", 9)).drop("t")
    return df.drop("value")


def _stops_sql(name: str, which: int, t: str) -> str:
    table = codec.stops(name)
    whens = " ".join(f"WHEN {t} <= {b[0]} THEN floor({a[which + 1]} + ({b[which + 1] - a[which + 1]}) * (({t} - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE)) + 0.5)" for a, b in zip(table, table[1:], strict=False))
    return f"CAST(CASE WHEN isnan({t}) THEN {codec.NO_VALUE[which]} {whens} ELSE {table[-1][which + 1]} END AS INTEGER)"


def _turbo_sql(which: int, t: str) -> str:
    k = codec.TURBO["rgb"[which]]
    total = f"{k[-1]}::DOUBLE"
    for c in k[-2::-1]:
        total = f"({c}::DOUBLE + {t} * {total})"
    return f"CAST(CASE WHEN isnan({t}) THEN {codec.NO_VALUE[which]} ELSE least(255, greatest(0, floor({total} + 0.5))) END AS INTEGER)"


@query(
    "colour_values",
    sql("dense_map", " UNION ALL ".join(f"SELECT '{n}' AS map, cell, " + ", ".join(f"{_turbo_sql(i, 't') if n == 'turbo' else _stops_sql(n, i, 't')} AS {c}" for i, c in enumerate("rgb")) + ", CASE WHEN isnan(t) THEN 0 ELSE 255 END AS a FROM scaled" for n in ("viridis", "magma", "balance", "turbo")), scaled=f"SELECT cell, {_T['linear']} AS t FROM dense_map"),
)
def _(spark, d):
    scaled = codec.normalize_values(X.dense_map(spark, d), _LOW, _HIGH).drop("value")
    out = None
    for n in ("viridis", "magma", "balance", "turbo"):
        part = codec.colour_values(scaled, n).select(F.lit(n).alias("map"), "cell", "r", "g", "b", "a")
        out = part if out is None else out.unionByName(part)
    return out


_BESIDE = "CASE WHEN {c} IS NULL OR isnan({c}) THEN v ELSE {c} END"
_SHADE = f"""SELECT face, x, y, ix, iy, a, """ + ", ".join(f"CASE WHEN a > 0 THEN CAST(least(255, greatest(0, floor(round({c} * s, 9) + 0.5))) AS INTEGER) ELSE {c} END AS {c}" for c in "rgb") + f""" FROM (
 SELECT *, CASE WHEN isnan(v) THEN 1.0 ELSE least(1.18, greatest(0.58, 0.78 + 0.34 * ((-dx * -0.45 - dy * -0.55 + 0.72) / sqrt(0.45*0.45 + 0.55*0.55 + 0.72*0.72)) / sqrt(dx*dx + dy*dy + 1))) END AS s FROM (
 SELECT *, ({_BESIDE.format(c="e")} - {_BESIDE.format(c="w")}) * 0.5 * 0.006 AS dx, ({_BESIDE.format(c="dn")} - {_BESIDE.format(c="up")}) * 0.5 * 0.006 AS dy FROM (
 SELECT *, lag(v) OVER (PARTITION BY face, x, y, iy ORDER BY ix) AS w, lead(v) OVER (PARTITION BY face, x, y, iy ORDER BY ix) AS e, lag(v) OVER (PARTITION BY face, x, y, ix ORDER BY iy) AS up, lead(v) OVER (PARTITION BY face, x, y, ix ORDER BY iy) AS dn FROM (
 SELECT face, ix // 8 AS x, iy // 8 AS y, ix % 8 AS ix, iy % 8 AS iy, value::DOUBLE AS v, """ + ", ".join(f"{_stops_sql('viridis', i, 't')} AS {c}" for i, c in enumerate("rgb")) + f""", CASE WHEN isnan(t) THEN 0 ELSE 255 END AS a FROM (SELECT CAST(cell // 4096 AS INTEGER) AS face, {even("cell % 4096", 6)} AS ix, {odd("cell % 4096", 6)} AS iy, value, {_T['linear']} AS t FROM dense_map)))))"""  # fmt: skip


@query("shade_tiles", sql("dense_map", _SHADE))
def _(spark, d):
    from ..functions import cells as C

    scaled = cell_to_tile(codec.normalize_values(X.dense_map(spark, d), _LOW, _HIGH), MAP_ORDER, SHIFT)
    inside = scaled.withColumns({"order": F.lit(MAP_ORDER), "ix": C.low_bits("local_index", SHIFT), "iy": C.down("local_index", SHIFT)})
    return codec.shade_tiles(inside).select("face", "x", "y", "ix", "iy", "a", "r", "g", "b")


# --- rasters


def _centres(source: str, order: int) -> str:
    from .algebra import CENTRES

    return CENTRES.format(src=source, order=order, n=1 << order, count=4**order)


def _resample_sql(height: int, width: int, kind: str) -> str:
    cycle = width - 1 if kind == "gridline" else width
    px = f"((lon + 180) * {cycle} / 360)" if kind == "gridline" else f"((lon + 180) * {width} / 360 - 0.5)"
    py = f"(90 - lat) * {height - 1} / 180" if kind == "gridline" else f"(90 - lat) * {height} / 180 - 0.5"
    w = lambda t: f"[(-{t} + 2*{t}*{t} - {t}*{t}*{t}) / 2, (2 - 5*{t}*{t} + 3*{t}*{t}*{t}) / 2, ({t} + 4*{t}*{t} - 3*{t}*{t}*{t}) / 2, ({t}*{t}*{t} - {t}*{t}) / 2]"
    name = "raster" if kind == "gridline" else "raster_pixel"
    return sql(
        f"{name}",
        f"""SELECT cell, round(sum(w * CASE WHEN g.value = -99999 THEN 'NaN'::DOUBLE ELSE g.value::DOUBLE END), 3) AS value FROM (
 SELECT cell, CAST(least(greatest(y1 + j.range - 1, 0), {height - 1}) AS BIGINT) AS "row", CAST(((x1 + i.range - 1) % {cycle} + {cycle}) % {cycle} AS BIGINT) AS col, {w("tx")}[i.range + 1] * {w("ty")}[j.range + 1] AS w
 FROM (SELECT *, px - x1 AS tx, py - y1 AS ty FROM (SELECT *, floor(px) AS x1, floor(py) AS y1 FROM (SELECT cell, {px} - {cycle} * floor({px} / {cycle}) AS px, least(greatest({py}, 0.0), {height - 1}.0) AS py FROM centres))), range(4) i, range(4) j) a
 JOIN {name} g ON g."row" = a."row" AND g.col = a.col GROUP BY cell""",
        centres=_centres("(SELECT range AS cell FROM range(0, 3072))", 4),
    )


def _resampled(spark, d, height, width):
    r, info = S.read_raster(X.raster(spark, d, height, width), -99999)
    cells = spark.range(3072).withColumnRenamed("id", "cell")
    return raster.resample_raster(r, info, cells, 4).select("cell", F.round(F.col("value").cast(D), 3).alias("value"))


@query("resample_raster", _resample_sql(19, 37, "gridline"))
def _(spark, d):
    return _resampled(spark, d, 19, 37)


@query("resample_raster_pixel", _resample_sql(18, 36, "pixel"))
def _(spark, d):
    return _resampled(spark, d, 18, 36)


def _fine_sql(height: int, width: int, kind: str) -> str:
    """The twin of a raster of height x width and the particles' own cells at their order."""
    old, here = (f"raster{'' if kind == 'gridline' else '_pixel'}", "raster_fine" if kind == "gridline" else "raster_fine_pixel")
    text = _resample_sql(height, width, kind).replace(f"JOIN {old} g", f"JOIN {here} g").replace(f"WITH {old} AS ({X.CTE[old]})", f"WITH {here} AS ({X.CTE[here]}), raw_particles AS ({X.CTE['raw_particles']}), particles AS ({X.CTE['particles']})")
    small = _centres("(SELECT range AS cell FROM range(0, 3072))", 4)
    if small not in text:
        raise ValueError("no centres to exchange")
    return text.replace(small, _centres("(SELECT DISTINCT cell FROM particles)", X.ORDER))


def _fine(spark, d, height, width):
    r, info = S.read_raster(X.fine_raster(spark, d, height, width), -99999)
    return raster.resample_raster(r, info, X.particles(spark, d).select("cell").distinct(), X.ORDER).select("cell", F.round(F.col("value").cast(D), 3).alias("value"))


@query("resample_raster_fine", _fine_sql(181, 361, "gridline"))
def _(spark, d):
    """A raster of 181 x 361 pixels at the cells that hold particles: the cells grow with the table."""
    return _fine(spark, d, 181, 361)


@query("resample_raster_fine_pixel", _fine_sql(90, 180, "pixel"))
def _(spark, d):
    return _fine(spark, d, 90, 180)


@query("resample_raster_holes", _resample_sql(19, 37, "gridline").replace("JOIN raster g", "LEFT JOIN raster_holes g").replace("WITH raster AS", f"WITH raster_holes AS ({X.CTE['raster_holes']}), raster AS").replace("CASE WHEN g.value = -99999", "CASE WHEN g.value IS NULL OR g.value = -99999"))
def _(spark, d):
    """A raster without one row and some single pixels: cells near them have no value."""
    r, info = S.read_raster(X.raster(spark, d, 19, 37), -99999)
    holes = r.where("row <> 11 AND (row * 37 + col) % 83 <> 5")
    return raster.resample_raster(holes, info, spark.range(3072).withColumnRenamed("id", "cell"), 4).select("cell", F.round(F.col("value").cast(D), 3).alias("value"))


@query("raster_gaps", sql("raster_holes", 'SELECT count(*) AS pixels, 703 - count(*) AS missing, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS outside FROM raster_holes'))
def _(spark, d):
    r, info = S.read_raster(X.raster(spark, d, 19, 37), -99999)
    return raster.raster_gaps(r.where("row <> 11 AND (row * 37 + col) % 83 <> 5"), info)
