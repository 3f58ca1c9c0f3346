"""Queries on cell algebra, geometry and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra as O
from ..operators.tiles import enumerate_tiles
from ..sources.tables import ring_ids
from . import fixtures as X
from .fixtures import ORDER, even, morton, odd, sql
from .registry import query

R, P = "[2,2,2,2,3,3,3,3,4,4,4,4]", "[1,3,5,7,0,2,4,6,1,3,5,7]"


def r9(df, *names):
    return df.withColumns({n: F.round(n, 9) + 0.0 for n in names})


def point_sql(face: str, u: str, v: str, rest: str, src: str) -> str:
    """Rows of src with z and phi of (face, u, v)."""
    return f"""SELECT {rest}, z, CASE WHEN ring < 1 THEN near + (raw - near) / ring WHEN ring > 3 THEN near + (raw - near) / (4 - ring) ELSE raw END AS phi FROM (
 SELECT *, CASE WHEN ring <= 1 THEN 1 - ring*ring/3 WHEN ring <= 3 THEN 2*(2-ring)/3 ELSE -1 + (4-ring)*(4-ring)/3 END AS z,
  raw + (2 * floor((raw - 8*floor(raw/8)) / 2) + 1 - (raw - 8*floor(raw/8))) AS near FROM (
 SELECT *, least(greatest({R}[{face} + 1] - ({u}) - ({v}), 0.000001), 3.999999)::DOUBLE AS ring, ({P}[{face} + 1] - ({u}) + ({v}))::DOUBLE AS raw FROM {src}))"""


#: longitude and latitude of cell centres (odd_x) of a source with column cell
CENTRES = (
    """SELECT cell, degrees(atan2(sin(phi * pi() / 4), cos(phi * pi() / 4))) AS lon, degrees(asin(least(1.0, greatest(-1.0, z)))) AS lat, z, phi FROM ("""
    + point_sql("face", "u", "v", "cell", "(SELECT cell, cell // {count} AS face, (" + odd("cell % {count}", "{order}") + " + 0.5)::DOUBLE / {n} AS u, (" + even("cell % {count}", "{order}") + " + 0.5)::DOUBLE / {n} AS v FROM {src})")
    + ")"
)
_PARTS = f"CAST(cell // 1048576 AS INTEGER) AS face, {even('cell % 1048576', 10)} AS ix, {odd('cell % 1048576', 10)} AS iy"


@query("nested_to_cell", sql("particles", f"SELECT cell, {_PARTS} FROM particles"))
def _(spark, d):
    return O.nested_to_cell(X.particles(spark, d).select("cell"), ORDER)


@query("nested_to_cell_odd", sql("particles", "SELECT cell, face, iy AS ix, ix AS iy FROM p", p=f"SELECT cell, {_PARTS} FROM particles"))
def _(spark, d):
    return O.nested_to_cell(X.particles(spark, d).select("cell"), ORDER, axes="odd_x")


@query("cell_to_nested", f"""SELECT CAST(o_orderkey % 12 AS INTEGER) AS face, o_custkey % 1024 AS ix, o_orderkey % 1024 AS iy, (o_orderkey % 12) * 1048576 + {morton("(o_custkey % 1024)", "(o_orderkey % 1024)", 10)} AS cell FROM orders""")
def _(spark, d):
    t = X.table(spark, d, "orders").select((F.col("o_orderkey") % 12).cast("int").alias("face"), (F.col("o_custkey") % 1024).alias("ix"), (F.col("o_orderkey") % 1024).alias("iy"))
    return O.cell_to_nested(t, 10)


@query("parent_cell", sql("particles", "SELECT cell, cell // 256 AS parent FROM particles"))
def _(spark, d):
    return O.parent_cell(X.particles(spark, d).select("cell"), ORDER, 6)


_TILE = "SELECT cell, face, ix // 16 AS x, iy // 16 AS y, (iy % 16) * 16 + ix % 16 AS local_index, (face * 64 + iy // 16) * 64 + ix // 16 AS tile_code FROM p"


@query("cell_to_tile", sql("particles", _TILE, p=f"SELECT cell, {_PARTS} FROM particles"))
def _(spark, d):
    return O.cell_to_tile(X.particles(spark, d).select("cell"), ORDER, 4)


@query("tile_code_decode", sql("particles", "SELECT cell, face, ix // 16 AS x, iy // 16 AS y, (face * 64 + iy // 16) * 64 + ix // 16 AS tile_code FROM p", p=f"SELECT cell, {_PARTS} FROM particles"))
def _(spark, d):
    return O.tile_code_decode(O.cell_to_tile(X.particles(spark, d).select("cell"), ORDER, 4).select("cell", "tile_code"), 64)


@query("tile_parent", sql("stored", """SELECT *, CASE WHEN "order" > 4 THEN "order" - 1 END AS parent_order, CASE WHEN "order" > 4 THEN x // 2 END AS parent_x, CASE WHEN "order" > 4 THEN y // 2 END AS parent_y FROM (SELECT "order", face, x, y FROM stored)"""))
def _(spark, d):
    return O.tile_parent(X.stored(spark, d).drop("n_values"), 4)


@query("tile_children", sql("stored", """SELECT "order" + 1 AS "order", face, x * 2 + i.range AS x, y * 2 + j.range AS y FROM stored, range(2) i, range(2) j"""))
def _(spark, d):
    return O.tile_children(X.stored(spark, d).drop("n_values"))


_ANCESTORS = """SELECT "order", face, x, y, CAST(4 + g.range AS INTEGER) AS source_order, x >> CAST("order" - 4 - g.range AS INTEGER) AS source_x, y >> CAST("order" - 4 - g.range AS INTEGER) AS source_y FROM stored, range(3) g WHERE 4 + g.range <= "order" """


@query("tile_ancestors", sql("stored", _ANCESTORS))
def _(spark, d):
    return O.tile_ancestors(X.stored(spark, d).drop("n_values"), 4)


@query("tile_bounds", sql("stored", """SELECT "order", face, x, y, x / 2.0::DOUBLE ** ("order" - 3) AS u0, (x + 1) / 2.0::DOUBLE ** ("order" - 3) AS u1, y / 2.0::DOUBLE ** ("order" - 3) AS v0, (y + 1) / 2.0::DOUBLE ** ("order" - 3) AS v1 FROM stored"""))
def _(spark, d):
    return O.tile_bounds(X.stored(spark, d).drop("n_values"), 3)


@query("tile_crop", sql("stored", """SELECT *, (x / k - source_x)::DOUBLE AS crop_x, (y / k - source_y)::DOUBLE AS crop_y, 1 / k AS crop_size FROM (SELECT *, 2.0::DOUBLE ** ("order" - source_order) AS k FROM a)""".replace("SELECT *, (x", "SELECT * EXCLUDE (k), (x"), a=_ANCESTORS))
def _(spark, d):
    return O.tile_crop(O.tile_ancestors(X.stored(spark, d).drop("n_values"), 4))


@query("cells_to_lonlat", sql("particles", """SELECT cell, round(lon + 0.00000000012345::DOUBLE, 9) + 0.0 AS lon, round(lat, 9) + 0.0 AS lat, round(sqrt(greatest(0.0, 1 - z*z)) * cos(phi * pi() / 4), 9) + 0.0 AS vx, round(z, 9) + 0.0 AS vy, round(sqrt(greatest(0.0, 1 - z*z)) * sin(phi * pi() / 4), 9) + 0.0 AS vz FROM c""", c=CENTRES.format(src="particles", order=10, n=1024, count=1048576)))
def _(spark, d):
    placed = O.cells_to_lonlat(X.particles(spark, d).select("cell"), ORDER)
    return r9(placed.withColumn("lon", F.col("lon") + 1.2345e-10), "lon", "lat", "vx", "vy", "vz")


_FACE_UV = f"""SELECT id, lon, lat, face, u, v FROM (SELECT *, f.range AS face, ({R}[f.range + 1] - ring - raw - t.turn + {P}[f.range + 1]) / 2 AS u, ({R}[f.range + 1] - ring + raw + t.turn - {P}[f.range + 1]) / 2 AS v FROM (
 SELECT *, CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN e ELSE 2 * floor(e / 2) + 1 + (e - 2 * floor(e / 2) - 1) * sqrt(3 * (1 - abs(z))) END AS raw,
  CASE WHEN abs(z) <= 2.0::DOUBLE / 3 THEN 2 - 1.5 * z WHEN z > 0 THEN sqrt(3 * (1 - abs(z))) ELSE 4 - sqrt(3 * (1 - abs(z))) END AS ring FROM (
 SELECT id, lon, lat, (lon - 360 * floor(lon / 360)) / 45 AS e, sin(radians(lat)) AS z FROM points)), range(12) f, (VALUES (-8), (0), (8)) t(turn)) WHERE u >= 0 AND u < 1 AND v >= 0 AND v < 1"""


@query("points_to_cells", sql("points", f"""SELECT id, CAST(face AS INTEGER) AS face, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, face * 4096 + {morton("CAST(iy AS BIGINT)", "CAST(ix AS BIGINT)", 6)} AS cell, CAST(ix AS BIGINT) // 8 AS x, CAST(iy AS BIGINT) // 8 AS y FROM (SELECT *, least(63, floor(u * 64)) AS ix, least(63, floor(v * 64)) AS iy FROM f)""", f=_FACE_UV))
def _(spark, d):
    return O.points_to_cells(X.points(spark, d), 6, tile_shift=3).drop("lon", "lat", "u", "v")


@query("lonlat_to_vector", sql("points", "SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 9) + 0.0 AS vx, round(sin(radians(lat)), 9) + 0.0 AS vy, round(cos(radians(lat)) * sin(radians(lon)), 9) + 0.0 AS vz FROM points"))
def _(spark, d):
    return r9(O.lonlat_to_vector(X.points(spark, d)), "vx", "vy", "vz").drop("lon", "lat")


@query("display_vector", sql("points", "SELECT id, round(cos(radians(lat)) * cos(radians(lon)), 9) + 0.0 AS vx, round(cos(radians(lat)) * sin(radians(lon)), 9) + 0.0 AS vy, round(sin(radians(lat)), 9) + 0.0 AS vz FROM points"))
def _(spark, d):
    return r9(O.display_vector(O.lonlat_to_vector(X.points(spark, d))), "vx", "vy", "vz").drop("lon", "lat")


_UV = "SELECT cell, CAST(cell // 1048576 AS INTEGER) AS face, (" + odd("cell % 1048576", 10) + " + 0.5)::DOUBLE / 1024 AS u, (" + even("cell % 1048576", 10) + " + 0.5)::DOUBLE / 1024 AS v FROM particles"


def _uv(spark, d):
    df = O.nested_to_cell(X.particles(spark, d).select("cell"), ORDER, axes="odd_x")
    return df.select("cell", "face", ((F.col("ix") + 0.5) / 1024).alias("u"), ((F.col("iy") + 0.5) / 1024).alias("v"))


@query("net_coords", sql("particles", f"SELECT cell, {P}[face + 1] - u + v AS net_x, {R}[face + 1] - u - v AS net_y FROM uv", uv=_UV))
def _(spark, d):
    return O.net_coords(_uv(spark, d)).select("cell", "net_x", "net_y")


@query("net_to_cells", sql("particles", "SELECT cell, face, u, v FROM uv", uv=_UV))
def _(spark, d):
    return O.net_to_cells(O.net_coords(_uv(spark, d)).select("cell", "net_x", "net_y")).select("cell", "face", "u", "v")


_ANGLE = "acos(least(1.0, greatest(-1.0, sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * (cos(radians(a.lon)) * cos(radians(b.lon)) + sin(radians(a.lon)) * sin(radians(b.lon))))))"


@query("great_circle_distance", sql("points", f"SELECT a.id, round({_ANGLE} * 6371, 3) AS km, round(degrees({_ANGLE}), 5) AS deg FROM points a JOIN points b ON b.id = a.id + 1"))
def _(spark, d):
    p = X.points(spark, d)
    both = p.join(p.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "id")
    km = O.great_circle_distance(both, 6371).withColumnRenamed("distance", "km")
    return O.great_circle_distance(km).select("id", F.round("km", 3).alias("km"), F.round("distance", 5).alias("deg"))


def _vec(src: str, rest: str) -> str:
    return f"SELECT {rest}, sqrt(greatest(0.0, 1 - z*z)) * cos(phi * pi() / 4) AS vx, z AS vy, sqrt(greatest(0.0, 1 - z*z)) * sin(phi * pi() / 4) AS vz FROM ({src})"


_B = """SELECT "order", face, x, y, x / 2.0::DOUBLE ** ("order" - 3) AS u0, (x + 1) / 2.0::DOUBLE ** ("order" - 3) AS u1, y / 2.0::DOUBLE ** ("order" - 3) AS v0, (y + 1) / 2.0::DOUBLE ** ("order" - 3) AS v1 FROM {src}"""
_ADDRESS = '"order", face, x, y'
_EDGES = f"""SELECT {_ADDRESS}, CAST(s.range AS INTEGER) AS seq, CASE (s.range % 24) // 6 WHEN 0 THEN u0 + (u1 - u0) * (s.range % 6) / 6.0 WHEN 1 THEN u1 WHEN 2 THEN u1 + (u0 - u1) * (s.range % 6) / 6.0 ELSE u0 END AS u,
 CASE (s.range % 24) // 6 WHEN 0 THEN v0 WHEN 1 THEN v0 + (v1 - v0) * (s.range % 6) / 6.0 WHEN 2 THEN v1 ELSE v1 + (v0 - v1) * (s.range % 6) / 6.0 END AS v FROM b, range(25) s"""


@query("tile_outlines", sql("stored", f"SELECT {_ADDRESS}, seq, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(vz, 6) + 0.0 AS vz FROM w", b=_B.format(src="stored"), e=_EDGES, w=_vec(point_sql("face", "u", "v", f"{_ADDRESS}, seq", "e"), f"{_ADDRESS}, seq")))
def _(spark, d):
    out = O.tile_outlines(X.stored(spark, d).drop("n_values"), 3)
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("vx", "vy", "vz")}).withColumn("seq", F.col("seq").cast("int"))


_FIVE = f"""SELECT {_ADDRESS}, k, CASE k WHEN 0 THEN (u0 + u1) / 2 WHEN 1 THEN u0 WHEN 2 THEN u1 WHEN 3 THEN u1 ELSE u0 END AS u, CASE k WHEN 0 THEN (v0 + v1) / 2 WHEN 1 THEN v0 WHEN 2 THEN v0 WHEN 3 THEN v1 ELSE v1 END AS v FROM b, (VALUES (0), (1), (2), (3), (4)) q(k)"""
_CAPS = f"""SELECT {", ".join("c." + c for c in ('"order"', "face", "x", "y"))}, c.vx AS cx, c.vy AS cy, c.vz AS cz, asin(least(1.0, 1.12 * max(sqrt((e.vx-c.vx)**2 + (e.vy-c.vy)**2 + (e.vz-c.vz)**2)))) AS cap FROM w c JOIN w e ON e.k > 0 AND c.k = 0 AND c."order" = e."order" AND c.face = e.face AND c.x = e.x AND c.y = e.y GROUP BY 1, 2, 3, 4, 5, 6, 7"""
_DIRECTION = (0.48, 0.6, 0.64)


def _caps(src: str) -> dict[str, str]:
    return {"b": _B.format(src=src), "e": _FIVE, "w": _vec(point_sql("face", "u", "v", f"{_ADDRESS}, k", "e"), f"{_ADDRESS}, k"), "caps": _CAPS}


@query("tiles_in_cone", sql("stored", f"SELECT {_ADDRESS} FROM caps WHERE acos(least(1.0, greatest(-1.0, cx * 0.48 + cy * 0.6 + cz * 0.64))) - cap <= 0.7", **_caps("stored")))
def _(spark, d):
    return O.tiles_in_cone(X.stored(spark, d).drop("n_values"), 3, _DIRECTION, 0.7)


def cones(spark, d):
    """A cone at each point, of 0.02 to 0.2 radians."""
    return O.lonlat_to_vector(X.points(spark, d)).select("id", "vx", "vy", "vz", (0.02 + F.col("id") % 7 * 0.03).alias("cone"))


@query(
    "tiles_in_cones",
    sql(
        "points tiles6",
        f"""SELECT c.id, {_ADDRESS} FROM (SELECT id, 0.02::DOUBLE + id % 7 * 0.03::DOUBLE AS cone, cos(radians(lat)) * cos(radians(lon)) AS vx, sin(radians(lat)) AS vy, cos(radians(lat)) * sin(radians(lon)) AS vz FROM points) c, caps
 WHERE acos(least(1.0, greatest(-1.0, cx * vx + cy * vy + cz * vz))) - cap <= cone""",
        **_caps("tiles6"),
    ),
)
def _(spark, d):
    """Tiles of order 6 that meet the cones of a table."""
    return O.tiles_in_cones(cones(spark, d), 3, 6).select("id", "order", "face", "x", "y")


@query("tiles_in_cones_adaptive")
def _(spark, d):
    """Mixed-order covers of the cones of a table; tested against the cover of each."""
    return O.tiles_in_cones_adaptive(cones(spark, d).withColumnRenamed("cone", "base"), 3, 7).select("id", "order", "face", "x", "y")


@query("tiles_in_cone_adaptive")
def _(spark, d):
    """Below the stored tiles of order 4; checked by properties (disjoint, nothing lost)."""
    roots = X.stored(spark, d).where("order = 4").drop("n_values")
    return O.tiles_in_cone_adaptive(roots, 3, _DIRECTION, 7, 0.2)


_BOX = f"""SELECT {_ADDRESS}, {P}[face + 1] - u1 + v0 AS min_x, {P}[face + 1] - u0 + v1 AS max_x, {R}[face + 1] - u1 - v1 AS min_y, {R}[face + 1] - u0 - v0 AS max_y FROM b"""


@query("tiles_in_net_box", sql("stored", f"SELECT {_ADDRESS} FROM box WHERE max_x >= 1.5 AND min_x <= 4.25 AND max_y >= 0.5 AND min_y <= 2", b=_B.format(src="stored"), box=_BOX))
def _(spark, d):
    return O.tiles_in_net_box(X.stored(spark, d).drop("n_values"), 3, 1.5, 4.25, 0.5, 2)


@query("nearest_tiles", sql("stored", f"""SELECT {_ADDRESS}, round((cx - 1.2)**2 + (cy - 1.5)**2 + (cz - 1.6)**2, 9) AS priority, round(cx * 1.2 + cy * 1.5 + cz * 1.6, 9) AS dot FROM caps ORDER BY priority, dot DESC, "order", face, y, x LIMIT 300""", **_caps("stored")))
def _(spark, d):
    return O.nearest_tiles(X.stored(spark, d).drop("n_values"), 3, (1.2, 1.5, 1.6), 300)


@query("nearest_net_tiles", sql("stored", f"SELECT {_ADDRESS}, round(sqrt(((min_x + max_x) / 2 - 3)**2 + ((min_y + max_y) / 2 - 1.5)**2), 9) AS priority FROM box", b=_B.format(src="stored"), box=_BOX))
def _(spark, d):
    return O.nearest_net_tiles(X.stored(spark, d).drop("n_values"), 3, 3, 1.5)


@query("enumerate_tiles", sql("stored", """SELECT o.k AS "order", CAST(r.range // (o.g * o.g) AS INTEGER) AS face, r.range % o.g AS x, (r.range // o.g) % o.g AS y, s.n_values FROM (VALUES (4, 2), (5, 4), (6, 8)) o(k, g) JOIN range(768) r ON r.range < 12 * o.g * o.g LEFT JOIN stored s ON s."order" = o.k AND s.face = r.range // (o.g * o.g) AND s.x = r.range % o.g AND s.y = (r.range // o.g) % o.g"""))
def _(spark, d):
    """Every address of orders 4..6 beside what is stored for it."""
    return enumerate_tiles(spark, 4, 6, 3).join(X.stored(spark, d), ["order", "face", "x", "y"], "left")


@query("ring_ids")
def _(spark, d):
    """Ring ids of the particles' cells; checked by tests (bijective, sorted by latitude)."""
    return ring_ids(X.particles(spark, d).select("cell"), ORDER)
