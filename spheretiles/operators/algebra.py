"""Cell algebra and geometry: DataFrame in, the same rows with columns added. No operator here shuffles."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import caps
from ..functions import cells as C
from ..functions import geometry as G


def nested_to_cell(df: DataFrame, order: int, cell: str = "cell", axes: str = "even_x") -> DataFrame:
    ix, iy = C.cell_xy(cell, order, axes)
    return df.withColumns({"face": C.face_of(cell, order), "ix": ix, "iy": iy})


def cell_to_nested(df: DataFrame, order: int, axes: str = "even_x") -> DataFrame:
    return df.withColumn("cell", C.nested_id("face", "ix", "iy", order, axes))


def parent_cell(df: DataFrame, order: int, to: int, cell: str = "cell") -> DataFrame:
    if to > order:
        raise ValueError(f"order {to} is finer than {order}")
    return df.withColumn("parent", C.parent(cell, order - to))


def cell_to_tile(df: DataFrame, order: int, tile_shift: int, cell: str = "cell", axes: str = "even_x") -> DataFrame:
    """Adds face, x, y, local_index (row-major) and tile_code."""
    if order < tile_shift:
        raise ValueError("order is below the tile shift")
    ix, iy = C.cell_xy(cell, order, axes)
    side = 1 << (order - tile_shift)
    df = df.withColumns({"face": C.face_of(cell, order), "__ix": ix, "__iy": iy})
    df = df.withColumns({"x": C.down("__ix", tile_shift), "y": C.down("__iy", tile_shift)})
    local = C.up(C.low_bits("__iy", tile_shift), tile_shift) + C.low_bits("__ix", tile_shift)
    return df.withColumns({"local_index": local, "tile_code": C.tile_code("face", "x", "y", F.lit(side))}).drop("__ix", "__iy")


def tile_code_decode(df: DataFrame, side: int) -> DataFrame:
    div = lambda by: F.expr(f"tile_code div {by}")  # noqa: E731 (whole numbers: doubles are wrong beyond 2**53)
    return df.withColumns({"face": div(side * side).cast("int"), "x": F.col("tile_code") % side, "y": div(side) % side})


def tile_parent(df: DataFrame, min_order: int) -> DataFrame:
    """Adds parent_order, parent_x, parent_y: null at the coarsest order."""
    above = F.col("order") > min_order
    return df.withColumns({"parent_order": F.when(above, F.col("order") - 1), "parent_x": F.when(above, C.down("x", 1)), "parent_y": F.when(above, C.down("y", 1))})


def tile_children(df: DataFrame) -> DataFrame:
    """Four rows (order + 1, face, x, y) for each tile, other columns kept."""
    each = F.explode(F.array(*[F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for j in (0, 1) for i in (0, 1)]))
    return df.withColumn("__c", each).withColumns({"order": F.col("order") + 1, "x": F.col("__c.x"), "y": F.col("__c.y")}).drop("__c")


def tile_ancestors(df: DataFrame, min_order: int) -> DataFrame:
    """One row for the tile itself and each coarser one: source_order, source_x, source_y."""
    df = df.withColumn("source_order", F.explode(F.sequence(F.lit(min_order), F.col("order"))))
    up = F.col("order") - F.col("source_order")
    return df.withColumns({"source_x": C.down("x", up), "source_y": C.down("y", up)})


def tile_bounds(df: DataFrame, tile_shift: int) -> DataFrame:
    side = C.grid("order", tile_shift)
    return df.withColumns({"u0": F.col("x") / side, "u1": (F.col("x") + 1) / side, "v0": F.col("y") / side, "v1": (F.col("y") + 1) / side})


def tile_crop(df: DataFrame) -> DataFrame:
    """Where a tile lies in its ancestor (source_order, source_x, source_y): offset and size in shares of the ancestor."""
    many = C.up(1, F.col("order") - F.col("source_order"))
    return df.withColumns({"crop_x": (F.col("x") - F.col("source_x") * many) / many, "crop_y": (F.col("y") - F.col("source_y") * many) / many, "crop_size": 1 / many})


def cells_to_lonlat(df: DataFrame, order: int, cell: str = "cell", axes: str = "odd_x") -> DataFrame:
    """Adds the centre as lon, lat (degrees) and unit vector vx, vy, vz. odd_x is the standard sky position."""
    n = 1 << order
    ix, iy = C.cell_xy(cell, order, axes)
    face = C.face_of(cell, order)
    place = F.struct(G.face_value(face, G.FACE_R).alias("r"), G.face_value(face, G.FACE_P).alias("p"), ((ix + 0.5) / n).alias("u"), ((iy + 0.5) / n).alias("v"))

    def named(s):
        lon, lat = G.lonlat_of(s["z"], s["phi"])
        return F.struct(lon.alias("lon"), lat.alias("lat"), *[c.alias(n) for n, c in zip(("vx", "vy", "vz"), G.point_vector(s["z"], s["phi"]), strict=True)])

    added = ("lon", "lat", "vx", "vy", "vz")
    df = df.withColumn("__c", F.get(F.transform(G.points_of(F.array(place)), named), F.lit(0)))
    return df.select(*[c for c in df.columns if c not in (*added, "__c")], *[F.col("__c")[c].alias(c) for c in added])


def points_to_cells(df: DataFrame, order: int, lon: str = "lon", lat: str = "lat", axes: str = "odd_x", tile_shift: int | None = None) -> DataFrame:
    """Adds face, u, v, ix, iy, cell (and tile x, y) of each position."""
    n = 1 << order
    place = lambda w: F.least(F.greatest(F.floor(w * n), F.lit(0)), F.lit(n - 1)).cast("long")
    at = F.struct((F.pmod(F.col(lon), F.lit(360.0)) / 45).alias("t"), F.sin(F.radians(lat)).alias("z"))
    net = G.bound(at, lambda s: F.struct(*[c.alias(n) for n, c in zip(("ring", "raw"), G.ring_and_raw(s["t"], s["z"]), strict=True)]))
    df = df.withColumn("__p", G.bound(net, lambda s: G.face_uv(s["ring"], s["raw"])))
    df = df.withColumns({"face": F.col("__p.face"), "u": F.col("__p.u"), "v": F.col("__p.v")}).drop("__p")
    df = df.withColumns({"ix": place(F.col("u")), "iy": place(F.col("v"))})
    df = df.withColumn("cell", C.nested_id("face", "ix", "iy", order, axes))
    return df if tile_shift is None else df.withColumns({"x": C.down("ix", tile_shift), "y": C.down("iy", tile_shift)})


def lonlat_to_vector(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y, z = G.vector(lon, lat)
    return df.withColumns({"vx": x, "vy": y, "vz": z})


def display_vector(df: DataFrame) -> DataFrame:
    """Exchanges vy and vz: sky vectors (z up) to display vectors (y up) and back."""
    return df.withColumns({"vy": F.col("vz"), "vz": F.col("vy")})


def net_coords(df: DataFrame) -> DataFrame:
    """Adds net_x, net_y of (face, u, v)."""
    return df.withColumns({"net_x": G.face_value("face", G.FACE_P) - F.col("u") + F.col("v"), "net_y": G.face_value("face", G.FACE_R) - F.col("u") - F.col("v")})


def net_to_cells(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Adds face, u, v of (net_x, net_y): the first face that holds the place, null where none does."""
    tries = []
    for face in range(12):
        u = (G.FACE_R[face] - F.col("net_y") - F.col("net_x") + G.FACE_P[face]) / 2
        v = (G.FACE_R[face] - F.col("net_y") + F.col("net_x") - G.FACE_P[face]) / 2
        inside = (u >= -tolerance) & (u <= 1 + tolerance) & (v >= -tolerance) & (v <= 1 + tolerance)
        clip = lambda w: F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))
        tries.append(F.when(inside, F.struct(F.lit(face).alias("face"), clip(u).alias("u"), clip(v).alias("v"))))
    return df.withColumn("__p", F.coalesce(*tries)).select("*", "__p.face", "__p.u", "__p.v").drop("__p")


def great_circle_distance(df: DataFrame, radius_km: float | None = None) -> DataFrame:
    """Adds distance between (lon, lat) and (lon2, lat2): kilometres, or degrees without a radius."""
    turn = G.angle(G.vector("lon", "lat"), G.vector("lon2", "lat2"))
    return df.withColumn("distance", turn * radius_km if radius_km else F.degrees(turn))


def tile_outlines(df: DataFrame, tile_shift: int, samples: int = 6) -> DataFrame:
    """Boundary points of each tile, edge by edge, closed: columns seq, vx, vy, vz added."""
    df = tile_bounds(df, tile_shift).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(4 * samples))))
    at = F.col("seq") % (4 * samples)
    edge, t = F.floor(at / samples), (at % samples) / samples
    ahead = lambda low, high: F.col(low) + (F.col(high) - F.col(low)) * t
    u = F.when(edge == 0, ahead("u0", "u1")).when(edge == 1, F.col("u1")).when(edge == 2, ahead("u1", "u0")).otherwise(F.col("u0"))
    v = F.when(edge == 0, F.col("v0")).when(edge == 1, ahead("v0", "v1")).when(edge == 2, F.col("v1")).otherwise(ahead("v1", "v0"))
    df = G.with_vectors(df.withColumns({"__u": u, "__v": v}), {"__c": ("face", "__u", "__v")})
    return df.withColumnsRenamed({f"__c_v{c}": f"v{c}" for c in "xyz"}).drop("u0", "u1", "v0", "v1", "__u", "__v")


def tile_caps(df: DataFrame, tile_shift: int, scale: float = 1.12) -> DataFrame:
    """Adds the unit centre cx, cy, cz and the angular radius cap of each tile's bounding cap."""
    return df.withColumn("__cap", cap_of(tile_shift, scale)).select("*", "__cap.*").drop("__cap")


def cap_of(tile_shift: int, scale: float = 1.12) -> Column:
    """struct<cx, cy, cz, cap>: the bounding cap of the tile (order, face, x, y)."""
    side = C.grid("order", tile_shift)
    u0, v0, u1, v1 = F.col("x") / side, F.col("y") / side, (F.col("x") + 1) / side, (F.col("y") + 1) / side
    r, p = G.face_value("face", G.FACE_R), G.face_value("face", G.FACE_P)
    corners = ((u0 + u1) / 2, (v0 + v1) / 2), (u0, v0), (u1, v0), (u1, v1), (u0, v1)
    places = F.array(*[F.struct(r.alias("r"), p.alias("p"), u.alias("u"), v.alias("v")) for u, v in corners])

    def cap(at):
        gap = lambda i: reduce(lambda a, b: a + b, [(at[i][c] - at[0][c]) * (at[i][c] - at[0][c]) for c in "xyz"])
        size = F.asin(F.least(F.lit(1.0), F.sqrt(F.greatest(*map(gap, range(1, 5)))) * scale))
        return F.struct(*[at[0][c].alias(f"c{c}") for c in "xyz"], size.alias("cap"))

    return G.bound(G.vectors_of(places), cap)


def tiles_in_cones(cones: DataFrame, tile_shift: int, order: int) -> DataFrame:
    """`cones` (vx, vy, vz: unit direction; cone: half angle in radians; any other columns) with order, face, x, y of every
    tile of `order` whose bounding cap meets them: the tiles that tiles_in_cone gives for each.

    From the twelve coarsest tiles down, a cone goes on to the children of what it may meet: a tile's descendants and their
    caps lie within twice its own cap. The cones are dealt evenly to tasks, however few files they come from; every `caps.STEP`
    levels are an explode of what a batch of rows meets. Nothing is joined, and the work grows with the tiles that are met.
    Cones that repeat stay; a null direction or angle meets no tile.
    """
    now, levels = _roots(cones, tile_shift), max(order - tile_shift, 0)
    for level in range(0, max(levels, 1), caps.STEP):
        step = min(caps.STEP, levels - level)
        now = _exploded(now, caps.tiles_below(level, step, F.col("cone"), 2.0, 1.0 if level + step == levels else None), tile_shift)
    return now


def _roots(cones: DataFrame, tile_shift: int) -> DataFrame:
    """The twelve coarsest tiles beside each cone, the cones dealt by turns to `spark.sql.shuffle.partitions` tasks."""
    dealt = cones.repartition(int(cones.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumns({"order": F.lit(tile_shift), "face": F.explode(F.sequence(F.lit(0), F.lit(11))), "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})


def _exploded(now: DataFrame, tiles: Column, tile_shift: int) -> DataFrame:
    """A row for each of `tiles` in place of order, x, y. A plain explode would filter on `tiles` below, computing them twice."""
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in now.columns if c not in ("order", "x", "y")]
    now = now.select(*kept, tiles.alias("__t")).select(*kept, F.explode_outer("__t").alias("__t")).where("__t is not null")
    return now.select(*kept, (F.col("__t.order") + tile_shift).alias("order"), "__t.x", "__t.y")


def tiles_in_cones_adaptive(cones: DataFrame, tile_shift: int, target: int) -> DataFrame:
    """`cones` (vx, vy, vz, base: the angle at the target order; any other columns) with the mixed-order cover that
    tiles_in_cone_adaptive gives for each from the twelve coarsest tiles: a tile is split while it meets the cone of its
    children's level, base * 2**(target - child order), pi at most. Dealt and exploded as in tiles_in_cones; where there are
    more levels than one step takes, tiles that are done pass through the later steps.
    """
    now, levels = _roots(cones, tile_shift), max(target - tile_shift, 0)
    for level in range(0, levels, caps.STEP):
        at = F.col("order") == level + tile_shift
        tiles = caps.tiles_below(level, min(caps.STEP, levels - level), F.when(at, F.col("base")), 1.0, target=levels)
        itself = F.array(F.struct((F.col("order") - tile_shift).alias("order"), "x", "y"))
        now = _exploded(now, F.when(at, tiles).otherwise(itself), tile_shift)
    return now


def tiles_in_cone(tiles: DataFrame, tile_shift: int, direction: tuple[float, float, float], cone: float) -> DataFrame:
    """Tiles whose bounding cap meets a cone (unit direction, half angle in radians)."""
    capped = tile_caps(tiles, tile_shift)
    return capped.where(_meets(direction, cone)).drop("cx", "cy", "cz", "cap")


def tiles_in_cone_adaptive(roots: DataFrame, tile_shift: int, direction: tuple[float, float, float], target: int, base: float) -> DataFrame:
    """Mixed-order cover below `roots` (one order): a tile is split while it meets the cone of its children's level.

    That cone is base * 2**(target - child order), pi at most. One filter a level; levels are few and lazy.
    """
    order = roots.select(F.max("order")).first()[0]
    done, now = [], roots
    while order is not None and order < target:
        cone = min(pi, base * 2 ** max(0, target - order - 1))
        capped = tile_caps(now, tile_shift).withColumn("__split", _meets(direction, cone))
        done.append(capped.where("not __split").drop("cx", "cy", "cz", "cap", "__split"))
        now = tile_children(capped.where("__split").drop("cx", "cy", "cz", "cap", "__split"))
        order += 1
    return reduce(DataFrame.unionByName, [*done, now])


def _meets(direction, cone: float):
    towards = tuple(F.lit(float(d)) for d in direction)
    cap = F.struct("cx", "cy", "cz", "cap")
    return G.bound(cap, lambda s: G.angle((s["cx"], s["cy"], s["cz"]), towards) - s["cap"] <= cone)


def net_boxes(tiles: DataFrame, tile_shift: int) -> DataFrame:
    """Adds the net bounding box: min_x, max_x, min_y, max_y of the four corners."""
    df = tile_bounds(tiles, tile_shift)
    p, r = G.face_value("face", G.FACE_P), G.face_value("face", G.FACE_R)
    xs = [p - F.col(u) + F.col(v) for u in ("u0", "u1") for v in ("v0", "v1")]
    ys = [r - F.col(u) - F.col(v) for u in ("u0", "u1") for v in ("v0", "v1")]
    return df.withColumns({"min_x": F.least(*xs), "max_x": F.greatest(*xs), "min_y": F.least(*ys), "max_y": F.greatest(*ys)}).drop("u0", "u1", "v0", "v1")


def tiles_in_net_box(tiles: DataFrame, tile_shift: int, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Tiles whose net bounding box meets a rectangle, edges included."""
    return net_boxes(tiles, tile_shift).where((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1)).drop("min_x", "max_x", "min_y", "max_y")


def nearest_tiles(tiles: DataFrame, tile_shift: int, position: tuple[float, float, float], k: int = 1100) -> DataFrame:
    """The k tiles nearest to a position, by squared distance rounded to 1e-9, then larger dot with it, then address."""
    df = tile_caps(tiles, tile_shift)
    gap = reduce(lambda a, b: a + b, [(F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip(("cx", "cy", "cz"), position, strict=True)])
    dot = reduce(lambda a, b: a + b, [F.col(c) * float(p) for c, p in zip(("cx", "cy", "cz"), position, strict=True)])
    df = df.withColumns({"priority": F.round(gap, 9), "dot": F.round(dot, 9)}).drop("cx", "cy", "cz", "cap")
    return df.orderBy("priority", F.desc("dot"), "order", "face", "y", "x").limit(k)


def nearest_net_tiles(tiles: DataFrame, tile_shift: int, x: float, y: float) -> DataFrame:
    """Tiles ordered by the distance of their net box's centre from a place."""
    df = net_boxes(tiles, tile_shift)
    gap = F.hypot((F.col("min_x") + F.col("max_x")) / 2 - x, (F.col("min_y") + F.col("max_y")) / 2 - y)
    return df.withColumn("priority", F.round(gap, 9)).drop("min_x", "max_x", "min_y", "max_y").orderBy("priority", "order", "face", "y", "x")
