"""Queries on selections, the tile table and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import aggregate as A
from ..operators import select as L
from ..operators import tiles as T
from ..operators.algebra import cell_to_tile
from ..operators.cover import cover_cells, normal_form
from ..sources.scratch import written
from ..streaming import jobs
from . import fixtures as X
from .algebra import _FACE_UV
from .fixtures import MAP_ORDER, ORDER, SHIFT, even, morton, odd, sql
from .pyramids import as_double, blocks
from .registry import ORACLES, query

ADDRESS = '"order", face, x, y'
_RUNS = """SELECT "order", face, y, min(x) AS x0, max(x) AS x1, count(*) AS tile_count FROM (SELECT *, x - row_number() OVER (PARTITION BY "order", face, y ORDER BY x) AS g FROM (SELECT DISTINCT * FROM painted)) GROUP BY "order", face, y, g"""


def registry_sql(name: str, part: str, other: str) -> str:
    """The SQL of a query with one part exchanged."""
    if ORACLES[name].count(part) != 1:
        raise ValueError(f"{name} does not hold the part once")
    return ORACLES[name].replace(part, other)


def ranges(spark, d):
    return L.coalesce_tile_ranges(X.painted(spark, d))


@query("canonical_tile_order", sql("painted", f"SELECT {ADDRESS}, row_number() OVER (ORDER BY {ADDRESS.replace('x, y', 'y, x')}) AS place FROM (SELECT DISTINCT * FROM painted)"))
def _(spark, d):
    """The order, shown by numbering rows: tiles of one order are at most a few hundred here, as on a display."""
    from pyspark.sql import Window

    tiles = L.canonical_tile_order(L.distinct_tiles(X.painted(spark, d)))
    before = tiles.groupBy("order", "face").agg(F.count("*").alias("n"))
    ahead = before.withColumn("ahead", F.sum("n").over(Window.orderBy("order", "face")) - F.col("n")).drop("n")  # twelve rows an order
    local = F.row_number().over(Window.partitionBy("order", "face").orderBy("y", "x"))
    return tiles.withColumn("local", local).join(ahead, ["order", "face"]).select("order", "face", "x", "y", (F.col("local") + F.col("ahead")).alias("place"))


@query("distinct_tiles", sql("painted", "SELECT DISTINCT * FROM painted"))
def _(spark, d):
    return L.distinct_tiles(X.painted(spark, d))


@query("coalesce_tile_ranges", sql("painted", _RUNS))
def _(spark, d):
    return ranges(spark, d)


_CELLS = """SELECT "order", face, x0 * 8 AS ix0, (x1 + 1) * 8 - 1 AS ix1, y * 8 AS iy0, y * 8 + 7 AS iy1, CAST((x1 - x0 + 1) * 64 AS BIGINT) AS cell_count FROM runs"""


@query("cell_ranges_from_tiles", sql("painted", _CELLS, runs=_RUNS))
def _(spark, d):
    return L.cell_ranges_from_tiles(ranges(spark, d), SHIFT)


@query("coverage_summary", sql("painted", """SELECT sum(tile_count)::BIGINT AS tile_count, count(*) AS range_count, CAST(sum(tile_count) * 64 AS BIGINT) AS cell_count, string_agg(DISTINCT face::VARCHAR, ',' ORDER BY face::VARCHAR) AS faces, CASE WHEN count(DISTINCT "order") = 1 THEN min("order") END AS "order" FROM runs""", runs=_RUNS))
def _(spark, d):
    out = L.coverage_summary(ranges(spark, d), SHIFT).drop("orders")
    return out.withColumns({"faces": F.array_join(F.array_sort(F.transform("faces", lambda f: f.cast("string"))), ","), "cell_count": F.col("cell_count").cast("long")})


@query("selection_expand", sql("painted", """SELECT "order", face, x * 8 + i.range AS ix, y * 8 + j.range AS iy FROM (SELECT DISTINCT * FROM painted), range(8) i, range(8) j"""))
def _(spark, d):
    return L.selection_expand(L.cell_ranges_from_tiles(ranges(spark, d), SHIFT))


@query("selection_expand_tiles", sql("painted", "SELECT DISTINCT * FROM painted"))
def _(spark, d):
    return L.selection_expand_tiles(ranges(spark, d))


@query(
    "selection_to_order",
    sql(
        "painted",
        """SELECT 8 AS "order", face, ix0 * 4 AS ix0, (ix1 + 1) * 4 - 1 AS ix1, iy0 * 4 AS iy0, (iy1 + 1) * 4 - 1 AS iy1, cell_count * 16 AS cell_count, true AS exact FROM c
 UNION ALL SELECT 2, face, ix0 // 16, ix1 // 16, iy0 // 16, iy1 // 16, (ix1 // 16 - ix0 // 16 + 1) * (iy1 // 16 - iy0 // 16 + 1), false FROM c UNION ALL SELECT *, true FROM c""",
        runs=_RUNS,
        c=_CELLS,
    ),
)
def _(spark, d):
    c = L.cell_ranges_from_tiles(ranges(spark, d), SHIFT)
    return T.union_orders(*[L.selection_to_order(c, o) for o in (8, 2, 6)])


_IDS = f"""SELECT {ADDRESS}, (face * 64 + {morton("x", "y", 3)}) * 16384 AS start, (face * 64 + {morton("x", "y", 3)} + 1) * 16384 AS stop, CAST(16384 AS BIGINT) AS count FROM (SELECT DISTINCT * FROM painted)"""


@query("selection_nested_ranges", sql("painted", _IDS))
def _(spark, d):
    return L.selection_nested_ranges(L.distinct_tiles(X.painted(spark, d)), SHIFT, ORDER)


_PICKED = f"""SELECT m.cell, m.value::DOUBLE AS value FROM dense_map m SEMI JOIN (SELECT DISTINCT face * 64 + {morton("x", "y", 3)} AS t FROM painted) s ON m.cell // 64 = s.t"""


@query("select_values_nested", sql("dense_map painted", _PICKED))
def _(spark, d):
    return as_double(L.select_values_nested(X.dense_map(spark, d), X.painted(spark, d), SHIFT, MAP_ORDER), "value")


@query("select_values_particles", sql("particles painted", f"""SELECT p.cell, p.value::DOUBLE AS value FROM particles p SEMI JOIN (SELECT DISTINCT face * 64 + {morton("x", "y", 3)} AS t FROM painted) s ON p.cell // 16384 = s.t"""))
def _(spark, d):
    return as_double(L.select_values_nested(X.particles(spark, d), X.painted(spark, d), SHIFT, ORDER), "value")


@query("select_values_block", sql("dense_map painted", _PICKED))
def _(spark, d):
    return as_double(L.select_values_block(blocks(spark, d), L.distinct_tiles(X.painted(spark, d)), SHIFT, MAP_ORDER, 3), "value")


@query("select_values_block_prefix", sql("cube painted", f"""SELECT m.cell, m.value::DOUBLE AS value FROM cube m SEMI JOIN (SELECT DISTINCT face * 64 + {morton("x", "y", 3)} AS t FROM painted) s ON m.cell // 64 = s.t WHERE m."time" = 1 AND m."level" = 2"""))
def _(spark, d):
    """Blocks of a cube with two leading axes."""
    rows = X.cube(spark, d).groupBy("time", "level", C.down("cell", 6).alias("block"))
    cubes = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda s: s["value"]).alias("values"))
    return as_double(L.select_values_block(cubes, L.distinct_tiles(X.painted(spark, d)), SHIFT, MAP_ORDER, 3, {"time": 1, "level": 2}), "value")


def _ids(tiles: str, order: int) -> str:
    """Distinct nested ids at `order` inside the tiles, by each tile's run."""
    tile = f"""CAST(face * 4 ** ("order" - 3) AS BIGINT) + {morton("x", "y", 10)}"""
    run = f"""CAST(4 ** ({order} - "order" + 3) AS BIGINT)"""
    return f"""SELECT DISTINCT unnest(range(t * run, (t + 1) * run)) AS cell FROM (SELECT DISTINCT {tile} AS t, {run} AS run FROM {tiles})"""


_COVER = " UNION ALL ".join(f"""SELECT {level} AS level, cell >> {2 * (7 - level)} AS id FROM covered GROUP BY 1, 2 HAVING count(*) = {4 ** (7 - level)}""" for level in range(8))


@query(
    "selection_normal_form",
    sql(
        "mixed_deep",
        f"""SELECT CAST(level + 3 AS INTEGER) AS "order", CAST(id // CAST(4 ** level AS BIGINT) AS INTEGER) AS face, {even("id % CAST(4 ** level AS BIGINT)", 7)} AS x, {odd("id % CAST(4 ** level AS BIGINT)", 7)} AS y
 FROM whole a WHERE NOT EXISTS (SELECT 1 FROM whole b WHERE b.level = a.level - 1 AND b.id = a.id >> 2)""",
        covered=_ids("mixed_deep", 7),
        whole=_COVER,
    ),
)
def _(spark, d):
    """Tiles of orders 4 to 10 that repeat and lie in each other."""
    return normal_form(X.mixed(spark, d, 4, 7), SHIFT)


_MIXED = "SELECT m.cell, m.value::DOUBLE AS value FROM dense_map m SEMI JOIN picked p ON m.cell = p.cell"


@query("select_values_nested_mixed", sql("dense_map mixed", _MIXED, picked=_ids("mixed", 6)))
def _(spark, d):
    return as_double(L.select_values_nested(X.dense_map(spark, d), X.mixed(spark, d), SHIFT, MAP_ORDER), "value")


@query("select_values_block_mixed", sql("dense_map mixed", _MIXED, picked=_ids("mixed", 6)))
def _(spark, d):
    return as_double(L.select_values_block(blocks(spark, d), X.mixed(spark, d), SHIFT, MAP_ORDER, 3), "value")


@query("selection_cover_cells", sql("mixed", "SELECT cell FROM picked", picked=_ids("mixed", 6)))
def _(spark, d):
    return cover_cells(X.mixed(spark, d), SHIFT, 6)


@query("read_clustered", sql("particles mixed", "SELECT p.cell, p.value::DOUBLE AS value FROM particles p SEMI JOIN picked s ON p.cell >> 8 = s.cell", picked=_ids("mixed", 6)))
def _(spark, d):
    """Particles stored by place, and those of a selection read by pushed id ranges."""
    from ..sources.clustered import read_clustered, write_clustered
    from ..sources.scratch import folder

    path = folder(spark)
    write_clustered(X.particles(spark, d), path, ORDER)
    return as_double(read_clustered(spark, path, X.mixed(spark, d), SHIFT, ORDER), "value")


@query("selection_stats", sql("dense_map painted", """SELECT count(*) AS n, avg(value) AS mean, min(value) AS "min", max(value) AS "max" FROM picked WHERE NOT isnan(value)""", picked=_PICKED))
def _(spark, d):
    return L.selection_stats(L.select_values_nested(X.dense_map(spark, d), X.painted(spark, d), SHIFT, MAP_ORDER))


@query("selection_parse", sql("painted", f"""SELECT face, "order", y, x0, x1, 3 AS tile_shift FROM runs""", runs=_RUNS))
def _(spark, d):
    """One selection document per face, built from the painted runs, and read back."""
    r = ranges(spark, d).groupBy("face").agg(F.collect_list(F.struct("order", "face", "y", "x0", "x1")).alias("tileRanges"))
    coverage = F.struct(F.lit(6).alias("order"), F.lit(SHIFT).alias("tileShift"), F.col("tileRanges"))
    text = F.to_json(F.struct(F.lit("tiles").alias("selectionType"), F.struct(coverage.alias("coverage")).alias("tiles")))
    return L.selection_parse(r.select(text.alias("selection"))).select("face", "order", "y", "x0", "x1", "tile_shift")


# --- tile table


@query(
    "valid_tile_filter",
    """SELECT *, reason IS NULL AS valid FROM (SELECT *, CASE WHEN "order" < 4 OR "order" > 6 THEN 'order outside range' WHEN face < 0 OR face >= 12 THEN 'face outside range' WHEN "order" < 3 THEN 'order below tile shift'
 WHEN x < 0 OR y < 0 OR x >= 2 ** ("order" - 3) OR y >= 2 ** ("order" - 3) THEN 'x or y outside grid' END AS reason FROM (SELECT CAST(3 + o_orderkey % 5 AS INTEGER) AS "order", CAST(o_custkey % 14 - 1 AS INTEGER) AS face, o_orderkey % 9 AS x, o_custkey % 10 - 1 AS y FROM orders))""",
)
def _(spark, d):
    t = X.table(spark, d, "orders").select((3 + F.col("o_orderkey") % 5).cast("int").alias("order"), (F.col("o_custkey") % 14 - 1).cast("int").alias("face"), (F.col("o_orderkey") % 9).alias("x"), (F.col("o_custkey") % 10 - 1).alias("y"))
    return T.valid_tile_filter(t, 4, 6, SHIFT)


def expected(spark, d):
    """All tiles of order 6, as a layer that covers the sphere has them."""
    return T.enumerate_tiles(spark, 6, 6, SHIFT)


_WITH = """SELECT t.*, s.n_values FROM tiles6 t LEFT JOIN stored s ON s."order" = t."order" AND s.face = t.face AND s.x = t.x AND s.y = t.y"""


@query("missing_tiles", sql("stored tiles6", f"SELECT {ADDRESS} FROM w WHERE n_values IS NULL", w=_WITH))
def _(spark, d):
    return T.missing_tiles(expected(spark, d), X.stored(spark, d))


@query("pending_tiles", sql("stored wanted", f"""SELECT {ADDRESS} FROM (SELECT DISTINCT * FROM wanted) t ANTI JOIN stored s ON s."order" = t."order" AND s.face = t.face AND s.x = t.x AND s.y = t.y"""))
def _(spark, d):
    return T.pending_tiles(L.distinct_tiles(X.wanted(spark, d)), X.stored(spark, d))


@query("validate_tiles", sql("stored tiles6", "SELECT count(*) AS checked, count(*) FILTER (n_values IS NULL) AS missing, count(*) FILTER (n_values <> 64) AS wrong_size FROM w", w=_WITH))
def _(spark, d):
    return T.validate_tiles(expected(spark, d), X.stored(spark, d), 64)


_TWICE = f"""SELECT * FROM stored UNION ALL SELECT * FROM stored WHERE x = 1 UNION ALL SELECT {ADDRESS}, 7 AS n_values FROM stored WHERE y = 2 AND x = 0"""


@query(
    "validate_tiles_repeated",
    sql(
        "stored tiles6",
        f"""SELECT count(*) AS checked, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (wrong) AS wrong_size, count(*) FILTER (n > 1) AS repeated
 FROM tiles6 t LEFT JOIN (SELECT {ADDRESS}, count(*) AS n, bool_or(n_values <> 64) AS wrong FROM twice GROUP BY ALL) s ON s."order" = t."order" AND s.face = t.face AND s.x = t.x AND s.y = t.y""",
        twice=_TWICE,
    ),
)
def _(spark, d):
    """Stored tiles that repeat, some of them with another size."""
    s = X.stored(spark, d)
    twice = s.unionByName(s.where("x = 1")).unionByName(s.where("y = 2 and x = 0").withColumn("n_values", F.lit(7)))
    return T.validate_tiles(expected(spark, d), twice, 64, repeats=True)


@query("fill_summary", sql("stored wanted", """SELECT status, count(*) AS tiles FROM (SELECT CASE WHEN s.n_values IS NULL THEN 'generated' WHEN s.n_values <> 64 THEN 'error' ELSE 'skipped' END AS status FROM (SELECT DISTINCT * FROM wanted) t LEFT JOIN stored s ON s."order" = t."order" AND s.face = t.face AND s.x = t.x AND s.y = t.y) GROUP BY 1"""))
def _(spark, d):
    both = L.distinct_tiles(X.wanted(spark, d)).join(X.stored(spark, d), list(T.TILE), "left")
    status = F.when(F.col("n_values").isNull(), "generated").when(F.col("n_values") != 64, "error").otherwise("skipped")
    return T.fill_summary(both.withColumn("status", status))


_BEST = """SELECT w.*, max(s."order") AS source_order FROM (SELECT DISTINCT * FROM wanted) w LEFT JOIN stored s ON s.face = w.face AND s."order" <= w."order" AND s.x = w.x // CAST(2 ** (w."order" - s."order") AS BIGINT) AND s.y = w.y // CAST(2 ** (w."order" - s."order") AS BIGINT) GROUP BY ALL"""
_RESOLVED = f"""SELECT {ADDRESS}, source_order, x // CAST(2 ** ("order" - source_order) AS BIGINT) AS source_x, y // CAST(2 ** ("order" - source_order) AS BIGINT) AS source_y, coalesce(source_order = "order", false) AS exact FROM best"""


def resolved(spark, d):
    return T.resolve_ancestors(L.distinct_tiles(X.wanted(spark, d)), X.stored(spark, d), 4)


@query("resolve_ancestors", sql("stored wanted", _RESOLVED, best=_BEST))
def _(spark, d):
    return resolved(spark, d)


@query("resolution_stats", sql("stored wanted", "SELECT count(*) AS visible, count(*) FILTER (exact) AS exact, count(*) FILTER (source_order IS NOT NULL AND NOT exact) AS fallback, count(*) FILTER (source_order IS NULL) AS missing, max(source_order) AS max_source_order FROM r", best=_BEST, r=_RESOLVED))
def _(spark, d):
    return T.resolution_stats(resolved(spark, d))


@query("order_counts", sql("stored", """SELECT "order", count(*) AS tiles FROM stored GROUP BY 1"""))
def _(spark, d):
    return T.order_counts(X.stored(spark, d))


def tile_values(spark, d, orders=(4, 5, 6)):
    """Stored tiles with their means as arrays."""
    p = A.particle_pyramid(X.clustered(spark, d), ORDER, min(orders), max(orders))
    parts = [A.assemble_tiles(p.where(F.col("order") == o).select("cell", "value"), o, SHIFT) for o in orders]
    return T.union_orders(*parts).join(X.stored(spark, d).select(*T.TILE), list(T.TILE), "left_semi")


_MEANS = " UNION ALL ".join(
    f"""SELECT {o} AS "order", c AS cell, CAST(c // {4**o} AS INTEGER) AS face, {even(f'c % {4**o}', o)} AS ix, {odd(f'c % {4**o}', o)} AS iy, value::DOUBLE AS value FROM (SELECT cell >> {2 * (ORDER - o)} AS c, CAST(sum(value::DOUBLE) / count(*) AS FLOAT) AS value FROM clustered GROUP BY 1)"""
    for o in (4, 5, 6)
)
_HELD = """SELECT m.*, ix // 8 AS x, iy // 8 AS y FROM means m SEMI JOIN stored s ON s."order" = m."order" AND s.face = m.face AND s.x = m.ix // 8 AND s.y = m.iy // 8"""


@query(
    "read_tiles",
    sql("clustered stored wanted", f"""SELECT t."order", t.face, t.x, t.y, r.range AS local_index, coalesce(h.value, -1.0) AS value FROM (SELECT DISTINCT * FROM wanted) t, range(64) r LEFT JOIN held h ON h."order" = t."order" AND h.face = t.face AND h.x = t.x AND h.y = t.y AND (h.iy % 8) * 8 + h.ix % 8 = r.range""", means=_MEANS, held=_HELD),
)
def _(spark, d):
    held = tile_values(spark, d).withColumn("values", F.transform("values", lambda v: F.when(F.isnan(v), F.lit(-1.0)).otherwise(v).cast("float")))
    got = T.read_tiles(L.distinct_tiles(X.wanted(spark, d)), held, 64, empty=-1)
    return as_double(got.select(*T.TILE, F.posexplode("values").alias("local_index", "value")).withColumn("local_index", F.col("local_index").cast("long")), "value")


@query("write_tiles")
def _(spark, d):
    """Tiles written, replaced and read back."""
    from ..sources.scratch import folder

    path, tiles = folder(spark), tile_values(spark, d, (5, 6)).withColumn("layer", F.lit("price"))
    T.write_tiles(tiles, path)
    T.write_tiles(tiles, path, force=True)
    back = spark.read.parquet(path)
    return back.groupBy("layer", "order").agg(F.count("*").alias("tiles"), F.sum(F.size("values")).alias("samples"))


@query("export_tile_files")
def _(spark, d):
    """Files written by the sink, replaced, and found on disk."""
    from ..sources.scratch import folder

    path, made = folder(spark), tile_values(spark, d, (5, 6)).withColumn("layer", F.lit("price"))
    T.export_tile_files(made, path)
    T.export_tile_files(made, path, force=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/layers")
    return files.select(F.regexp_extract("path", "(layers/.*)$", 1).alias("path"), F.length("content").cast("int").alias("size"), F.sha2("content", 256).alias("sha256"))


@query("read_tile_files", sql("clustered stored", """SELECT h."order", h.face, h.x, h.y, (h.iy % 8) * 8 + h.ix % 8 AS local_index, h.value FROM held h""", means=_MEANS, held=_HELD))
def _(spark, d):
    """Values of tile files, read back."""
    from ..sources.scratch import folder
    from ..sources.tile_files import read_tile_files

    path = folder(spark)
    T.export_tile_files(tile_values(spark, d).withColumn("layer", F.lit("price")), path)
    cells = read_tile_files(spark, path).select(*T.TILE, F.posexplode("values").alias("local_index", "value")).where(~F.isnan("value"))
    return as_double(cells.withColumn("local_index", F.col("local_index").cast("long")), "value")


@query(
    "inspect_points",
    sql(
        "clustered stored points",
        f"""SELECT id, best.cell, best.o AS source_order, value, coalesce(best.o = 6, false) AS exact FROM (SELECT id, face * 4096 + {morton("iy", "ix", 6)} AS cell, (SELECT max(s."order") FROM stored s WHERE s.face = q.face AND s.x = q.ix // CAST(8 * 2 ** (6 - s."order") AS BIGINT) AND s.y = q.iy // CAST(8 * 2 ** (6 - s."order") AS BIGINT)) AS o, face, ix, iy FROM q) best
 LEFT JOIN held h ON h."order" = best.o AND h.face = best.face AND h.ix = best.ix // CAST(2 ** (6 - best.o) AS BIGINT) AND h.iy = best.iy // CAST(2 ** (6 - best.o) AS BIGINT)""",
        means=_MEANS,
        held=_HELD,
        f=_FACE_UV,
        q="SELECT id, face, CAST(least(63, floor(u * 64)) AS BIGINT) AS ix, CAST(least(63, floor(v * 64)) AS BIGINT) AS iy FROM f",
    ),
)
def _(spark, d):
    held = written(T.read_tiles(X.stored(spark, d), tile_values(spark, d), 64))  # stored tiles without particles hold NaN
    got = T.inspect_points(X.points(spark, d), held, 6, SHIFT, 4)
    value = F.when(~F.isnan("value"), F.col("value").cast("double"))
    return got.select("id", "cell", "source_order", value.alias("value"), "exact")


@query("inspect_points_nulls", registry_sql("inspect_points", "SELECT id, best.cell,", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'p' || (id % 5) END AS note, best.cell,"))
def _(spark, d):
    """Points with a column that is null for some, and tiles that are stored twice."""
    held = written(T.read_tiles(X.stored(spark, d), tile_values(spark, d), 64))
    note = F.when(F.col("id") % 3 != 0, F.concat(F.lit("p"), (F.col("id") % 5).cast("string")))
    got = T.inspect_points(X.points(spark, d).withColumn("note", note), held.unionByName(held), 6, SHIFT, 4)
    return got.select("id", "note", "cell", "source_order", F.when(~F.isnan("value"), F.col("value").cast("double")).alias("value"), "exact")


@query("union_orders", sql("particles", " UNION ALL ".join(f"""SELECT {o} AS "order", count(*) AS cells FROM (SELECT DISTINCT cell >> {2 * (ORDER - o)} FROM particles)""" for o in (4, 5, 6))))
def _(spark, d):
    parts = [A.particle_count(X.particles(spark, d), ORDER, o).withColumn("order", F.lit(o)) for o in (4, 5, 6)]
    return T.union_orders(*parts).groupBy("order").agg(F.count("*").alias("cells"))


@query("tile_values_placed", sql("particles", f"""SELECT CAST(c // 16384 AS INTEGER) AS face, {even("c % 16384", 7)} // 8 AS x, {odd("c % 16384", 7)} // 8 AS y, count(*) AS cells, sum(n)::BIGINT AS particles FROM (SELECT cell >> 6 AS c, count(*) AS n FROM particles GROUP BY 1) GROUP BY 1, 2, 3"""))
def _(spark, d):
    """Occupied cells and particles of each tile of order 7."""
    placed = cell_to_tile(A.particle_count(X.particles(spark, d), ORDER, 7), 7, SHIFT)
    return placed.groupBy("face", "x", "y").agg(F.count("*").alias("cells"), F.sum("n").alias("particles"))


# --- bulk fill

_BAD_ROWS = "(\"time\" = 1 AND \"level\" = 2 AND ((face = 3 AND iy % 16 = 3) OR (face = 5 AND iy = 7)))"
_ASKED = """SELECT DISTINCT CAST(event_id % 3 AS INTEGER) AS "time", CAST(user_id % 3 AS INTEGER) AS "level", CAST(4 + event_id % 4 AS INTEGER) AS "order", CAST(event_id % 13 AS INTEGER) AS face, user_id % 4 AS x, (event_id // 12) % 4 AS y FROM events"""
_CUBE_CELLS = f"""SELECT "time", "level", CAST(cell // 4096 AS INTEGER) AS face, {even("cell % 4096", 6)} AS ix, {odd("cell % 4096", 6)} AS iy, value FROM cube"""
_FILLED = """SELECT a.*, CASE WHEN "order" > 6 THEN 'order outside range' WHEN face >= 12 THEN 'face outside range' WHEN x >= 2 ** ("order" - 3) OR y >= 2 ** ("order" - 3) THEN 'x or y outside grid' WHEN "time" = 2 THEN 'the slice has no rows there'
 WHEN "time" = 1 AND "level" = 2 AND face = 3 AND ("order" < 6 OR y % 2 = 0) THEN 'a row of the slice has a wrong length' WHEN "time" = 1 AND "level" = 2 AND face = 5 AND y = 0 THEN (2 ** (9 - "order") - 1)::INTEGER || ' of ' || (2 ** (9 - "order"))::INTEGER || ' rows of the slice are there' END AS message FROM asked a"""


def bulk(spark, d):
    """A stored cube with rows that are cut short or absent, filled in two runs: half of the requests, then all."""
    from ..operators.fill import bulk_fill
    from ..sources.cube import cube_rows, read_cube, write_cube
    from ..sources.scratch import folder

    top = folder(spark)
    rows = cube_rows(X.cube(spark, d), MAP_ORDER)
    bad = (F.col("time") == 1) & (F.col("level") == 2)
    short = bad & (F.col("face") == 3) & (F.col("iy") % 16 == 3)
    rows = rows.where(~(bad & (F.col("face") == 5) & (F.col("iy") == 7))).withColumn("values", F.when(short, F.slice("values", 1, 63)).otherwise(F.col("values")))
    write_cube(rows, f"{top}/cube")
    asked = X.table(spark, d, "events").select((F.col("event_id") % 3).alias("time"), (F.col("user_id") % 3).alias("level"), (4 + F.col("event_id") % 4).alias("order"), (F.col("event_id") % 13).alias("face"), (F.col("user_id") % 4).alias("x"), (F.floor(F.col("event_id") / 12) % 4).alias("y"))
    cube = read_cube(spark, f"{top}/cube")
    first = bulk_fill(asked.where("(time + level + x) % 2 = 0"), cube, f"{top}/cache", MAP_ORDER, SHIFT)
    return first, bulk_fill(asked, cube, f"{top}/cache", MAP_ORDER, SHIFT), f"{top}/cache"


@query("bulk_fill", sql("", """SELECT "time", "level", "order", face, x, y, message, CASE WHEN message IS NOT NULL THEN 'error' WHEN ("time" + "level" + x) % 2 = 0 THEN 'skipped' ELSE 'generated' END AS status FROM f""", asked=_ASKED, f=_FILLED))
def _(spark, d):
    """What the second run tells of each tile."""
    return bulk(spark, d)[1]


@query("bulk_fill_summary", sql("", """SELECT status, count(*) AS tiles FROM (SELECT CASE WHEN message IS NOT NULL THEN 'error' WHEN ("time" + "level" + x) % 2 = 0 THEN 'skipped' ELSE 'generated' END AS status FROM f) GROUP BY 1""", asked=_ASKED, f=_FILLED))
def _(spark, d):
    return T.fill_summary(bulk(spark, d)[1])


@query(
    "bulk_fill_tiles",
    sql(
        "cube",
        """SELECT f."time", f."level", f."order", f.face, f.x, f.y, (c.iy // w % 8) * 8 + c.ix // w % 8 AS local_index, CAST(avg(c.value::DOUBLE) FILTER (NOT isnan(c.value)) AS FLOAT)::DOUBLE AS value FROM (SELECT *, CAST(2 ** (6 - "order") AS BIGINT) AS w FROM f WHERE message IS NULL) f
 JOIN cells c ON c."time" = f."time" AND c."level" = f."level" AND c.face = f.face AND c.ix // (8 * w) = f.x AND c.iy // (8 * w) = f.y GROUP BY ALL""",
        asked=_ASKED,
        f=_FILLED,
        cells=_CUBE_CELLS,
    ),
)
def _(spark, d):
    """The values that both runs stored."""
    from ..operators.fill import KEYS, filled_tiles

    cells = filled_tiles(spark, bulk(spark, d)[2]).select(*KEYS, F.posexplode("values").alias("local_index", "value"))
    return cells.select(*KEYS, F.col("local_index").cast("long").alias("local_index"), F.when(~F.isnan("value"), F.col("value").cast("double")).alias("value"))


# --- streams

_EVENTS = """SELECT cell >> 8 AS cell, count(*) AS n, sum(v::DOUBLE) AS total FROM (SELECT (event_id*2654435761 + user_id*7919) % 12582912 AS cell, CAST(value AS FLOAT) AS v FROM events) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1"""


def _event_stream(spark, d, top, files=7, at_once=2):
    """The events as a stream of several files, so of several batches."""
    events = X.table(spark, d, "events")
    events.repartition(files).write.parquet(f"{top}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", at_once).parquet(f"{top}/events")


@query("stream_particles", _EVENTS)
def _(spark, d):
    from ..sources.scratch import folder

    top = folder(spark)
    particles = _event_stream(spark, d, top).select(((F.col("event_id") * 2654435761 + F.col("user_id") * 7919) % 12582912).alias("cell"), F.col("value"))
    jobs.stream_particles(particles, ORDER, 6, f"{top}/out", f"{top}/checkpoint")
    return jobs.read_particle_state(spark, f"{top}/out")


@query("stream_particles_compacted", _EVENTS)
def _(spark, d):
    """The same sums, with parts that are compacted as batches come."""
    from ..sources.scratch import folder

    top = folder(spark)
    particles = _event_stream(spark, d, top, at_once=1).select(((F.col("event_id") * 2654435761 + F.col("user_id") * 7919) % 12582912).alias("cell"), F.col("value"))
    return jobs.stream_particle_totals(particles, ORDER, 6, f"{top}/out", f"{top}/checkpoint", fanout=2).read()


@query("stream_tile_fill", sql("particles wanted", f"""SELECT w."order", w.face, w.x, w.y, count(p.cell) AS n FROM (SELECT DISTINCT * FROM wanted) w LEFT JOIN particles p ON p.cell // 16384 = w.face * 64 + {morton("w.x", "w.y", 3)} GROUP BY ALL"""))
def _(spark, d):
    from ..sources.scratch import folder

    top = folder(spark)
    requests = _event_stream(spark, d, top).select(F.lit(6).alias("order"), (F.col("event_id") % 12).cast("int").alias("face"), (F.col("user_id") % 8).alias("x"), (F.floor(F.col("event_id") / 12) % 8).alias("y"))

    def fill(tiles):
        counts = X.particles(spark, d).groupBy(C.down("cell", 14).alias("tile")).agg(F.count("*").alias("n"))
        keyed = tiles.withColumn("tile", C.nested_id("face", "x", "y", 3))
        return keyed.join(counts, "tile", "left").select(*T.TILE, F.coalesce("n", F.lit(0)).alias("n"))

    jobs.stream_tile_fill(requests, fill, f"{top}/cache", f"{top}/checkpoint")
    return spark.read.parquet(f"{top}/cache").drop("batch")
