"""Inputs of the registered queries, all derived from the given tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 10  # of particles
MAP_ORDER = 6  # of the dense map: 49152 cells
SHIFT = 3
NAN = float("nan")


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_particles(spark, d) -> DataFrame:
    """Particles of order 10 from lineitem; line 7 has no value; two in a thousand lie out of range."""
    t = table(spark, d, "lineitem")
    place = (F.col("l_orderkey") * 2654435761 + F.col("l_partkey") * 40503 + F.col("l_suppkey") * 9973 + F.col("l_linenumber") * 7919) % 12582912
    cell = F.when(F.col("l_orderkey") % 1000 == 1, F.lit(-1)).when(F.col("l_orderkey") % 1000 == 2, F.lit(12582912)).otherwise(place).cast("long")
    return t.select(cell.alias("cell"), F.when(F.col("l_linenumber") == 7, F.lit(NAN)).otherwise(F.col("l_extendedprice")).cast("float").alias("value"))


def particles(spark, d) -> DataFrame:
    from ..sources.tables import read_particles

    return read_particles(raw_particles(spark, d), ORDER)


def clustered(spark, d) -> DataFrame:
    """The particles, gathered on few coarse cells."""
    return particles(spark, d).withColumn("cell", F.col("cell") % 49152)


def dense_map(spark, d) -> DataFrame:
    """A full map of order 6: mean of the particles of each cell, NaN where there is none or where cell % 13 = 0."""
    sums = particles(spark, d).groupBy(F.shiftrightunsigned("cell", 2 * (ORDER - MAP_ORDER)).alias("cell")).agg(F.sum(F.col("value").cast("double")).alias("s"), F.count("*").alias("n"))
    value = F.when(F.col("n").isNull() | (F.col("cell") % 13 == 0), F.lit(NAN)).otherwise(F.col("s") / F.col("n")).cast("float")
    return spark.range(12 * 4**MAP_ORDER).withColumnRenamed("id", "cell").join(sums, "cell", "left").select("cell", value.alias("value"))


def points(spark, d) -> DataFrame:
    c = F.col("c_custkey")
    lat = F.degrees(F.asin((c * F.lit(0.61803398875)) % 1 * 1.998 - 0.999))
    return table(spark, d, "customer").select(c.alias("id"), ((c * F.lit(137.50776405)) % 360 - 180).alias("lon"), lat.alias("lat"))


def painted(spark, d) -> DataFrame:
    """Painted tiles of order 6 from orders (repeats included)."""
    t = table(spark, d, "orders").select(F.lit(6).alias("order"), (F.col("o_orderkey") % 12).cast("int").alias("face"), (F.col("o_custkey") % 8).alias("x"), (F.floor(F.col("o_orderkey") / 12) % 8).alias("y"))
    return t.where((F.col("face") * 37 + F.col("y") * 11 + F.col("x") * F.col("x") * 5) % 7 < 4)


def mixed(spark, d, first: int = 4, orders: int = 3) -> DataFrame:
    """Painted tiles of several orders from orders: they repeat, lie in each other, and some have all their siblings."""
    order = (first + F.col("o_orderkey") % orders).cast("int")
    side = F.pow(F.lit(2), order - SHIFT).cast("long")
    t = table(spark, d, "orders").select(order.alias("order"), (F.floor(F.col("o_orderkey") / orders) % 12).cast("int").alias("face"), (F.col("o_custkey") % side).alias("x"), (F.floor(F.col("o_orderkey") / 36) % side).alias("y"))
    return t.where((F.col("face") * 37 + F.floor(F.col("y") / 2) * 11 + F.floor(F.col("x") / 2) * 5 + F.col("order") * 3) % 7 < F.when(F.col("order") == first + orders - 1, 4).otherwise(1))


def stored(spark, d) -> DataFrame:
    """Tiles of orders 4..6 that hold particles, a third removed; n_values is wrong for some."""
    from ..functions import cells as C
    from ..operators.algebra import nested_to_cell

    finest = particles(spark, d).select(F.shiftrightunsigned("cell", 2 * (ORDER - 6 + SHIFT)).alias("cell")).distinct()
    placed = nested_to_cell(finest, 6 - SHIFT).withColumn("order", F.explode(F.array(*map(F.lit, (4, 5, 6)))))
    out = placed.select("order", "face", C.down("ix", 6 - F.col("order")).alias("x"), C.down("iy", 6 - F.col("order")).alias("y")).distinct()
    mark = F.col("face") * 37 + F.col("y") * 11 + F.col("x") * F.col("x") * 5 + F.col("order")
    return out.where(mark % 3 != 0).withColumn("n_values", F.when(mark % 31 == 1, 60).otherwise(64))


def wanted(spark, d) -> DataFrame:
    """Requested tiles of order 6 from events (repeats included)."""
    return table(spark, d, "events").select(F.lit(6).alias("order"), (F.col("event_id") % 12).cast("int").alias("face"), (F.col("user_id") % 8).alias("x"), (F.floor(F.col("event_id") / 12) % 8).alias("y"))


def cube(spark, d) -> DataFrame:
    """The dense map at two times and three levels."""
    axes = F.explode(F.array(*[F.struct(F.lit(t).alias("time"), F.lit(l).alias("level")) for t in range(2) for l in range(3)]))
    m = dense_map(spark, d).withColumn("a", axes).select("a.time", "a.level", "cell", "value")
    return m.withColumn("value", (F.col("value") + F.col("time") * 100 + F.col("level") * 7).cast("float"))


def raster(spark, d, height: int = 19, width: int = 37) -> DataFrame:
    """Smallest order price for each pixel; nodata -99999 where there is none or (row * width + col) % 401 = 0."""
    t = table(spark, d, "orders").groupBy((F.col("o_orderkey") % height).alias("row"), (F.col("o_custkey") % width).alias("col")).agg(F.min("o_totalprice").alias("p"))
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    none = F.col("p").isNull() | ((F.col("row") * width + F.col("col")) % 401 == 0)
    return grid.join(t, ["row", "col"], "left").select("row", "col", F.when(none, F.lit(-99999.0)).otherwise(F.col("p")).cast("float").alias("value"))


def fine_raster(spark, d, height: int, width: int) -> DataFrame:
    """A pattern and the number of orders at each pixel, exact in 32-bit floats; nodata where (row * 361 + col) % 4001 = 0."""
    t = table(spark, d, "orders").groupBy((F.col("o_orderkey") % height).alias("row"), (F.col("o_custkey") % width).alias("col")).agg(F.count("*").alias("n"))
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    value = (F.col("row") * 31 + F.col("col") * 17) % 997 / 8 + F.coalesce("n", F.lit(0))
    return grid.join(t, ["row", "col"], "left").select("row", "col", F.when((F.col("row") * 361 + F.col("col")) % 4001 == 0, F.lit(-99999.0)).otherwise(value).cast("float").alias("value"))


def _fine_raster_sql(height: int, width: int) -> str:
    return f"""SELECT g."row", g.col, CAST(CASE WHEN (g."row" * 361 + g.col) % 4001 = 0 THEN -99999.0 ELSE (g."row" * 31 + g.col * 17) % 997 / 8.0 + coalesce(n, 0) END AS FLOAT) AS value
  FROM (SELECT range // {width} AS "row", range % {width} AS col FROM range({height * width})) g
  LEFT JOIN (SELECT o_orderkey % {height} AS "row", o_custkey % {width} AS col, count(*) AS n FROM orders GROUP BY 1, 2) t ON g."row" = t."row" AND g.col = t.col"""


def _raster_sql(height: int, width: int) -> str:
    return f"""(SELECT g."row", g.col, CAST(CASE WHEN p IS NULL OR (g."row" * {width} + g.col) % 401 = 0 THEN -99999.0 ELSE p END AS FLOAT) AS value
  FROM (SELECT range // {width} AS "row", range % {width} AS col FROM range({height * width})) g
  LEFT JOIN (SELECT o_orderkey % {height} AS "row", o_custkey % {width} AS col, min(o_totalprice) AS p FROM orders GROUP BY 1, 2) t ON g."row" = t."row" AND g.col = t.col)"""


def even(v: str, order: int | str) -> str:
    return f"CAST(coalesce(list_sum([((({v}) >> (2*b)) & 1) << b for b in range(0, {order})]), 0) AS BIGINT)"


def odd(v: str, order: int | str) -> str:
    return f"CAST(coalesce(list_sum([((({v}) >> (2*b+1)) & 1) << b for b in range(0, {order})]), 0) AS BIGINT)"


def morton(x: str, y: str, order: int | str) -> str:
    """x in the even bits."""
    return f"CAST(coalesce(list_sum([(((({x}) >> b) & 1) << (2*b)) + (((({y}) >> b) & 1) << (2*b+1)) for b in range(0, {order})]), 0) AS BIGINT)"


def _mixed(first: int, orders: int) -> str:
    return f"""SELECT * FROM (SELECT "order", CAST((o_orderkey // {orders}) % 12 AS INTEGER) AS face, o_custkey % side AS x, (o_orderkey // 36) % side AS y
  FROM (SELECT *, CAST({first} + o_orderkey % {orders} AS INTEGER) AS "order", CAST(2 ** ({first} + o_orderkey % {orders} - 3) AS BIGINT) AS side FROM orders))
  WHERE (face*37 + y//2*11 + x//2*5 + "order"*3) % 7 < CASE WHEN "order" = {first + orders - 1} THEN 4 ELSE 1 END"""


_STORED = " UNION ".join(
    f"""SELECT {o} AS "order", CAST(c // {4**o} AS INTEGER) AS face, {even(f'c % {4**o}', o)} // 8 AS x, {odd(f'c % {4**o}', o)} // 8 AS y FROM (SELECT DISTINCT cell >> {2 * (ORDER - o)} AS c FROM particles)"""
    for o in (4, 5, 6)
)
CTE = {
    "raw_particles": """SELECT CAST(CASE WHEN l_orderkey % 1000 = 1 THEN -1 WHEN l_orderkey % 1000 = 2 THEN 12582912
  ELSE (l_orderkey*2654435761 + l_partkey*40503 + l_suppkey*9973 + l_linenumber*7919) % 12582912 END AS BIGINT) AS cell,
  CAST(CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS FLOAT) AS value FROM lineitem""",
    "particles": "SELECT * FROM raw_particles WHERE cell >= 0 AND cell < 12582912 AND NOT isnan(value)",
    "clustered": "SELECT cell % 49152 AS cell, value FROM particles",
    "dense_map": """SELECT r.range AS cell, CAST(CASE WHEN n IS NULL OR r.range % 13 = 0 THEN 'NaN'::DOUBLE ELSE s / n END AS FLOAT) AS value
  FROM range(0, 49152) r LEFT JOIN (SELECT cell >> 8 AS c, sum(value::DOUBLE) AS s, count(*) AS n FROM particles GROUP BY 1) p ON r.range = p.c""",
    "raster_holes": f"SELECT * FROM {_raster_sql(19, 37)} WHERE \"row\" <> 11 AND (\"row\" * 37 + col) % 83 <> 5",
    "points": "SELECT c_custkey AS id, (c_custkey * 137.50776405::DOUBLE) % 360 - 180 AS lon, degrees(asin((c_custkey * 0.61803398875::DOUBLE) % 1 * 1.998::DOUBLE - 0.999::DOUBLE)) AS lat FROM customer",
    "painted": """SELECT * FROM (SELECT 6 AS "order", CAST(o_orderkey % 12 AS INTEGER) AS face, o_custkey % 8 AS x, (o_orderkey // 12) % 8 AS y FROM orders) WHERE (face*37 + y*11 + x*x*5) % 7 < 4""",
    "mixed": _mixed(4, 3),
    "mixed_deep": _mixed(4, 7),
    "stored": f"""SELECT *, CASE WHEN (face*37 + y*11 + x*x*5 + "order") % 31 = 1 THEN 60 ELSE 64 END AS n_values FROM ({_STORED}) WHERE (face*37 + y*11 + x*x*5 + "order") % 3 <> 0""",
    "wanted": """SELECT 6 AS "order", CAST(event_id % 12 AS INTEGER) AS face, user_id % 8 AS x, (event_id // 12) % 8 AS y FROM events""",
    "cube": """SELECT t.range::INTEGER AS "time", l.range::INTEGER AS "level", cell, CAST(value + t.range::FLOAT * 100 + l.range::FLOAT * 7 AS FLOAT) AS value FROM dense_map, range(2) t, range(3) l""",
    "raster": f"SELECT * FROM {_raster_sql(19, 37)}",
    "raster_fine": _fine_raster_sql(181, 361),
    "raster_fine_pixel": _fine_raster_sql(90, 180),
    "raster_pixel": f"SELECT * FROM {_raster_sql(18, 36)}",
    "tiles6": """SELECT 6 AS "order", CAST(range // 64 AS INTEGER) AS face, range % 8 AS x, (range // 8) % 8 AS y FROM range(0, 768)""",
}
NEEDS = {"particles": ["raw_particles"], "clustered": ["particles"], "dense_map": ["particles"], "stored": ["particles"], "cube": ["dense_map"]}


def sql(names: str, select: str, **more: str) -> str:
    """`select` below WITH the named expressions, what they need, and `more` ones."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in NEEDS.get(n, []):
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {select}"
