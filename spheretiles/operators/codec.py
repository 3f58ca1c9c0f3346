"""Quantizing, display scaling, colours and relief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import finite
from .aggregate import finite_range

#: fixed values: lowest code, highest code, nodata code
CODES = {"uint16": (0, 65534, 65535), "int16": (-32767, 32767, -32768)}


def quantization(low: float, high: float, dtype: str, step: float | None = None) -> dict:
    """scale, offset and nodata of a linear code for values from low to high; an error if a given step cannot reach both."""
    first, last, nodata = CODES[dtype]
    scale = step if step is not None else (high - low) / 65534
    if scale <= 0:
        raise ValueError("the step must be positive")
    offset = low if dtype == "uint16" else (low + high) / 2
    if round((high - offset) / scale) > last or round((low - offset) / scale) < first:
        raise ValueError("the range does not fit the code at this step")
    return {"scale": scale, "offset": offset, "nodata": nodata, "dtype": dtype}


def code_of(v: Column, q: dict) -> Column:
    first, last, nodata = CODES[q["dtype"]]
    code = F.rint((v.cast("double") - q["offset"]) / q["scale"])
    return F.when(finite(v), F.least(F.greatest(code, F.lit(float(first))), F.lit(float(last))).cast("int")).otherwise(F.lit(nodata))


def value_of(code: Column, q: dict) -> Column:
    return F.when(code == q["nodata"], F.lit(float("nan"))).otherwise(code * q["scale"] + q["offset"]).cast("float")


def quantize_layer(df: DataFrame, dtype: str = "uint16", step: float | None = None, limits: tuple[float, float] | None = None) -> tuple[DataFrame, dict]:
    """Adds `code` (int); non-finite values become nodata, values out of range saturate."""
    low, high = limits or finite_range(df)
    q = quantization(low, high, dtype, step)
    return df.withColumn("code", code_of(F.col("value"), q)), q


def dequantize_layer(df: DataFrame, q: dict | None) -> DataFrame:
    """Adds `decoded`; float layers (q None) pass through. valueScale and valueOffset are accepted for scale and offset."""
    if q is None:
        return df.withColumn("decoded", F.col("value"))
    q = {"scale": q.get("scale", q.get("valueScale", 1)), "offset": q.get("offset", q.get("valueOffset", 0)), "nodata": q["nodata"]}
    return df.withColumn("decoded", value_of(F.col("code"), q))


def requantize_layer(tiles: DataFrame, dtype: str = "int16", step: float | None = None) -> tuple[DataFrame, dict]:
    """Stored float tiles (values[]) as code tiles (codes[]); absent tiles of sparse layers stay absent."""
    flat = tiles.select(F.explode("values").alias("value"))
    q = quantization(*finite_range(flat), dtype, step)
    return tiles.withColumn("codes", F.transform("values", lambda v: code_of(v, q))).drop("values"), q


def display_limits(stats: dict) -> tuple[float, float]:
    """p1 and p99, else min and max, else -1 and 1."""
    for low, high in (("p1", "p99"), ("min", "max")):
        if stats.get(low) is not None and stats.get(high) is not None:
            return stats[low], stats[high]
    return -1.0, 1.0


def normalize_values(df: DataFrame, low: float, high: float, scale: str = "linear", constant: float = 0.03, value: str = "value") -> DataFrame:
    """Adds t in 0..1; a degenerate range gives 0.5."""
    v = F.col(value).cast("double")
    if not high > low:
        return df.withColumn("t", F.lit(0.5))
    if scale == "log":
        floor = max(low, 2.220446049250313e-16)
        t = (F.log(F.greatest(v, F.lit(floor))) - F.log(F.lit(floor))) / (F.log(F.lit(float(high))) - F.log(F.lit(floor)))
    elif scale == "symlog":
        bent = lambda x: F.signum(x) * F.log1p(F.abs(x) / constant)
        lo, hi = bent(F.lit(float(low))), bent(F.lit(float(high)))
        t = (bent(v) - lo) / (hi - lo)
    else:
        t = (v - low) / (high - low)
    return df.withColumn("t", F.when(F.isnan(v), F.lit(float("nan"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))))


# fixed values: colour stops (place, red, green, blue) that the display tables prescribe
VIRIDIS = ((0.0, 68, 1, 84), (0.13, 71, 44, 122), (0.25, 59, 82, 139), (0.38, 44, 113, 142), (0.5, 33, 145, 140), (0.63, 39, 173, 129), (0.75, 92, 200, 99), (0.88, 170, 220, 50), (1.0, 253, 231, 37))
MAGMA = ((0.0, 0, 0, 4), (0.14, 31, 17, 81), (0.28, 81, 18, 124), (0.42, 130, 37, 129), (0.56, 181, 54, 122), (0.7, 229, 80, 100), (0.84, 252, 137, 97), (1.0, 252, 253, 191))
BALANCE = ((0.0, 49, 54, 149), (0.18, 69, 117, 180), (0.36, 171, 217, 233), (0.5, 246, 246, 238), (0.64, 253, 174, 97), (0.82, 215, 48, 39), (1.0, 120, 20, 36))
#: fixed values: colour of what has no value
NO_VALUE = (41, 43, 45)
# fixed values: polynomial coefficients of turbo, constant first
TURBO = {"r": (34.61, 1172.33, -10793.56, 33300.12, -38394.49, 14825.05), "g": (23.31, 557.33, 1225.33, -3574.96, 1073.77, 707.56), "b": (27.2, 3211.1, -15327.97, 27814.0, -22569.18, 6838.66)}


def stops(name: str) -> tuple:
    if name == "balance":
        return BALANCE
    return MAGMA if name == "magma" else VIRIDIS


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def channel(t: Column, name: str, which: int) -> Column:
    """One colour channel (0 red, 1 green, 2 blue) of t."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    if name == "turbo":
        k = TURBO["rgb"[which]]
        total = F.lit(k[-1])
        for c in k[-2::-1]:
            total = c + t * total
        return F.least(F.lit(255), F.greatest(F.lit(0), _half_up(total)))
    out, table = None, stops(name)
    for (t0, *a), (t1, *b) in zip(table, table[1:], strict=False):
        value = _half_up(a[which] + (b[which] - a[which]) * ((t - t0) / (t1 - t0)))
        out = F.when(t <= t1, value) if out is None else out.when(t <= t1, value)
    return out.otherwise(table[-1][which + 1])


def colour_values(df: DataFrame, name: str = "viridis", t: str = "t") -> DataFrame:
    """Adds r, g, b, a; non-finite t has the colour NO_VALUE, transparent."""
    ok = ~F.isnan(t) & F.col(t).isNotNull()
    return df.withColumns({c: F.when(ok, channel(F.col(t), name, i)).otherwise(NO_VALUE[i]) for i, c in enumerate("rgb")} | {"a": F.when(ok, 255).otherwise(0)})


#: fixed values: relief slope factor and light direction (before normalizing)
RELIEF_SLOPE, RELIEF_LIGHT = 0.006, (-0.45, -0.55, 0.72)
RELIEF_LAYERS = r"(?i)elevation|height|terrain|topo|dem"


def shade_tiles(cells: DataFrame, name: str = "viridis", layer: str | None = "elevation", keys: tuple[str, ...] = ("order", "face", "x", "y")) -> DataFrame:
    """Coloured cells (with ix, iy inside the tile and t) darkened or lightened by their slope; other layers keep colours."""
    import re

    df = colour_values(cells, name)
    if not layer or not re.search(RELIEF_LAYERS, layer):
        return df
    v = F.col("value").cast("double")
    row, column = Window.partitionBy(*keys, "iy").orderBy("ix"), Window.partitionBy(*keys, "ix").orderBy("iy")
    beside = lambda c: F.when(finite(c), c).otherwise(v)
    left, right = beside(F.lag(v).over(row)), beside(F.lead(v).over(row))
    above, below = beside(F.lag(v).over(column)), beside(F.lead(v).over(column))
    df = df.withColumns({"__dx": (right - left) * 0.5 * RELIEF_SLOPE, "__dy": (below - above) * 0.5 * RELIEF_SLOPE})
    size = sum(c * c for c in RELIEF_LIGHT) ** 0.5
    lx, ly, lz = (c / size for c in RELIEF_LIGHT)
    light = (-F.col("__dx") * lx - F.col("__dy") * ly + lz) / F.sqrt(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy") + 1)
    shade = F.when(finite(v), F.least(F.lit(1.18), F.greatest(F.lit(0.58), 0.78 + light * 0.34))).otherwise(1.0)
    df = df.withColumn("__s", shade)
    byte = lambda c: F.when(F.col("a") > 0, F.least(F.lit(255), F.greatest(F.lit(0), _half_up(F.round(F.col(c) * F.col("__s"), 9))))).otherwise(F.col(c))
    return df.withColumns({c: byte(c) for c in "rgb"}).drop("__dx", "__dy", "__s")


def shaded_tiles(cells: DataFrame, tile_shift: int, name: str = "viridis", layer: str | None = "elevation") -> DataFrame:
    """RGBA arrays, one row per tile (row-major)."""
    s = shade_tiles(cells, name, layer)
    rows = s.groupBy("order", "face", "x", "y").agg(F.array_sort(F.collect_list(F.struct(F.col("iy"), F.col("ix"), F.array("r", "g", "b", "a").alias("c")))).alias("p"))
    return rows.select("order", "face", "x", "y", F.flatten(F.transform("p", lambda q: q["c"])).alias("rgba"))
