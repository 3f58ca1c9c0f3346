"""Column expressions for cell ids, tiles and bits. Narrow, no shuffle, inside generated code.

`axes` says which bits hold ix: "even_x" (tiles, aggregation, selections) or "odd_x" (sky geometry).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _gathered(byte: int) -> int:
    """The four even bits of a byte."""
    return sum((byte >> (2 * i) & 1) << i for i in range(4))


def _spaced(byte: int) -> int:
    """The eight bits of a byte, moved to the even places."""
    return sum((byte >> i & 1) << (2 * i) for i in range(8))


def _looked_up(rule, byte: Column) -> Column:
    """rule(byte) by a constant table of 256 entries: an expression that names its input once."""
    return F.get(F.expr(f"array({','.join(str(rule(i)) for i in range(256))})"), byte.cast("int")).cast("long")


def as_column(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def up(x, bits) -> Column:
    """x * 2**bits for longs."""
    return F.call_function("shiftleft", as_column(x).cast("long"), as_column(bits).cast("int"))


def down(x, bits) -> Column:
    """floor(x / 2**bits) for non-negative longs."""
    return F.call_function("shiftrightunsigned", as_column(x).cast("long"), as_column(bits).cast("int"))


def low_bits(x, bits) -> Column:
    return as_column(x).cast("long").bitwiseAND(up(1, bits) - 1)


def _byte(v, k: int) -> Column:
    return F.shiftrightunsigned(as_column(v).cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))


def _bytes(order, bits: int) -> range:
    """Which bytes hold `bits` bits for each level; all where the order is a column."""
    return range(-(-bits * order // 8)) if isinstance(order, int) else range(8 if bits == 2 else 4)


def compact(v, order=29) -> Column:
    """The even bits of v, gathered (as many as `order` asks for)."""
    parts = [F.shiftleft(_looked_up(_gathered, _byte(v, k)), 4 * k) for k in _bytes(order, 2)]
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def spread(v, order=29) -> Column:
    """The bits of v, moved to the even places."""
    parts = [F.shiftleft(_looked_up(_spaced, _byte(v, k)), 16 * k) for k in _bytes(order, 1)]
    return reduce(lambda a, b: a + b, parts, F.lit(0).cast("long"))


def n_cells(order) -> Column:
    return up(12, as_column(order) * 2)


def face_of(cell, order) -> Column:
    """Null for ids out of the range of any face number, such as negative ones."""
    return down(cell, as_column(order) * 2).try_cast("int")


def cell_xy(cell, order, axes: str = "even_x") -> tuple[Column, Column]:
    local = low_bits(cell, as_column(order) * 2)
    even, odd = compact(local, order), compact(F.shiftrightunsigned(local, 1), order)
    return (even, odd) if _check(axes) == "even_x" else (odd, even)


def nested_id(face, ix, iy, order, axes: str = "even_x") -> Column:
    even, odd = (ix, iy) if _check(axes) == "even_x" else (iy, ix)
    return up(face, as_column(order) * 2) + spread(even, order) + F.shiftleft(spread(odd, order), 1)


def _check(axes: str) -> str:
    if axes not in ("even_x", "odd_x"):
        raise ValueError(f"axes is even_x or odd_x, not {axes!r}")
    return axes


def parent(cell, levels) -> Column:
    return down(cell, as_column(levels) * 2)


def grid(order, tile_shift: int) -> Column:
    """Tiles on a face's side; one where the order is below the tile shift."""
    return up(1, F.greatest(as_column(order).cast("int") - tile_shift, F.lit(0)))


def tile_code(face, x, y, side) -> Column:
    return (as_column(face).cast("long") * side + as_column(y)) * side + as_column(x)
