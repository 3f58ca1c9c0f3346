"""Stored layers that change as a whole: tiles and the manifest's entry are swapped in one step, old ones stay readable."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .codec import requantize_layer, value_of

ENTRY = {"layer": "string", "part": "string", "dtype": "string", "scale": "double", "offset": "double", "nodata": "int"}
TILE = ("order", "face", "x", "y")


class LayerStore:
    """Layers of one dataset in `folder`, each in a folder of tiles that the current state names, with its encoding.

    A new form of a layer is written beside the old one, then a state that names it is published: readers find the old layer
    with the old entry until then and the new layer with the new entry after, whatever fails between. `vacuum` deletes what the
    last states no longer name.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        fields = ", ".join(f"{name}: {kind}" for name, kind in ENTRY.items())
        self.states = Versions(spark, folder, f"layers array<struct<{fields}>>")

    def entries(self) -> DataFrame:
        """(layer, part, dtype, scale, offset, nodata): the manifest's rows."""
        state = self.states.current()
        return self.spark.createDataFrame(state["layers"] if state else [], ", ".join(f"{name} {kind}" for name, kind in ENTRY.items()))

    def _entry(self, layer: str) -> Row:
        state = self.states.current()
        for e in state["layers"] if state else []:
            if e["layer"] == layer:
                return e
        raise KeyError(f"no layer {layer!r}")

    def write(self, layer: str, tiles: DataFrame, q: dict | None = None) -> None:
        """Stores (order, face, x, y, values[]) as `layer`, in place of one of that name; q: the quantization of codes (codes[])."""
        before = self.states.current()
        part = uuid.uuid4().hex
        column = "values" if q is None else "codes"
        tiles.select(*TILE, column).sortWithinPartitions("order", "face", "y", "x").write.partitionBy("order", "face").parquet(f"{self.folder}/{layer}/{part}")
        entry = {"layer": layer, "part": part, "dtype": "float32" if q is None else q["dtype"], **{k: None if q is None else q[k] for k in ("scale", "offset", "nodata")}}
        rows = [e.asDict() for e in (before["layers"] if before else []) if e["layer"] != layer] + [entry]
        self.states.publish(before, layers=F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in ENTRY.items()]) for r in sorted(rows, key=lambda r: r["layer"])]))

    def stored(self, layer: str) -> DataFrame:
        """(order, face, x, y, values[] or codes[]) as stored."""
        return self.spark.read.parquet(f"{self.folder}/{layer}/{self._entry(layer)['part']}")

    def read(self, layer: str) -> DataFrame:
        """(order, face, x, y, values[]): decoded where the layer holds codes."""
        e = self._entry(layer)
        found = self.spark.read.parquet(f"{self.folder}/{layer}/{e['part']}")
        if e["dtype"] != "float32":
            found = found.withColumn("values", F.transform("codes", lambda c: value_of(c, e.asDict())))
        return found.select(*TILE, "values")

    def requantize(self, layer: str, dtype: str = "int16", step: float | None = None) -> dict:
        """Replaces a layer by its codes at a new quantization, which is returned; absent tiles stay absent."""
        codes, q = requantize_layer(self.read(layer), dtype, step)
        self.write(layer, codes, q)
        return q

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the parts that the last `keep` states do not name, and says how many. Readers of older ones must be done, and
        no other job may be writing."""
        if keep < 1:
            raise ValueError("keep: the current state at least")
        states = self.states.all()
        used = {e["part"] for s in states[-keep:] for e in s["layers"]}
        return sum(self.states.delete_unnamed(layer, used) for layer in sorted({e["layer"] for s in states for e in s["layers"]}))
