"""Incremental pyramids and tile fills on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..sources.tables import read_particles
from ..sources.versions import Versions


def particle_state(particles: DataFrame, order: int, to: int) -> DataFrame:
    """(cell, n, total) of a stream (or table) of particles: additive, so neither order nor lateness matters."""
    kept = read_particles(particles, order)
    return kept.groupBy(C.parent("cell", order - to).alias("cell")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total"))


def stream_particles(stream: DataFrame, order: int, to: int, out: str, checkpoint: str) -> None:
    """Runs the stream to its present end; `out` then holds the partial (cell, n, total) of every batch so far.

    A batch writes only its own cells, into batch=<id>, and replaces them if it runs again after a failure; no batch
    touches another's. Sums do not depend on how the stream was cut into batches: read them with read_particle_state.
    """

    def one(df: DataFrame, batch: int) -> None:
        particle_state(df, order, to).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_particle_state(spark: SparkSession, out: str) -> DataFrame:
    """(cell, n, total) of all particles that stream_particles has read into `out`."""
    return spark.read.parquet(out).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class ParticleTotals:
    """(cell, n, total) of a stream of particles in `folder`: parts by level, compacted as batches come.

    A batch adds one part at level 0; `fanout` parts of a level become one of the next, so n batches leave about
    fanout * log(n) parts, and a cell is rewritten once a level. A batch counts when the state that names its part and its
    number is published, last of all; one that runs again after that is left out, one that failed before is written anew.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 8):
        if fanout < 2:
            raise ValueError("fanout: 2 at least")
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.states = Versions(spark, folder, "batch long, levels array<array<string>>")

    def _parts(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema("cell long, n long, total double").parquet(*[f"{self.folder}/{n}" for n in names])

    def _write(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def add(self, totals: DataFrame, batch: int) -> None:
        """Adds the (cell, n, total) of batch number `batch`, once."""
        before = self.states.current()
        if before and batch <= before["batch"]:
            return
        levels = [list(level) for level in before["levels"]] if before else [[]]
        levels[0].append(self._write(totals.select("cell", "n", "total")))
        for at in range(64):
            if len(levels[at]) < self.fanout:
                break
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(self._write(_summed(self._parts(levels[at]))))
            levels[at] = []
        named = F.array(*[F.array(*map(F.lit, level)).cast("array<string>") for level in levels])
        self.states.publish(before, batch=F.lit(batch).cast("long"), levels=named)

    def vacuum(self) -> int:
        """Deletes the parts that the current state does not name, and says how many; no batch may be running, nor a reader."""
        now = self.states.current()
        return self.states.delete_unnamed("", {n for level in now["levels"] for n in level}, "part-") if now else 0

    def read(self) -> DataFrame:
        """(cell, n, total) of all batches so far."""
        now = self.states.current()
        names = [n for level in now["levels"] for n in level] if now else []
        return _summed(self._parts(names)) if names else self.spark.createDataFrame([], "cell long, n long, total double")


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def stream_particle_totals(stream: DataFrame, order: int, to: int, out: str, checkpoint: str, fanout: int = 8) -> ParticleTotals:
    """Runs the stream to its present end and adds each batch to the compacted totals in `out`, which are returned.

    The result depends neither on how the stream was cut nor on batches that ran twice. Batches are numbered by the checkpoint,
    so `out` and `checkpoint` belong together; with a lost checkpoint the same cuts are left out as known.
    """
    spark = stream.sparkSession

    def one(df: DataFrame, batch: int) -> None:
        ParticleTotals(spark, out, fanout).add(particle_state(df, order, to), batch)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return ParticleTotals(spark, out, fanout)


def stream_tile_fill(requests: DataFrame, fill: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str, keys: tuple[str, ...] = ("order", "face", "x", "y")) -> None:
    """Runs a stream of tile requests to its present end: each tile is filled once, repeats come from the cache.

    Spark's own state, kept with the checkpoint and dealt by tile, knows every tile asked for before, so a batch meets its new
    tiles alone and reads nothing of the cache, however large that is. It writes them into its own partition batch=<id>, which
    is replaced if the batch runs again. A cache that is there without its checkpoint is looked up by every batch of this run.
    """
    spark = requests.sparkSession
    known = _stored(spark, cache) if _new(spark, checkpoint) else None

    def one(df: DataFrame, batch: int) -> None:
        if known is not None:
            df = df.join(known.where(F.col("batch") != batch).select(*keys), list(keys), "left_anti")
        fill(df).write.mode("overwrite").parquet(f"{cache}/batch={batch}")

    fresh = requests.select(*keys).dropDuplicates(list(keys))
    fresh.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _new(spark: SparkSession, checkpoint: str) -> bool:
    """Whether no batch has been planned with this checkpoint."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(f"{checkpoint}/offsets").isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return True
        raise


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache, or None where no batch has written yet; any other error is the caller's."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
