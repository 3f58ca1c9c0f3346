"""The state of a stored dataset as numbered versions: whoever publishes the next number wins, readers see whole states only."""

from __future__ import annotations

from pyarrow.fs import FileSelector
from pyspark.errors import AnalysisException
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from .tile_files import place_of


class Versions:
    """Below `folder`/_state there is a folder for each of the last `keep` versions, with one JSON row of type `schema` (DDL).

    Data is written first, under names of its own, and counts once a version names it. A job that fails in between leaves the
    state before it; publishing after a state that is no longer the last is an error, so of two jobs that begin from one state
    the later fails. Older versions are deleted when one is published, so reading costs the same after any number of them.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keep: int = 8):
        if keep < 2:
            raise ValueError("keep: the last two versions at least")
        self.spark, self.folder, self.schema, self.keep = spark, folder.rstrip("/"), schema, keep

    def all(self) -> list[Row]:
        """The states that are kept, oldest first."""
        try:
            found = self.spark.read.schema(f"version long, {self.schema}").json(f"{self.folder}/_state/v*")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(found.where("version is not null").collect(), key=lambda r: r["version"])

    def current(self) -> Row | None:
        found = self.all()
        return found[-1] if found else None

    def publish(self, after: Row | None, **fields: Column) -> None:
        """The state that follows `after`, the last one its writer knows."""
        last, mine = self.current(), after["version"] if after else -1
        if (last["version"] if last else -1) != mine:
            raise RuntimeError(f"version {mine + 1} of {self.folder} exists: another job has published")
        columns = [F.lit(mine + 1).cast("long").alias("version"), *[c.alias(n) for n, c in fields.items()]]
        self.spark.range(1, numPartitions=1).select(*columns).write.mode("errorifexists").json(f"{self.folder}/_state/v{mine + 1}")
        files, top = place_of(self.folder)
        for found in files.get_file_info(FileSelector(f"{top}/_state")):
            if found.base_name[1:].isdigit() and int(found.base_name[1:]) <= mine + 1 - self.keep:
                files.delete_dir(found.path)

    def delete_unnamed(self, below: str, named: set[str], prefix: str = "") -> int:
        """Deletes what lies in `below` (a path under the dataset), begins with `prefix` and is not `named`; says how many."""
        files, top = place_of(self.folder)
        gone = 0
        for found in files.get_file_info(FileSelector(f"{top}/{below}", allow_not_found=True)):
            if found.base_name.startswith(prefix) and found.base_name not in named:
                files.delete_dir(found.path)
                gone += 1
        return gone
