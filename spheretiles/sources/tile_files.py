"""A sink of one binary file per tile: `df.write.format("tile_files").mode(...).option("dtype", "<f4").save(path)`.

Rows (layer, order, face, x, y, values[]) become little-endian files layers/<layer>/<order>/<face>/<x>/<y>.bin below `path`, on
any file system that pyarrow opens by its address. A task writes each file under a name of its own and renames it when it is
whole, below a staging folder of the job; so a task that runs twice, even at the same time, leaves the same files. The job's
commit moves the staged layers to their place and writes _SUCCESS; an aborted job leaves the old files as they were.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "tile_files"


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class TileFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> TileFileWriter:
        if missing := {"layer", "order", "face", "x", "y", "values"} - set(schema.names):
            raise ValueError(f"tiles have no column {', '.join(sorted(missing))}")
        return TileFileWriter(self.options["path"], self.options.get("dtype", "<f4"), overwrite)


class TileFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, overwrite: bool):
        self.path, self.dtype, self.overwrite = path.rstrip("/"), dtype, overwrite
        self.job = uuid.uuid4().hex
        files, top = place_of(self.path)
        if not overwrite and files.get_file_info(f"{top}/layers").type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds tiles already: write with mode overwrite")

    def write(self, iterator) -> Written:
        """One task: every tile of its batches, staged."""
        files, top = place_of(self.path)
        attempt, n, size, made = uuid.uuid4().hex, 0, 0, set()
        for batch in iterator:
            layer, order, face, x, y = (batch.column(c).to_pylist() for c in ("layer", "order", "face", "x", "y"))
            values = batch.column("values")
            for i in range(batch.num_rows):
                folder = f"{top}/_staging-{self.job}/{layer[i]}/{order[i]}/{face[i]}/{x[i]}"
                body = values[i].values.to_numpy(zero_copy_only=False).astype(self.dtype).tobytes()
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                own = f"{folder}/.{y[i]}.{attempt}"
                with files.open_output_stream(own) as out:
                    out.write(body)
                files.move(own, f"{folder}/{y[i]}.bin")
                n, size = n + 1, size + len(body)
        return Written(n, size)

    def commit(self, messages) -> None:
        """Staged layers take the place of the old ones: two renames, whatever the number of tiles."""
        files, top = place_of(self.path)
        staged, old = f"{top}/_staging-{self.job}", f"{top}/_old-{self.job}"
        files.create_dir(staged)  # a job without tiles
        if files.get_file_info(f"{top}/layers").type != fs.FileType.NotFound:
            files.move(f"{top}/layers", old)
        files.move(staged, f"{top}/layers")
        with files.open_output_stream(f"{top}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in messages if m), "bytes": sum(m.size for m in messages if m)}).encode())
        if files.get_file_info(old).type != fs.FileType.NotFound:
            files.delete_dir(old)

    def abort(self, messages) -> None:
        files, top = place_of(self.path)
        if files.get_file_info(f"{top}/_staging-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{top}/_staging-{self.job}")


def save_tile_files(tiles: DataFrame, path: str, dtype: str = "<f4", force: bool = False) -> None:
    """Writes `tiles` with this sink; an error where `path` holds tiles, unless `force`. A tile that comes twice is an error."""
    tiles.sparkSession.dataSource.register(TileFiles)
    twice = tiles.groupBy("layer", "order", "face", "x", "y").count().where("count > 1").select("layer", "order", "face", "x", "y").first()
    if twice:
        raise ValueError(f"a tile comes twice: {tuple(twice)}")
    rows = tiles.select("layer", "order", "face", "x", "y", "values")
    rows.write.format(NAME).option("dtype", dtype).option("path", path).mode("overwrite" if force else "append").save()


def read_tile_files(spark, path: str, dtype: str = "<f4") -> DataFrame:
    """(layer, order, face, x, y, values) of the files that the sink wrote below `path`; names that are not staged ones."""
    kind = "double" if dtype.endswith("f8") else "float" if "f" in dtype else "int"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true").load(f"{path}/layers")

    def decode(batches):
        for b in batches:
            parts = [p.rsplit("/", 5) for p in b.column("path").to_pylist()]
            values = [np.frombuffer(c, dtype) for c in b.column("content").to_pylist()]
            numbers = [pa.array([int(p[k].removesuffix(".bin")) for p in parts], t) for k, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64()))]
            kinds = {"double": pa.float64(), "float": pa.float32(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([p[1] for p in parts]), *numbers, pa.array(values, pa.list_(kinds[kind]))], names=["layer", "order", "face", "x", "y", "values"])

    return files.select("path", "content").mapInArrow(decode, f"layer string, order int, face int, x long, y long, values array<{kind}>")
