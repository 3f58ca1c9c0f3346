"""Line dedup: levelled sorted runs of line hashes. A new batch merge-anti-joins the runs and adds its own.

A run is a table of line keys (`h`: 16 bytes of BLAKE2b; `docs`: rows holding the key; `last`: the largest id among them),
dealt into buckets by `h` and sorted by it, so joining a batch with a run merges bucket by bucket and the run is never
shuffled again. Every key is in one run alone:

1. The keys of a batch become a bucketed, sorted table: the only shuffle of the batch, combined before it.
2. A merge-anti-join with every run leaves its fresh keys: they are the batch's own run, at level 0. What the runs held
   already goes to a table of repeats, which stays small: only keys of more than one batch are in it.
3. `fanout` runs of a level are compacted to one of the next level, so a key is rewritten once a level and a batch meets
   fewer than fanout runs a level.
4. The total of a key is that of its run and of its repeats. Keys in `least` documents or more are heavy.
5. Texts are dealt into slices of about `SLICE` bytes; a slice sends each of its distinct keys once, so a line that a third
   of all documents hold is no hot key, and gets those back that are heavy, with the document that keeps them.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import documents, shared_folder
from .words import SEPARATORS, pieces

SLICE = 2 << 20
ADDED = ("n_lines", "n_dropped", "kept_text")


def line_key(line: bytes, chars: int) -> bytes | None:
    """The hash of a line's key (white space stripped at both ends, A-Z lower-cased), None below `chars` code points."""
    key = line.strip(SEPARATORS).lower()
    if len(key) < chars or not key.isascii() and len(key.decode("utf-8", "replace")) < chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _bodies(batch, text: str) -> list[bytes]:
    return [b or b"" for b in batch.column(text).cast(pa.large_binary()).to_pylist()]


def _keys(docs: DataFrame, id: str, text: str, chars: int) -> DataFrame:
    """(h, last, size): a row for each row of `docs` and distinct key in it, and one with a null `h` for the bytes of a slice."""
    kind = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("last", docs.schema[id].dataType), T.StructField("size", T.LongType())])

    def emit(batches):
        for batch in batches:
            for part in pieces(batch, text):
                bodies = _bodies(part, text)
                found = [(row, h) for row, body in enumerate(bodies) for h in {line_key(line, chars) for line in body.split(b"\n")} - {None}]
                ids = part.column(id).take(pa.array([row for row, _ in found] + [0], pa.int64()))
                size = [0] * len(found) + [sum(map(len, bodies))]
                yield pa.RecordBatch.from_arrays([pa.array([h for _, h in found] + [None], pa.binary()), ids, pa.array(size, pa.int64())], names=["h", "last", "size"])

    return docs.select(id, text).mapInArrow(emit, kind)


def line_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: int = 40) -> DataFrame:
    """(h, docs, last) of the lines of `docs` whose key has `chars` code points or more: what LineRuns.add takes."""
    return _keys(docs, id, text, chars).where("h is not null").groupBy("h").agg(F.count("*").alias("docs"), F.max("last").alias("last"))


class LineRuns:
    """Sorted runs of line keys in `folder`, by level; opening the folder again goes on from the last finished batch.

    `buckets` (at first: spark.sql.shuffle.partitions) stays as it was when the folder was new. A batch counts when its state
    is written, last of all: files of a batch that failed before are never read. Runs that were compacted are not deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout: 2 at least")
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.levels, self.repeats = 0, [[]], []
        try:
            rows = spark.read.json(f"{folder}/state/*").orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException:  # a new folder
            rows = []
        for r in rows:
            self.version, self.buckets, self.repeats = r["version"], r["buckets"], list(r["repeats"])
            self.levels = [list(level) for level in r["levels"]]
            self.kind = r["kind"]

    def _table(self, name: str) -> DataFrame:
        """The run `name`, known to this session as a bucketed table."""
        table = f"line_run_{name}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} (h BINARY, docs BIGINT, last {self.kind}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/runs/{name}'")
        return self.spark.table(table)

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.select("h", "docs", "last").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.folder}/runs/{name}").saveAsTable(f"line_run_{name}")
        return name

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "h")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` that no run holds, by one merge for each run."""
        for run in (r for level in self.levels for r in level):
            keys = keys.join(self._table(run).hint("merge"), "h", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds a batch: `keys` (h, docs, last) with each h once, of documents that no earlier batch had."""
        self.kind = keys.schema["last"].dataType.simpleString()
        own = self._write(self._dealt(keys))
        levels, repeats = [list(level) for level in self.levels], list(self.repeats)
        if any(levels):
            fresh = self._write(self.unseen(self._table(own)))
            repeats.append(self._write(self._table(own).join(self._table(fresh).hint("merge"), "h", "left_anti")))
        else:
            fresh = own
        levels[0].append(fresh)
        at = 0
        while at < len(levels):
            if len(levels[at]) >= self.fanout:
                merged = self._write(self._dealt(self._union(levels[at])))
                levels[at : at + 1] = [[]]
                if at + 1 == len(levels):
                    levels.append([])
                levels[at + 1].append(merged)
            at += 1
        if len(repeats) >= self.fanout:
            repeats = [self._write(self._summed(repeats))]
        names = lambda runs: F.array(*map(F.lit, runs)).cast("array<string>")
        state = F.lit(self.version + 1).alias("version"), F.lit(self.buckets).alias("buckets"), F.lit(self.kind).alias("kind"), F.array(*map(names, levels)).alias("levels"), names(repeats).alias("repeats")
        self.spark.range(1, numPartitions=1).select(*state).write.json(f"{self.folder}/state/{self.version + 1}")
        self.version, self.levels, self.repeats = self.version + 1, levels, repeats

    def _union(self, runs: list[str]) -> DataFrame:
        out = self._table(runs[0])
        for run in runs[1:]:
            out = out.unionByName(self._table(run))
        return out

    def _summed(self, runs: list[str]) -> DataFrame:
        return self._dealt(self._union(runs)).groupBy("h").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def totals(self) -> DataFrame:
        """(h, docs, last) of every key of all batches."""
        out = self._union([r for level in self.levels for r in level])
        if not self.repeats:
            return out
        again = self._summed(self.repeats).select("h", F.col("docs").alias("__n"), F.col("last").alias("__last"))
        return out.join(again, "h", "left").select("h", (F.col("docs") + F.coalesce("__n", F.lit(0))).alias("docs"), F.greatest("last", "__last").alias("last"))


def line_dedup(docs: DataFrame, least: int = 5, chars: int = 40, batches: int = 4, fanout: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the columns n_lines, n_dropped and kept_text added (all other columns stay).

    Lines are what \\n separates; a null or empty text has one empty line. Keys of `chars` code points or more that are in
    `least` rows or more lose all their lines but in the rows of the largest id that holds them; the other lines stay, joined
    by \\n. Every row is a document of its own: equal rows count each, and keep their lines together where theirs is the
    largest id. A null id is below all others. An empty table gives an empty table. Columns of `docs` with the names of added
    ones are replaced. `batches` is how many batches the rows are added in; the result does not depend on it.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    keys = _keys(docs, id, text, chars).withColumn("batch", F.pmod(F.xxhash64("last"), F.lit(batches)))
    found = keys.groupBy("batch", "h").agg(F.count("*").alias("docs"), F.max("last").alias("last"), F.sum("size").alias("size"))
    found.write.partitionBy("batch").parquet(f"{folder}/keys")
    staged = spark.read.schema(found.schema).parquet(f"{folder}/keys")
    slices = -(-(staged.where("h is null").agg(F.sum("size")).first()[0] or 0) // SLICE)
    runs = LineRuns(spark, f"{folder}/lines", fanout)
    for b in range(batches):
        runs.add(staged.where((F.col("batch") == b) & F.col("h").isNotNull()).select("h", "docs", "last"))
    heavy = runs.totals().where(F.col("docs") >= least).select("h", "last")

    base = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f.name for f in base]
    sliced = docs.select(*names, *([] if text in names else [text])).withColumn("__slice", F.pmod(F.xxhash64(id, text), F.lit(max(1, slices)))).repartition("__slice")

    def send(batches):
        for batch in batches:
            rows = {(s, line_key(line, chars)) for s, body in zip(batch.column("__slice").to_pylist(), _bodies(batch, text), strict=True) for line in body.split(b"\n")}
            rows = [(s, h) for s, h in rows if h is not None]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.binary())], names=["__slice", "h"])

    def cut(mine: pa.Table, answers: pa.Table) -> pa.Table:
        keeps = dict(zip(answers.column("h").to_pylist(), answers.column("last").to_pylist(), strict=True))
        counts, dropped, kept = [], [], []
        for own, body in zip(mine.column(id).to_pylist(), _bodies(mine, text), strict=True):
            lines = body.split(b"\n")
            stay = [line for line in lines if keeps.get(line_key(line, chars), own) == own]
            counts.append(len(lines))
            dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay))
        return pa.table([*[mine.column(n) for n in names], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, *ADDED])

    # `send` takes all columns, so that both sides read one shuffle
    sent = sliced.mapInArrow(send, "__slice long, h binary").groupBy("__slice", "h").agg(F.lit(1).alias("one"))
    answers = sent.join(heavy, "h").select("__slice", "h", "last")
    schema = T.StructType([*base, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])
    return sliced.groupBy("__slice").cogroup(answers.groupBy("__slice")).applyInArrow(cut, schema)


def op13_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: lines dropped and the digest of the kept lines of every document."""
    found = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
heavy AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
s AS (SELECT k.*, heavy.key IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN heavy USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id
"""
