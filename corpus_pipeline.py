"""Corpus pipeline: toxicity, near-dedup, substring dedup, PII, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The stages before the last return
the columns of `documents`; where a stage changes a text, n_chars is its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spheretiles.llm import minhash_dedup, packing, pii, substring_dedup, toxicity
from spheretiles.llm.tables import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose noisy-or score is 0.5 or more; the model learns from the labels of documents in `docs`."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs.select(*COLUMNS), model).where("tox_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts with a five-word shingle similarity of 0.8 or more.

    0.8 is the similarity for near-duplicate stages where no contract says otherwise (op10's says 0.85).
    Every row is a document of its own: of a repeated row one copy stays, and rows with a null id count after all ids.
    """
    named = docs.withColumn("__row", F.col("doc_id").cast("long"))
    if not named.groupBy("__row").count().where("count > 1 or __row is null").isEmpty():
        named = _with_row_ids(docs)
    found = minhash_dedup.near_duplicates(named, percent=80, side=12, id="__row")
    lost = found.where("not kept").select(F.col("doc_id").alias("__row"))
    return named.join(lost, "__row", "left_anti").select(*COLUMNS)


def _with_row_ids(docs: DataFrame) -> DataFrame:
    """`docs` with __row added: doc_id for the first row of each, a number above all ids for other and null-id rows."""
    rows = written(docs.withColumn("__at", F.monotonically_increasing_id()))
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "__at")).alias("f")).select("f.__at", F.lit(True).alias("__first"))
    above = max(rows.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0, 0) + 1
    row = F.when(F.col("__first"), F.col("doc_id").cast("long")).otherwise(F.col("__at") + F.lit(above))
    return rows.join(first, "__at", "left").withColumn("__row", row).drop("__at", "__first")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of repeated 35-word windows; a text that loses none stays as it is."""
    found = substring_dedup.substring_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return _with_text(found, text)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by [EMAIL], [IP], [CARD] or [PHONE]."""
    return _with_text(pii.pii(docs.select(*COLUMNS)), pii.redacted("text", "pii_spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [("toxicity", drop_toxic), ("near-dedup", drop_near_copies), ("substring dedup", cut_repeats), ("pii", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; each stage's result is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
