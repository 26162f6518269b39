"""Sources: driver tables, in-memory corpora, event streams, mock frame source, solid buffers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "corpus_id string, ord long, chunk_id string, doc string, kind string, text string"
QUESTION = "question_id string, corpus_id string, query string, query2 string, intent string, top_k int"
LIFECYCLE_EVENT = "case_id string, seq long, op string, is_first_frame boolean, width long, height long, scale double"
PRESENT_EVENT = "case_id string, seq long, frame_tag string, inject_error string, recreate boolean"
#: Source types of an intent in order of priority.
PREFERENCES = {"how_many": ("author_anchor", "forward_reference", "code_literal")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, per_task: int) -> DataFrame:
    """``rows`` dealt by a key to tasks of about so many each: for rows that are small when they are read and costly or large
    after that, as a task reads megabytes of them. Takes a count."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), key)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with ``ts`` as a UTC timestamp, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def corpus(spark: SparkSession, corpus_id: str, chunks: Iterable[tuple[str, str, str, str]]) -> DataFrame:
    """An in-memory corpus from (chunk_id, doc, kind, text); ``ord`` keeps the order, which breaks ties. A null
    kind is prose."""
    rows = [(corpus_id, k, c, d, kind or "prose", text) for k, (c, d, kind, text) in enumerate(chunks)]
    return spark.createDataFrame(rows, CHUNK)


def document_corpora(documents: DataFrame) -> DataFrame:
    """Every source of ``documents`` as a corpus of prose chunks, in order of doc_id."""
    source = F.coalesce("source", F.lit(""))
    return documents.select(source.alias("corpus_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("chunk_id"), source.alias("doc"), F.lit("prose").alias("kind"), "text")


def questions(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """(question_id, corpus_id, query, query2, intent, top_k)."""
    return spark.createDataFrame(list(rows), QUESTION)


def preferences(spark: SparkSession, registry: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """(intent, source_type, priority from 1); an empty registry gives an empty table."""
    of = PREFERENCES if registry is None else registry
    return spark.createDataFrame([(i, s, k) for i, types in of.items() for k, s in enumerate(types, 1)], "intent string, source_type string, priority int")


def mock_frame_request(spark: SparkSession, case_id: str = "mock") -> DataFrame:
    """The prepare event of the mock frame source: 1920 x 1080 at scale 1."""
    return spark.createDataFrame([(case_id, 0, "prepare", False, 1920, 1080, 1.0)], LIFECYCLE_EVENT)


def solid_buffer(width: Column, height: Column, rgba: tuple[int, int, int, int]) -> Column:
    """A row-major RGBA buffer of one colour: struct of data (4 x width x height bytes), width, height and
    stride (4 x width)."""
    pixel = F.lit("".join(f"{x:02x}" for x in rgba))
    return F.struct(F.unhex(F.repeat(pixel, (width * height).cast("int"))).alias("data"), width.cast("long").alias("width"), height.cast("long").alias("height"), (width * 4).cast("long").alias("stride"))


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of event files, so many per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
