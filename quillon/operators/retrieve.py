"""Retrieval: overlap scores, stable top-k, positive scores only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import overlap, query_words
from quillon.operators import index

#: Questions of up to so many bytes are broadcast to the chunks, which are scanned once for all of them; more are
#: looked up in an index of the chunks.
BROADCAST_BYTES = 8 << 20
#: Bytes that a question's row has besides its queries, about.
ROW_BYTES = 64
DEFAULT_K = 4


def score(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Each question's chunks (those of its corpus) with ``score``. A null text or query scores 0. Questions are
    broadcast if their caller has checked their size, else as Spark decides."""
    asked = questions.withColumn("words", query_words(F.coalesce("query", F.lit(""))))
    lowered = chunks.withColumn("lowered", F.lower(F.coalesce("text", F.lit(""))))
    return lowered.join(asked, "corpus_id").withColumn("score", overlap(F.col("words"), F.col("lowered"))).drop("lowered", "words")


def top_k(scored: DataFrame, most: int, default_k: int = DEFAULT_K) -> DataFrame:
    """The first k chunks of each question by score, equal scores in corpus order, without those that score 0.

    ``rank`` counts from 1. k is the question's ``top_k``, or the default where it is null; ``most`` is the
    largest of them: a constant, so that ranks are limited on either side of the shuffle."""
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "ord")))
    return ranked.where((F.col("rank") <= most) & (F.col("rank") <= F.coalesce("top_k", F.lit(default_k))))


def retrieve(chunks: DataFrame, questions: DataFrame, default_k: int = DEFAULT_K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each question's first chunks, by a scan of all chunks if the questions are few, else by an index. What tells is
    the questions' size, which takes a job of its own."""
    queries = [c for c in ("query", "query2") if c in questions.columns]
    row = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in queries), F.lit(ROW_BYTES))
    size, most = questions.agg(F.sum(row), F.max(F.coalesce("top_k", F.lit(default_k)))).first()
    if (size or 0) > broadcast_bytes:
        return index.retrieve(chunks, questions, index.build(chunks), default_k, most or 0)
    return top_k(score(chunks, F.broadcast(questions)), most or 0, default_k)


def refined(questions: DataFrame) -> DataFrame:
    """The questions with their second query, where there is one that is not empty."""
    return questions.withColumn("query", F.when(F.length("query2") > 0, F.col("query2")).otherwise(F.col("query")))
