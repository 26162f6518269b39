"""Quality rules with a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into ``N_BUCKETS`` buckets. Two multinomials over the buckets are
counted: the trusted target (documents labelled good) and the raw corpus (all documents). A document's
score is the mean, over its n-grams, of log p_target - log p_raw; length-normalised, so that long and
short texts compare. One threshold decides every document: the ``LOWEST`` quantile, less ``MARGIN`` interquartile
ranges, of trusted documents that the target was not counted on.

Words are hashed once; bigrams and the windows of the repeat rule are hashes of hashes. Counting is one pass with
map-side sums (``N_BUCKETS`` rows leave each task); scoring stays within the row, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, quoted, staged, table, without, words_of
from quillon.operators import ranges

N_BUCKETS = 1 << 16
#: One in ``HELD_OUT`` trusted documents is kept for the threshold, which all of these give; the target multinomial counts
#: all others.
HELD_OUT = 5
#: Scores are compared in units of one by so many when the threshold is taken.
UNITS = 10**12
#: Trusted ids are broadcast up to so many bytes, about; more are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 40
#: Pseudo-counts, as a share of a multinomial spread evenly over the buckets.
SMOOTHING = 0.02
LOWEST, MARGIN = 0.005, 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
PRIVATE = ("__words", "__ones", "__twos", "__lines")


class Ratios(NamedTuple):
    """log p_target - log p_raw of each bucket, and the score at which a document is kept."""

    of: list[float]
    threshold: float


def with_grams(docs: DataFrame) -> DataFrame:
    """``docs`` with its words, their hashes (``__ones``) and those of neighbouring words (``__twos``)."""
    out = docs.withColumn("__words", words_of(F.col("text")))
    out = out.withColumn("__ones", F.transform("__words", lambda w: F.xxhash64(w)))
    return out.withColumn("__twos", _followed("__ones", 1))


def _followed(hashes: str, by: int) -> Column:
    """Hashes of all but the last ``by`` of some hashes, each with the word's hash that comes so many places later."""

    def followed(of: Column) -> Column:
        some = F.slice(of["hashes"], F.lit(1), F.greatest(F.size(of["ones"]) - by, F.lit(0)))
        return F.transform(some, lambda h, i: F.xxhash64(h, F.get(of["ones"], i + by)))

    return _let(F.struct(F.col(hashes).alias("hashes"), F.col("__ones").alias("ones")), followed)


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(N_BUCKETS - 1).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and never labelled bad, with ``good``: 1 for the target, 0 for the threshold."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select("doc_id", (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(HELD_OUT)) != 0).cast("int").alias("good"))


def fit_ratios(docs: DataFrame, labels: DataFrame) -> Ratios:
    """Counts both multinomials and takes the threshold. Where there is no trusted or no raw text all ratios are
    zero, and where no document is left to take the threshold from, none is rejected by it."""
    trusted = trusted_ids(labels)
    small = trusted.count() * ID_BYTES <= BROADCAST_BYTES
    counted = F.broadcast(trusted) if small else trusted
    of = docs.select("doc_id", "text").join(counted, "doc_id", "left")
    each = with_grams(of).select("good", F.concat("__ones", "__twos").alias("grams"))
    # outer, as else the optimiser adds a filter that computes the grams a second time
    each = each.select("good", F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")
    counts = each.groupBy(_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("target")).collect()
    raw, target = [0] * N_BUCKETS, [0] * N_BUCKETS
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    n_raw, n_target = sum(raw), sum(target)
    if not n_raw or not n_target:
        return Ratios([0.0] * N_BUCKETS, -math.inf)
    ratios = [round(math.log(_share(t, n_target) / _share(r, n_raw)), 4) for t, r in zip(target, raw)]
    held = trusted.where("good = 0").select("doc_id")
    left = docs.select("doc_id", "text").join(F.broadcast(held) if small else held, "doc_id")
    # filtered when it is staged, as else the optimiser applies the rules to all documents before they are joined
    scored = staged(apply_rules(left, Ratios(ratios, -math.inf)).select("base_failed", F.round(F.col("llr") * UNITS).cast("long").alias("score")), "held")
    spread = _quantiles(scored.where("NOT base_failed").select("score"), (LOWEST, 0.25, 0.75))
    if spread is None:
        return Ratios(ratios, -math.inf)
    least, low, high = (x / UNITS for x in spread)
    return Ratios(ratios, least - MARGIN * (high - low))


def _quantiles(numbers: DataFrame, shares: Sequence[float]) -> list[float] | None:
    """Quantiles of a column of bigint, between neighbours in proportion; None without a number. All numbers count, and the
    driver sees counts only."""
    last = numbers.count() - 1
    if last < 0:
        return None
    at = [last * q for q in shares]
    places = sorted({place(x) for x in at for place in (math.floor, math.ceil)})
    of = dict(zip(places, ranges.select(numbers, places)))
    return [of[math.floor(x)] + (of[math.ceil(x)] - of[math.floor(x)]) * (x - math.floor(x)) for x in at]


def _share(n: int, total: int) -> float:
    return (1 - SMOOTHING) * n / total + SMOOTHING / N_BUCKETS


def _ratios_column(ratios: list[float]) -> Column:
    """The table as one literal: a folded cast of its text form."""
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the optimiser moves or repeats the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """How many words windows cover that occur twice or more. Only texts that have one sort their windows; equal ones
    then stand side by side."""

    def starts(s: Column) -> Column:
        last = F.size(s) - 1
        again = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
        return F.array_sort(F.array_compact(F.transform(s, lambda x, k: F.when(again(x, k), x["i"]))))

    def words(p: Column) -> Column:
        # a window covers its three words, or as many as there are up to the next repeated window
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(by_hash, lambda s: _let(starts(s), words))).otherwise(F.lit(0))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds the counts of the fixed rules, the words and their hashes to ``docs``."""
    text, words, n = F.coalesce("text", F.lit("")), F.col("__words"), F.size("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = with_grams(docs).withColumn("__lines", lines).withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    out = out.withColumn("n_repeat_words", _let(_followed("__twos", 2), _covered).cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def apply_rules(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``llr`` and ``kept`` of every document.

    A null text has no words, fails the base rules and has llr 0. Equal rows get equal verdicts, a text of
    any length is read whole, an empty table stays empty, input columns of the added names are replaced."""
    docs = without(docs, *ADDED, *PRIVATE)
    table_ = _ratios_column(ratios.of)
    summed = lambda grams: F.aggregate(grams, F.lit(0.0), lambda total, h: total + F.get(table_, _bucket(h)))
    total = summed(F.col("__ones")) + summed(F.col("__twos"))
    llr = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1)).otherwise(F.lit(0.0))
    out = base_rules(docs).withColumn("llr", llr)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(ratios.threshold)))
    return out.select(*[quoted(c) for c in docs.columns], *ADDED)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return apply_rules(docs, fit_ratios(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
