"""Resolution: evidence, hypotheses, their evaluation, tensions and the choice by source type."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import claim_key, claim_label

#: Order in which claims arrive: pass, rank of the chunk, place of the detector.
ARRIVAL = ("pass", "rank", "pos")


def _arrived(claims: DataFrame) -> DataFrame:
    return claims if "pass" in claims.columns else claims.withColumn("pass", F.lit(1))


def evidence(claims: DataFrame) -> DataFrame:
    """K: one claim per question, chunk and source type; the last to arrive wins."""
    last = Window.partitionBy("question_id", "chunk_id", "source_type").orderBy(*[F.desc(c) for c in ARRIVAL])
    out = _arrived(claims).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return out.withColumn("key", claim_key(F.col("chunk_id"), F.col("source_type")))


def hypotheses(claims: DataFrame) -> DataFrame:
    """H: one per question, value and source type; the first to arrive wins, and its key is the only support.
    ``h_ord`` counts a question's hypotheses from 1; all are active."""
    label = claim_label(F.col("value"), F.col("source_type"))
    first = Window.partitionBy("question_id", "label").orderBy(*ARRIVAL)
    out = _arrived(claims).withColumn("label", label).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    out = out.withColumn("support", F.array(claim_key(F.col("chunk_id"), F.col("source_type"))))
    order = Window.partitionBy("question_id").orderBy(*ARRIVAL)
    return out.withColumns({"h_ord": F.row_number().over(order), "active": F.lit(True)})


def drop_seed(hypotheses_: DataFrame) -> DataFrame:
    """Without the hypothesis that a state is seeded with."""
    return hypotheses_.where("source_type <> 'unknown'")


def verdict(n_active: Column, n_values: Column) -> Column:
    """E of the active hypotheses and their distinct values."""
    return F.when(n_active == 0, "unsupported").when(n_values > 1, "conflicting").otherwise("supported")


def tensions(n_evidence: Column, state: Column, n_active: Column) -> Column:
    """T: tension -> level."""
    gap = F.when(n_evidence == 0, F.struct(F.lit("evidence_gap").alias("k"), F.lit("HIGH").alias("v")))
    level = F.when(state == "conflicting", "HIGH").when(n_active > 1, "MEDIUM")
    doubt = F.when(level.isNotNull(), F.struct(F.lit("unresolved_ambiguity").alias("k"), level.alias("v")))
    return F.map_from_entries(F.array_compact(F.array(gap, doubt)))


def evaluate(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """A row per question, also without claims: n_evidence, n_hypotheses, n_active, n_values, state, tensions.

    One aggregation of distinct claims; a question may have any number of them."""
    of = lambda *cols: F.count_distinct(F.struct(*cols))
    counts = claims.groupBy("question_id").agg(
        of("chunk_id", "source_type").alias("n_evidence"), of("value", "source_type").alias("n_hypotheses"), F.count_distinct("value").alias("n_values"),
    )
    out = questions.join(counts, "question_id", "left").fillna(0, ["n_evidence", "n_hypotheses", "n_values"])
    out = out.withColumn("n_active", F.col("n_hypotheses"))  # all are, before one is chosen
    out = out.withColumn("state", verdict(F.col("n_active"), F.col("n_values")))
    return out.withColumn("tensions", tensions(F.col("n_evidence"), F.col("state"), F.col("n_active")))


# ---- the same over claims that are few, gathered in one array in order of arrival


def distinct_claims(claims: Column, *fields: str) -> Column:
    """How many claims of an array differ in some fields."""
    return F.coalesce(F.size(F.array_distinct(F.transform(claims, lambda x: F.struct(*[x[f].alias(f) for f in fields])))), F.lit(0)).cast("long")


def judged(gathered: DataFrame) -> DataFrame:
    """``gathered`` (claims, ...) with the counts of ``evaluate``, ``state`` and ``tensions``, without a shuffle."""
    c = F.col("claims")
    out = gathered.withColumns({
        "n_evidence": distinct_claims(c, "chunk_id", "source_type"), "n_hypotheses": distinct_claims(c, "value", "source_type"), "n_values": distinct_claims(c, "value"),
    })
    out = out.withColumn("n_active", F.col("n_hypotheses")).withColumn("state", verdict(F.col("n_active"), F.col("n_values")))
    return out.withColumn("tensions", tensions(F.col("n_evidence"), F.col("state"), F.col("n_active")))


def priorities(registry: Mapping[str, Iterable[str]], intent: Column) -> Column:
    """A map of source type to priority, from 1, of an intent; null for one that the registry lacks."""
    of = [x for name, types in registry.items() for x in (F.lit(name), F.create_map(*[y for k, t in enumerate(types, 1) for y in (F.lit(t), F.lit(k))]))]
    return F.try_element_at(F.create_map(*of), intent) if of else F.lit(None).cast("map<string,int>")


def chosen(gathered: DataFrame, priority: Column) -> DataFrame:
    """``gathered`` (claims, ...) with ``best``: value, source type, scope (if claims have one), rule and ``at``, the place in
    ``claims``, of the winner by priority (a map of source type to priority), as ``narrow`` has it; null without one."""
    of = lambda x: F.try_element_at(F.col("__priority"), x["source_type"])
    ranks = F.transform("claims", lambda x, k: F.when(of(x).isNotNull(), F.struct(of(x).alias("priority"), k.alias("at"))))
    out = gathered.withColumn("__priority", priority).withColumn("__best", F.array_min(F.array_compact(ranks)))
    fields = [f for f in gathered.schema["claims"].dataType.elementType.names if f in ("value", "source_type", "scope_operator")]
    claim = F.get("claims", F.col("__best.at"))
    best = F.struct(*[claim[f].alias(f) for f in fields], F.concat(F.lit("rule_"), F.col("__best.priority").cast("string")).alias("rule"), F.col("__best.at").alias("at"))
    return out.withColumn("best", F.when(F.col("__best").isNotNull(), best)).drop("__priority", "__best")


# ---- the choice, over hypotheses as rows


def narrow(hypotheses_: DataFrame, preferences: DataFrame) -> DataFrame:
    """The winner of each question: of the first source type, by the intent's priority, that has an active
    hypothesis, the one that came first. Types outside the registry never win; a question whose intent has no
    priorities has no row. ``rule`` names the priority that fired."""
    ranked = hypotheses_.where("active").join(preferences, ["intent", "source_type"])
    first = Window.partitionBy("question_id").orderBy("priority", "h_ord")
    out = ranked.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return out.withColumn("rule", F.concat(F.lit("rule_"), F.col("priority").cast("string")))


def deactivate_losers(hypotheses_: DataFrame, winners: DataFrame) -> DataFrame:
    """All hypotheses, only the winner of a question with a winner being active."""
    won = winners.select("question_id", F.col("h_ord").alias("__won"))
    out = hypotheses_.join(won, "question_id", "left")
    return out.withColumn("active", F.when(F.col("__won").isNull(), F.col("active")).otherwise(F.col("h_ord") == F.col("__won"))).drop("__won")


def first_active(hypotheses_: DataFrame) -> DataFrame:
    """The earliest active hypothesis of each question; priorities are not asked."""
    cols = [c for c in hypotheses_.columns if c != "question_id"]
    return hypotheses_.where("active").groupBy("question_id").agg(F.min_by(F.struct(*cols), "h_ord").alias("h")).select("question_id", "h.*")


def kinds_of_evidence(claims: DataFrame) -> DataFrame:
    """(question_id, source_types, values): the distinct ones of a question's evidence, sorted."""
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return evidence(claims).groupBy("question_id").agg(distinct("source_type").alias("source_types"), distinct("value").alias("values"))
