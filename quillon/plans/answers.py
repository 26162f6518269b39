"""Answers to questions: retrieve, extract, evaluate, narrow, answer - for all questions in one plan.

A question's claims are those of its top chunks, a few by definition: they are gathered in one array in order of
arrival, and evidence, hypotheses and winners are expressions over it. So a plan reads and ranks chunks once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.detectors import Detector
from quillon.functions.text import claim_key, claim_label
from quillon.operators import resolve
from quillon.operators.extract import extract
from quillon.operators.retrieve import refined, retrieve

#: Source types of an intent in order of priority, or a table (intent, source_type, priority).
Registry = Mapping[str, Iterable[str]] | DataFrame
_KEPT = ("question_id", "intent", "chunk_id", "rank", "pos", "value", "source_type", "scope_operator", "evidence", "items")
ANSWER = ("question_id", "n_evidence", "n_hypotheses", "found", "state", "tensions", "rule", "answer", "source_type", "scope_operator", "active_after", "goal")


def claims_of(chunks: DataFrame, questions: DataFrame, detectors: str | Sequence[Detector], pass_: int = 1) -> DataFrame:
    return extract(retrieve(chunks, questions), detectors).select(*_KEPT, F.lit(pass_).alias("pass"))


#: Fixed value: the label of the hypothesis that a state is seeded with.
SEED_LABEL = "single count exists in canonical form"
_CLAIM = ("pass", "rank", "pos", "value", "source_type", "scope_operator", "chunk_id", "evidence", "items")


def _gathered(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """``questions`` with ``claims`` (in order of arrival), their counts, ``state`` and ``tensions``."""
    per = claims.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(*_CLAIM))).alias("claims"))
    return resolve.judged(questions.join(per, "question_id", "left"))


def _winner(claim: Column, rule: Column) -> Column:
    return F.struct(*[claim[f].alias(f) for f in ("value", "source_type", "scope_operator")], rule.cast("string").alias("rule"))


def seeded(questions: DataFrame) -> DataFrame:
    """The state that a question starts in: one hypothesis without a value, an open goal and a gap."""
    seed = F.struct(F.lit(SEED_LABEL).alias("label"), F.lit("unknown").alias("source_type"), F.lit(None).cast("int").alias("value"), F.lit(True).alias("active"))
    return questions.withColumns({"state": F.lit("unknown"), "hypotheses": F.array(seed), "tensions": F.create_map(F.lit("evidence_gap"), F.lit("HIGH")), "goal": F.lit("open")})


def _with_priorities(questions: DataFrame, registry: Registry) -> DataFrame:
    """``questions`` with ``priorities``, a map of source type to priority: looked up in the registry, or joined by intent
    if that is a table."""
    if not isinstance(registry, DataFrame):
        return questions.withColumn("priorities", resolve.priorities(registry, F.col("intent")))
    of = registry.groupBy("intent").agg(F.map_from_entries(F.collect_list(F.struct("source_type", "priority"))).alias("priorities"))
    return questions.join(of, "intent", "left")


def _answered(chunks: DataFrame, questions: DataFrame, registry: Registry, detectors: str | Sequence[Detector]) -> DataFrame:
    """``questions`` with their claims and all that follows from them, ``priorities`` and the winner."""
    out = _gathered(_with_priorities(questions, registry), claims_of(chunks, questions, detectors)).withColumnRenamed("state", "found")
    out = resolve.chosen(out, F.col("priorities"))
    best = F.col("best")
    ruled = F.when(best.isNotNull(), F.struct(best["value"].alias("value"), best["source_type"].alias("source_type"), best["scope_operator"].alias("scope_operator"), best["rule"].alias("rule")))
    earliest = _winner(F.get("claims", F.lit(0)), F.lit(None))
    out = out.withColumn("winner", F.when(F.col("found") == "conflicting", ruled).when(F.col("found") == "supported", earliest))
    settled = (F.col("found") == "conflicting") & F.col("winner").isNotNull()
    out = out.withColumn("active_after", F.when(settled, F.lit(1).cast("long")).otherwise(F.col("n_active")))
    out = out.withColumn("state", F.when(settled, F.lit("supported")).otherwise(F.col("found")))
    out = out.withColumn("tensions", resolve.tensions(F.col("n_evidence"), F.col("state"), F.col("active_after")))
    return out.withColumn("goal", F.when(F.col("winner").isNotNull(), "solved").otherwise("open"))


def _answer() -> list[Column]:
    return [
        *[F.col(c) for c in ("question_id", "n_evidence", "n_hypotheses", "found", "state", "tensions", "winner.rule")],
        F.col("winner.value").alias("answer"), F.col("winner.source_type"), F.col("winner.scope_operator"), F.col("active_after"), F.col("goal"),
    ]


def answer_primary(chunks: DataFrame, questions: DataFrame, registry: Registry, detectors: str | Sequence[Detector] = "base") -> DataFrame:
    """A row per question. ``found`` is the state after extraction, ``state`` and ``tensions`` those at the end.

    Values that differ go to the priorities; without one that applies the goal stays open. Values that agree
    are answered by the earliest hypothesis, whatever its type. No evidence leaves the goal open. The registry of
    priorities is a mapping of intent to source types, or a table (intent, source_type, priority)."""
    return _answered(chunks, questions, registry, detectors).select(*_answer())


def answer_alternative(chunks: DataFrame, questions: DataFrame, detectors: str | Sequence[Detector] = "base") -> DataFrame:
    """A row per question, without priorities: a second retrieval by the second query adds to the evidence of
    the first. Values that differ stall; values that agree are answered, and the goal stays open all the same."""
    claims = claims_of(chunks, questions, detectors, 1).unionByName(claims_of(chunks, refined(questions), detectors, 2))
    out = _gathered(questions, claims)
    out = out.withColumn("winner", F.when((F.col("state") != "conflicting") & F.col("claims").isNotNull(), _winner(F.get("claims", F.lit(0)), F.lit(None))))
    return out.select(
        "question_id", "n_evidence", "n_hypotheses", "state", "tensions", (F.col("state") == "conflicting").alias("stalled"),
        F.col("winner.value").alias("answer"), "winner.source_type", "winner.scope_operator", F.lit("open").alias("goal"),
    )


def trace(answers: DataFrame) -> DataFrame:
    """The steps of each answer as lines, for a dump."""
    lines = F.array_compact(F.array(
        F.format_string("step1: %d claims, %d hypotheses", "n_evidence", "n_hypotheses"),
        F.concat(F.lit("step2: "), F.col("found")),
        F.when(F.col("rule").isNotNull(), F.concat(F.lit("step3: "), F.col("rule"), F.lit(" fired="), F.col("source_type"))),
        F.when(F.col("goal") == "solved", F.concat(F.lit("step4: answer = "), F.col("answer").cast("string"), F.coalesce(F.concat(F.lit(", "), F.col("scope_operator")), F.lit("")))).otherwise(F.lit("halted")),
    ))
    return answers.withColumn("trace", lines)


def dump(answers: DataFrame) -> DataFrame:
    """(question_id, dump): each answer with its trace as one JSON text, for a sink."""
    traced = trace(answers)
    return traced.select("question_id", F.to_json(F.struct(*traced.columns)).alias("dump"))


def states(chunks: DataFrame, questions: DataFrame, registry: Registry, detectors: str | Sequence[Detector] = "base") -> DataFrame:
    """The whole state of each question in one row: K (map of key to claim), H (array, in order of arrival), E, T,
    P (the intent's priorities), the goal and the trace. A question's evidence is what its top chunks hold; K, H and
    the answer are read off the same array of claims."""
    out = _answered(chunks, questions, registry, detectors)
    c = F.coalesce("claims", F.array().cast(out.schema["claims"].dataType))
    key = lambda x: claim_key(x["chunk_id"], x["source_type"])
    label = lambda x: claim_label(x["value"], x["source_type"])
    out = out.withColumn("claims", c).withColumns({"keys": F.transform("claims", key), "labels": F.transform("claims", label)})
    fields = ("value", "source_type", "scope_operator", "evidence", "items", "chunk_id")
    # of claims with one key the last counts, of those with one label the first
    each = F.transform("claims", lambda x, k: F.struct(k.alias("at"), F.get("keys", k).alias("key"), F.struct(*[x[f].alias(f) for f in fields]).alias("claim")))
    last = F.filter(each, lambda x: ~F.array_contains(F.slice("keys", x["at"] + 2, F.size("keys")), x["key"]))
    first = F.filter(F.transform("claims", lambda x, k: F.struct(k.alias("at"), x.alias("claim"))), lambda x: F.array_position("labels", F.get("labels", x["at"])) == x["at"] + 1)
    conflict = (F.col("found") == "conflicting") & F.col("best").isNotNull()
    hypothesis = lambda x: F.struct(
        F.get("labels", x["at"]).alias("label"), x["claim"]["source_type"].alias("source_type"), x["claim"]["value"].alias("value"), x["claim"]["scope_operator"].alias("scope_operator"),
        F.array(F.get("keys", x["at"])).alias("support"), (~conflict | (F.get("labels", x["at"]) == F.get("labels", F.col("best.at")))).alias("active"),
    )
    some = F.size("claims") > 0
    k = F.when(some, F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["claim"]))))
    by_priority = F.transform(F.array_sort(F.transform(F.map_entries("priorities"), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("s")))), lambda x: x["s"])
    out = out.withColumns({"K": k, "H": F.when(some, F.transform(first, hypothesis)), "P": by_priority})
    traced = trace(out.select("intent", "K", "H", "P", *_answer()))
    return traced.select("question_id", "intent", "K", "H", F.col("state").alias("E"), F.col("tensions").alias("T"), "P", "goal", "trace")
