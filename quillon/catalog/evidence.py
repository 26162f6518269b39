"""Evidence queries: the sources of ``documents`` as corpora, one question each about licence versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.detectors import SETS, number_after
from quillon.functions.text import overlap, query_words
from quillon.operators import index, resolve
from quillon.operators.extract import extract
from quillon.operators.retrieve import retrieve
from quillon.plans.answers import answer_alternative, answer_primary
from quillon.sources.tables import PREFERENCES, document_corpora, preferences, table

QUERY = "Licensed under the GNU General Public License Apache License Version CC BY-NC"
QUERY2 = "Released under the MIT License"
K = 4
#: With a second detector of one source type, so that evidence is overwritten.
DETECTORS = SETS["license_versions"]
DOUBLED = (*DETECTORS, number_after("apache_minor", "author_anchor", r"Apache License, Version [0-9]+\.([0-9]+)"))
EVERYTHING = "all documents"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_corpora(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _questions(chunks: DataFrame) -> DataFrame:
    """One question per corpus."""
    ids = chunks.select("corpus_id").distinct()
    return ids.select(F.concat(F.lit("q_"), "corpus_id").alias("question_id"), "corpus_id", F.lit(QUERY).alias("query"), F.lit(QUERY2).alias("query2"), F.lit("how_many").alias("intent"), F.lit(K).alias("top_k"))


def _all_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of every chunk, arriving in corpus order."""
    chunks = _chunks(spark, sf_dir)
    asked = chunks.withColumns({"question_id": F.concat(F.lit("q_"), "corpus_id"), "intent": F.lit("how_many"), "rank": F.col("ord")})
    return extract(asked, DOUBLED)


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", overlap(query_words(F.lit(QUERY)), F.lower(F.coalesce("text", F.lit("")))).cast("long").alias("score"))


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return retrieve(chunks, _questions(chunks)).select("question_id", F.col("ord").alias("doc_id"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def retrieve_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every conversation as a question about all documents, through the index."""
    chunks = _chunks(spark, sf_dir).withColumn("corpus_id", F.lit(EVERYTHING))
    opening = F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"]
    asked = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id IS NOT NULL").groupBy("conv_id").agg(opening.alias("query"))
    asked = asked.select("conv_id", F.col("conv_id").cast("string").alias("question_id"), F.lit(EVERYTHING).alias("corpus_id"), "query", F.lit(K).alias("top_k"))
    out = index.ranked(asked, index.build(chunks), K, K)
    return out.select(F.col("question_id").cast("long").alias("conv_id"), F.col("ord").alias("doc_id"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_chunks(spark, sf_dir), DOUBLED).select(F.col("ord").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"), "source_type", "evidence")


def evidence_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.evidence(_all_claims(spark, sf_dir)).select("question_id", "key", "source_type", F.col("value").cast("long").alias("value"))


def evidence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.kinds_of_evidence(_all_claims(spark, sf_dir))
    return out.select("question_id", F.array_join("source_types", ",").alias("source_types"), F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = resolve.hypotheses(_all_claims(spark, sf_dir))
    return h.select("question_id", "label", F.col("value").cast("long").alias("value"), F.array_join("support", ",").alias("support"), F.col("h_ord").cast("long").alias("h_ord"), "active")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.evaluate(_questions(_chunks(spark, sf_dir)), _all_claims(spark, sf_dir))


def evaluate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("question_id", "n_evidence", "n_hypotheses", "n_active", "n_values", "state")


def tensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tensions")
    return _states(spark, sf_dir).select("question_id", t["evidence_gap"].alias("evidence_gap"), t["unresolved_ambiguity"].alias("unresolved_ambiguity"))


def narrow_hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = resolve.narrow(resolve.hypotheses(_all_claims(spark, sf_dir)), preferences(spark))
    return won.select("question_id", "rule", "label", F.col("value").cast("long").alias("value"), "source_type")


def deactivated(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = resolve.hypotheses(_all_claims(spark, sf_dir))
    return resolve.deactivate_losers(h, resolve.narrow(h, preferences(spark))).select("question_id", "label", "active")


def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    out = answer_primary(chunks, _questions(chunks), PREFERENCES, DETECTORS)
    return out.select("question_id", "n_evidence", "n_hypotheses", "found", "state", "rule", F.col("answer").cast("long").alias("answer"), "source_type", "goal")


def alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    out = answer_alternative(chunks, _questions(chunks), DETECTORS)
    return out.select("question_id", "n_evidence", "n_hypotheses", "state", "stalled", F.col("answer").cast("long").alias("answer"), "source_type", "goal")


def _stated(kinds: Sequence[tuple[str, str]], chunk_id: str) -> Column:
    """Claims in order of arrival from columns of one row: (source type, column)."""
    return F.array(*[F.struct(F.col(c).alias("value"), F.lit(source).alias("source_type"), F.lit(chunk_id).alias("chunk_id")) for source, c in kinds])


def single_claim_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn counts of conversations by three ways of counting, which agree: the earliest answers, doubt stays."""
    counts = table(spark, sf_dir, "conversations").where("conv_id is not null").groupBy("conv_id").agg(
        (F.max("turn") + 1).cast("int").alias("last"), F.count_distinct("turn").cast("int").alias("distinct"), F.count("*").cast("int").alias("all"),
    )
    kinds = (("code_literal", "last"), ("forward_reference", "distinct"), ("author_anchor", "all"))
    out = resolve.judged(counts.select(F.col("conv_id").cast("string").alias("question_id"), _stated(kinds, "conversation").alias("claims")))
    supported, first = F.col("state") == "supported", F.get("claims", F.lit(0))
    return out.select(
        "question_id", "state", F.col("tensions")["unresolved_ambiguity"].alias("doubt"),
        F.when(supported, first["value"].cast("long")).alias("answer"), F.when(supported, first["source_type"]).alias("source_type"),
    )


def total_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated order totals against those of the lines, in cents: the stated one has priority where they differ."""
    cents = lambda x: F.floor(x * 100 + 0.5).cast("long")
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    derived = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents(line)).alias("derived"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", cents(F.col("o_totalprice")).alias("stated")).join(derived, "o_orderkey")
    # two claims an order, in one array: a question is an order
    out = out.withColumn("claims", _stated((("author_anchor", "stated"), ("code_literal", "derived")), "order"))
    out = resolve.chosen(resolve.judged(out), resolve.priorities(PREFERENCES, F.lit("how_many")))
    return out.select("o_orderkey", "stated", "derived", "state", F.when(F.col("state") == "conflicting", F.col("best.rule")).alias("rule"), F.col("best.value").alias("answer"))


QUERIES = {f.__name__: f for f in (keyword_score, retrieve_topk, retrieve_indexed, extract_claims, evidence_k, evidence_kinds, hypotheses, evaluate_state, tensions, narrow_hypothesis, deactivated, single_claim_path, total_reconcile)}
QUERIES |= {"answer_primary": primary, "answer_alternative": alternative}

_WORDS = "list_distinct(list_transform(list_filter(string_split_regex('{}', '\\s+'), lambda t: length(t) > 2), lambda t: lower(t)))"
_SCORE = "CAST(len(list_filter({}, lambda t: contains(lower(coalesce(text, '')), t))) AS BIGINT)"


def _score(query: str) -> str:
    return _SCORE.format(_WORDS.format(query))


_D = "d AS (SELECT 'q_' || coalesce(source, '') AS question_id, doc_id, coalesce(text, '') AS text FROM documents)"
_DETECTED = (
    (0, "author_anchor", "Apache License, Version ([0-9]+)"), (1, "forward_reference", "GNU General Public License, version ([0-9]+)"),
    (2, "code_literal", "CC BY-NC ([0-9]+)"), (3, "author_anchor", r"Apache License, Version [0-9]+\.([0-9]+)"),
)


def _claims(over: str, n: int, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT question_id, doc_id, {k} AS pos, '{s}' AS source_type, TRY_CAST(regexp_extract(text, '{p}', 1) AS BIGINT) AS value, regexp_extract(text, '{p}', 0) AS evidence{extra} "
        f"FROM {over} WHERE regexp_extract(text, '{p}', 1) <> ''"
        for k, s, p in _DETECTED[:n]
    )


_C = f"{_D}, c AS ({_claims('d', 4)})"
_K = "k AS (SELECT *, doc_id || ':' || source_type AS key FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, source_type ORDER BY pos DESC) AS n FROM c) WHERE n = 1)"
_H = (
    "h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY doc_id, pos) AS h_ord FROM (SELECT *, 'count=' || value || '/' || source_type AS label, "
    "row_number() OVER (PARTITION BY question_id, value, source_type ORDER BY doc_id, pos) AS n FROM c) WHERE n = 1)"
)
_Q = "q AS (SELECT DISTINCT question_id FROM d)"
_S = (
    "s AS (SELECT q.question_id, (SELECT count(*) FROM k WHERE k.question_id = q.question_id) AS n_evidence, (SELECT count(*) FROM h WHERE h.question_id = q.question_id) AS n_hypotheses, "
    "(SELECT count(DISTINCT value) FROM h WHERE h.question_id = q.question_id) AS n_values FROM q)"
)
_STATE = "CASE WHEN n_hypotheses = 0 THEN 'unsupported' WHEN n_values > 1 THEN 'conflicting' ELSE 'supported' END"
_PRIORITY = "CASE source_type WHEN 'author_anchor' THEN 1 WHEN 'forward_reference' THEN 2 WHEN 'code_literal' THEN 3 END"
_WON = f"w AS (SELECT * FROM (SELECT *, {_PRIORITY} AS priority, row_number() OVER (PARTITION BY question_id ORDER BY {_PRIORITY}, h_ord) AS m FROM h) WHERE m = 1)"


def _top(name: str, query: str, pass_: int) -> str:
    return (
        f"{name} AS (SELECT * FROM (SELECT question_id, doc_id, text, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank, {pass_} AS pass "
        f"FROM (SELECT *, {_score(query)} AS score FROM d) WHERE score > 0) WHERE rank <= {K})"
    )


def _resolved(claims: str) -> str:
    """CTEs k, h, q, s over claims with pass, rank and pos."""
    return (
        f"c AS ({claims}), "
        "k AS (SELECT DISTINCT question_id, doc_id, source_type FROM c), "
        "h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pass, rank, pos) AS h_ord FROM (SELECT *, "
        "row_number() OVER (PARTITION BY question_id, value, source_type ORDER BY pass, rank, pos) AS n FROM c) WHERE n = 1), "
        f"{_Q}, {_S}"
    )


_OPENING = (
    "SELECT conv_id, list_distinct(list_transform(list_filter(string_split_regex(o, '[\\s\\x0b\\x{85}\\p{Z}]+'), lambda t: length(t) > 2), lambda t: lower(t))) AS words FROM "
    "(SELECT conv_id, min(struct_pack(a := turn, b := coalesce(text, ''))).b AS o FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL GROUP BY conv_id)"
)
_FIRST = "f AS (SELECT * FROM h WHERE h_ord = 1)"
ORACLES = {
    "keyword_score": f"SELECT doc_id, {_score(QUERY)} AS score FROM documents",
    "retrieve_topk": f"WITH {_D}, {_top('t', QUERY, 1)} SELECT question_id, doc_id, score, rank FROM t",
    "retrieve_indexed": (
        f"WITH q AS ({_OPENING}), d AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents), "
        "s AS (SELECT conv_id, doc_id, CAST(len(list_filter(words, lambda t: contains(text, t))) AS BIGINT) AS score FROM q CROSS JOIN d) "
        f"SELECT conv_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}"
    ),
    "extract_claims": f"WITH {_C} SELECT doc_id, CAST(pos AS BIGINT) AS pos, value, source_type, evidence FROM c",
    "evidence_k": f"WITH {_C}, {_K} SELECT question_id, key, source_type, value FROM k",
    "evidence_kinds": f"WITH {_C}, {_K} SELECT question_id, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT source_type AS t FROM k WHERE k.question_id = q.question_id)) AS source_types, (SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM (SELECT DISTINCT value AS v FROM k WHERE k.question_id = q.question_id)) AS values FROM (SELECT DISTINCT question_id FROM k) q",
    "hypotheses": f"WITH {_C}, {_H} SELECT question_id, label, value, doc_id || ':' || source_type AS support, h_ord, true AS active FROM h",
    "evaluate_state": f"WITH {_C}, {_K}, {_H}, {_Q}, {_S} SELECT question_id, n_evidence, n_hypotheses, n_hypotheses AS n_active, n_values, {_STATE} AS state FROM s",
    "tensions": f"WITH {_C}, {_K}, {_H}, {_Q}, {_S} SELECT question_id, CASE WHEN n_evidence = 0 THEN 'HIGH' END AS evidence_gap, CASE WHEN n_values > 1 THEN 'HIGH' WHEN n_hypotheses > 1 THEN 'MEDIUM' END AS unresolved_ambiguity FROM s",
    "narrow_hypothesis": f"WITH {_C}, {_H}, {_WON} SELECT question_id, 'rule_' || priority AS rule, label, value, source_type FROM w",
    "deactivated": f"WITH {_C}, {_H}, {_WON} SELECT h.question_id, h.label, h.h_ord = w.h_ord AS active FROM h JOIN w USING (question_id)",
    "answer_primary": (
        f"WITH {_D}, {_top('t', QUERY, 1)}, {_resolved(_claims('t', 3, ', pass, rank'))}, {_FIRST}, {_WON} "
        f"SELECT s.question_id, n_evidence, n_hypotheses, {_STATE} AS found, CASE WHEN n_hypotheses = 0 THEN 'unsupported' ELSE 'supported' END AS state, "
        "CASE WHEN n_values > 1 THEN 'rule_' || w.priority END AS rule, CASE WHEN n_values > 1 THEN w.value ELSE f.value END AS answer, "
        "CASE WHEN n_values > 1 THEN w.source_type ELSE f.source_type END AS source_type, CASE WHEN n_hypotheses = 0 THEN 'open' ELSE 'solved' END AS goal "
        "FROM s LEFT JOIN f USING (question_id) LEFT JOIN w USING (question_id)"
    ),
    "answer_alternative": (
        f"WITH {_D}, {_top('t1', QUERY, 1)}, {_top('t2', QUERY2, 2)}, t AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2), {_resolved(_claims('t', 3, ', pass, rank'))}, {_FIRST} "
        f"SELECT s.question_id, n_evidence, n_hypotheses, {_STATE} AS state, n_values > 1 AS stalled, CASE WHEN n_values <= 1 THEN f.value END AS answer, "
        "CASE WHEN n_values <= 1 THEN f.source_type END AS source_type, 'open' AS goal FROM s LEFT JOIN f USING (question_id)"
    ),
    "single_claim_path": (
        "WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS question_id, max(turn) + 1 AS a, count(DISTINCT turn) AS b, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id) "
        "SELECT question_id, CASE WHEN a = b AND b = n THEN 'supported' ELSE 'conflicting' END AS state, CASE WHEN a = b AND b = n THEN 'MEDIUM' ELSE 'HIGH' END AS doubt, "
        "CASE WHEN a = b AND b = n THEN a END AS answer, CASE WHEN a = b AND b = n THEN 'code_literal' END AS source_type FROM c"
    ),
    "total_reconcile": (
        "WITH l AS (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) AS BIGINT)) AS BIGINT) AS derived FROM lineitem GROUP BY l_orderkey), "
        "o AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS stated FROM orders) "
        "SELECT o_orderkey, stated, derived, CASE WHEN stated = derived THEN 'supported' ELSE 'conflicting' END AS state, CASE WHEN stated <> derived THEN 'rule_1' END AS rule, stated AS answer FROM o JOIN l USING (o_orderkey)"
    ),
}
