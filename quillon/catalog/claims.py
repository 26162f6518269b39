"""Queries of the detectors of typed claims: chunks are written from the columns of ``part``, so that what they claim
is known without reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.detectors import SETS
from quillon.functions.plugin import extract_by, extractor
from quillon.functions.text import NUMERALS
from quillon.operators import resolve
from quillon.operators.extract import extract
from quillon.plans.answers import answer_primary, claims_of, dump, states, trace
from quillon.sources.tables import PREFERENCES, preferences, spread, table

#: Words and digits of counts by part size modulo their number; the last two are no numbers.
COUNTS = (*NUMERALS, "12", "007", "SEVEN", "eleven", "many")
VALUES = (*range(11), 12, 7, 7, None, None)
#: The phrase of a scope, and what the sentence says after it.
SCOPES = ((None, None), ("In addition  to", "the usual __init__"), ("excluding", " __new__"), ("not counting", "what a base has"), ("besides", "x"))
NAMES = ("__init__", "__len__", "__getitem__", "__eq__", "__hash__")
THINGS = ("cards", "element", "Items", "parts")
GROUPS = ("a deck of", "a list made of", "the set of", "a box of")
KINDS = 6
#: Parts whose chunks a task writes and reads, about. A file holds a part in 6 bytes; its chunks take 1,500 and half a millisecond.
PARTS_A_TASK = 2_500
#: Queries and numbers of chunks by a brand's number modulo three.
ASKED = (("special methods, len of a deck", 12), ("text implemented special", 12), ("special methods, len of a deck", 2))


def _pick(of: tuple, k: Column) -> Column:
    return F.get(F.lit(list(of)) if None not in of else F.array(*[F.lit(x) for x in of]), k.cast("int"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each part and each of six kinds of text; the parts of a brand are a corpus."""
    k, n = F.col("p_partkey"), F.col("p_size")
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", PARTS_A_TASK)
    parts = parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(KINDS - 1))).alias("of"))
    count, scope = _pick(COUNTS, n % len(COUNTS)), k % len(SCOPES)
    tail = F.when(scope == 0, F.lit("")).otherwise(F.concat(F.lit("  "), _pick(tuple(a or "" for a, _ in SCOPES), scope), F.lit(" "), _pick(tuple(b or "" for _, b in SCOPES), scope)))
    stated = F.concat(F.lit("Some text. We  implemented "), count, F.lit(" special\nmethods"), tail, F.when(k % 3 == 0, "\nand more.").when(k % 3 == 1, ". More").otherwise(""))
    listed = F.concat(F.lit("Below, The special methods "), F.array_join(F.slice(F.lit(list(NAMES)), F.lit(1), (n % len(NAMES)).cast("int")), " , "), F.when(k % 2 == 0, ", and __call__ follow.").otherwise(" follow."))
    defined = F.concat(F.lit("class Deck:\n"), F.repeat(F.lit("    def __len__ (self): pass\n    def plain(self): pass\n"), (n % 4).cast("int")))
    printed = F.concat(F.lit(">>> d = Deck()\n>>> len("), F.when(k % 2 == 0, "d").otherwise("d.x"), F.lit(")"), F.when(k % 5 == 0, " ").otherwise("  \n  "), n.cast("string"), F.when(k % 7 == 0, "x").otherwise("\n"))
    counted = F.concat(F.lit("It starts as "), _pick(GROUPS, k % len(GROUPS)), F.lit(" "), count, F.lit(" "), _pick(THINGS, n % len(THINGS)))
    plain = F.concat(F.lit("A row "), n.cast("string"))
    text = F.when(F.col("of") == 0, stated).when(F.col("of") == 1, listed).when(F.col("of") == 2, defined).when(F.col("of") == 3, printed).when(F.col("of") == 4, counted).otherwise(plain)
    ord_ = k * KINDS + F.col("of")
    return parts.select(F.col("p_brand").alias("corpus_id"), ord_.alias("ord"), ord_.cast("string").alias("chunk_id"), F.lit("parts").alias("doc"), F.when((F.col("of") == 2) & (k % 4 > 0), "code").otherwise("prose").alias("kind"), text.alias("text"))


def _claims(detectors: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _listed_claims(extract(_chunks(spark, sf_dir), detectors))

    return query


def _listed_claims(claims: DataFrame) -> DataFrame:
    plain = [F.col(c).cast("long").alias(c) for c in ("pos", "value")]
    return claims.select(F.col("ord").alias("chunk"), *plain, "source_type", "scope_operator", "evidence", F.array_join("items", ",").alias("items"))


def _asked_length(text: str, kind: str) -> list[dict]:
    """A user's extractor: the number that a prompt for a length is answered with on the next line."""
    for prompt in text.split(">>>")[1:]:
        call, closing, rest = prompt.partition(")")
        lines = rest.split("\n", 1)
        said = lines[1].strip() if len(lines) == 2 and not lines[0].strip() else ""
        if call.lstrip().startswith("len(") and closing and said.isascii() and said.isdigit():
            before = rest[: len(rest) - len(rest.lstrip())]
            return [{"value": int(said), "source_type": "code_literal", "evidence": f">>>{call}){before}{said}"}]
    return []


def claims_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of the base set, and beside them those of an extractor in Python."""
    chunks = _chunks(spark, sf_dir)
    native = extract(chunks, "base")
    own = extract_by(chunks, extractor(_asked_length), len(SETS["base"]))
    return _listed_claims(native.unionByName(own.select(*native.columns)))


def _questions(spark: SparkSession, sf_dir: str, intent: str = "how_many") -> DataFrame:
    """One for each brand, off the table: chunks are written and dealt for ranking only."""
    ids, kind = table(spark, sf_dir, "part").select(F.col("p_brand").alias("corpus_id")).distinct(), F.replace("corpus_id", F.lit("Brand#"), F.lit("")).cast("int") % len(ASKED)
    return ids.select(F.col("corpus_id").alias("question_id"), "corpus_id", _pick(tuple(q for q, _ in ASKED), kind).alias("query"), F.lit(None).cast("string").alias("query2"), F.lit(intent).alias("intent"), _pick(tuple(k for _, k in ASKED), kind).alias("top_k"))


def _answered(spark: SparkSession, sf_dir: str, intent: str = "how_many") -> DataFrame:
    return answer_primary(_chunks(spark, sf_dir), _questions(spark, sf_dir, intent), PREFERENCES, "extended")


def answer_from_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("question_id", "n_evidence", "n_hypotheses", "found", "state", "rule", F.col("answer").cast("long").alias("answer"), "source_type", "goal")


def no_priority_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions with an intent that has no priorities: values that differ leave the goal open."""
    return _answered(spark, sf_dir, "why").select("question_id", "found", "state", F.col("answer").cast("long").alias("answer"), F.element_at("tensions", "unresolved_ambiguity").alias("doubt"), "active_after", "goal")


def within_type_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one source type whose values differ: the first wins by its type's priority, right or not."""
    of_type = claims_of(_chunks(spark, sf_dir), _questions(spark, sf_dir), "extended").where("source_type = 'author_anchor'")
    h = resolve.hypotheses(of_type)
    won = resolve.narrow(h, preferences(spark)).select("question_id", "rule", F.col("value").cast("long").alias("value"))
    return won.join(h.groupBy("question_id").agg(F.count_distinct("value").alias("n_values")), "question_id")


def answer_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(_answered(spark, sf_dir)).select("question_id", F.array_join("trace", "\n").alias("trace"))


def state_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sink gets, read back."""
    d = dump(_answered(spark, sf_dir))
    field = lambda path: F.get_json_object("dump", path)
    return d.select("question_id", field("$.goal").alias("goal"), field("$.answer").cast("long").alias("answer"), field("$.n_evidence").cast("long").alias("n_evidence"), field("$.trace[1]").alias("step"))


def whole_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = states(_chunks(spark, sf_dir), _questions(spark, sf_dir), PREFERENCES, "extended")
    return s.select("question_id", F.coalesce(F.size("K"), F.lit(0)).cast("long").alias("n_evidence"), F.array_join(F.sort_array(F.map_keys("K")), ",").alias("keys"), F.array_join(F.transform("H", lambda h: F.concat_ws(":", h["label"], h["active"].cast("string"))), ",").alias("hypotheses"), F.col("E").alias("state"), F.array_join("P", ",").alias("priorities"), "goal")


QUERIES = {f"claims_{name}": _claims(name) for name in ("base", "extended", "no_author_phrase")}
QUERIES |= {f.__name__: f for f in (claims_plugin, answer_from_claims, no_priority_halt, within_type_boundary, answer_trace, state_dump, whole_state)}


def _list(of: tuple) -> str:
    return "[" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in of) + "]"


# What each chunk claims, from the columns it was written from.
_P = f"""p AS (SELECT p_brand AS b, CAST(replace(p_brand, 'Brand#', '') AS INT) % 3 AS v, p_partkey AS k, p_size AS n, ({_list(COUNTS)})[p_size % {len(COUNTS)} + 1] AS word, ({_list(VALUES)})[p_size % {len(VALUES)} + 1] AS number,
  p_partkey % {len(SCOPES)} AS scope, ({_list(tuple(a for a, _ in SCOPES))})[p_partkey % {len(SCOPES)} + 1] AS operator, ({_list(tuple(b for _, b in SCOPES))})[p_partkey % {len(SCOPES)} + 1] AS after,
  p_size % {len(NAMES)} AS listed, ({_list(NAMES)})[:p_size % {len(NAMES)}] AS names FROM part)"""
_STATED = """SELECT b, k * 6 AS chunk, 'stated' AS d, number AS value, 'author_anchor' AS source_type, lower(operator) || ' ' || trim(after) AS scope_operator,
  'We  implemented ' || word || ' special' || chr(10) || 'methods' || coalesce('  ' || operator || ' ' || after, '') || CASE WHEN k % 3 = 1 THEN '.' ELSE '' END AS evidence, NULL AS items
  FROM p WHERE number IS NOT NULL AND k % 3 < 2"""
_LISTED = """SELECT b, k * 6 + 1, 'listed', len(x), 'forward_reference', NULL, 'The special methods ' || array_to_string(names, ' , ') || CASE WHEN k % 2 = 0 THEN ', and __call__' ELSE '' END, array_to_string(x, ',')
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN list_append(names, '__call__') ELSE names END AS x FROM p) WHERE listed > 0 AND len(x) > 1"""
_DEFINED = "SELECT b, k * 6 + 2, 'defined', n % 4, 'code_literal', NULL, n % 4 || ' dunder def(s) in code body', array_to_string(list_resize(['__len__'], n % 4, '__len__'), ',') FROM p WHERE k % 4 > 0 AND n % 4 > 0"
_PRINTED = "SELECT b, k * 6 + 3, 'printed', n, 'code_literal', NULL, '>>> len(' || CASE WHEN k % 2 = 0 THEN 'd' ELSE 'd.x' END || ')  ' || chr(10) || '  ' || n, NULL FROM p WHERE k % 5 > 0 AND k % 7 > 0"
_COUNTED = f"""SELECT b, k * 6 + 4, 'counted', number, 'author_anchor', NULL, regexp_replace(({_list(GROUPS)})[k % 4 + 1], '^(a|the) ', '') || ' ' || word || ' ' || ({_list(THINGS)})[n % 4 + 1], NULL
  FROM p WHERE number IS NOT NULL AND k % 4 < 3 AND n % 4 < 3"""
_ORDER = {"base": ("stated", "listed", "defined"), "extended": ("stated", "counted", "listed", "defined", "printed"), "no_author_phrase": ("stated", "listed", "defined", "printed")}


def _c(name: str) -> str:
    at = " ".join(f"WHEN '{d}' THEN {k}" for k, d in enumerate(_ORDER[name]))
    found = ", ".join(f"'{d}'" for d in _ORDER[name])
    return f"{_P}, c AS (SELECT *, CAST(CASE d {at} END AS BIGINT) AS pos FROM ({' UNION ALL '.join((_STATED, _LISTED, _DEFINED, _PRINTED, _COUNTED))}) WHERE d IN ({found}))"


# The words of the query that a chunk holds, by what it was written from: special, "methods," (never), len, deck.
_TOP = f"""t AS (SELECT * FROM (SELECT b, chunk, row_number() OVER (PARTITION BY b ORDER BY score DESC, chunk) AS rank FROM (
    SELECT b, k * 6 AS chunk, CASE v WHEN 1 THEN 3 ELSE 1 END AS score FROM p UNION ALL SELECT b, k * 6 + 1, 1 + CAST(v <> 1 AND listed > 1 AS INT) FROM p UNION ALL SELECT b, k * 6 + 2, 1 + CAST(n % 4 > 0 AS INT) FROM p WHERE v <> 1
    UNION ALL SELECT b, k * 6 + 3, 2 FROM p WHERE v <> 1 UNION ALL SELECT b, k * 6 + 4, 1 FROM p WHERE k % 4 = 0 AND v <> 1)) WHERE rank <= CASE CAST(replace(b, 'Brand#', '') AS INT) % 3 WHEN 2 THEN 2 ELSE 12 END),
  q AS (SELECT DISTINCT p_brand AS question_id FROM part),
  a AS (SELECT c.*, t.rank FROM c JOIN t ON t.b = c.b AND t.chunk = c.chunk),
  k AS (SELECT b, count(DISTINCT (chunk, source_type)) AS n_evidence FROM a GROUP BY b),
  h AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY rank, pos) AS h_ord FROM (SELECT *, row_number() OVER (PARTITION BY b, value, source_type ORDER BY rank, pos) AS first FROM a) WHERE first = 1),
  s AS (SELECT question_id, coalesce(n_evidence, 0) AS n_evidence, (SELECT count(*) FROM h WHERE b = question_id) AS n_hypotheses, (SELECT count(DISTINCT value) FROM h WHERE b = question_id) AS n_values FROM q LEFT JOIN k ON b = question_id),
  w AS (SELECT * FROM (SELECT *, CASE source_type WHEN 'author_anchor' THEN 1 WHEN 'forward_reference' THEN 2 ELSE 3 END AS priority, row_number() OVER (PARTITION BY b ORDER BY CASE source_type WHEN 'author_anchor' THEN 1 WHEN 'forward_reference' THEN 2 ELSE 3 END, h_ord) AS m FROM h) WHERE m = 1),
  r AS (SELECT s.*, CASE WHEN n_hypotheses = 0 THEN 'unsupported' WHEN n_values > 1 THEN 'conflicting' ELSE 'supported' END AS found, CASE WHEN n_values > 1 THEN 'rule_' || w.priority END AS rule,
    CASE WHEN n_values > 1 THEN w.value ELSE f.value END AS answer, CASE WHEN n_values > 1 THEN w.source_type ELSE f.source_type END AS source_type, CASE WHEN n_values > 1 THEN w.scope_operator ELSE f.scope_operator END AS scope_operator,
    CASE WHEN n_hypotheses > 0 THEN 'solved' ELSE 'open' END AS goal, w.h_ord AS won FROM s LEFT JOIN w ON w.b = question_id LEFT JOIN h f ON f.b = question_id AND f.h_ord = 1)"""
_R = f"WITH {_c('extended')}, {_TOP}"
ORACLES = {f"claims_{name}": f"WITH {_c(name)} SELECT CAST(chunk AS BIGINT) AS chunk, pos, CAST(value AS BIGINT) AS value, source_type, scope_operator, evidence, items FROM c" for name in _ORDER}
ORACLES |= {
    "answer_from_claims": f"{_R} SELECT question_id, n_evidence, n_hypotheses, found, CASE WHEN n_hypotheses = 0 THEN found ELSE 'supported' END AS state, rule, CAST(answer AS BIGINT) AS answer, source_type, goal FROM r",
    "no_priority_halt": f"{_R} SELECT question_id, found, found AS state, CASE WHEN n_values = 1 THEN CAST(answer AS BIGINT) END AS answer, CASE WHEN n_values > 1 THEN 'HIGH' WHEN n_hypotheses > 1 THEN 'MEDIUM' END AS doubt, n_hypotheses AS active_after, CASE WHEN n_values = 1 THEN 'solved' ELSE 'open' END AS goal FROM r",
    "within_type_boundary": f"{_R} SELECT b AS question_id, 'rule_1' AS rule, CAST(min_by(value, h_ord) AS BIGINT) AS value, count(DISTINCT value) AS n_values FROM h WHERE source_type = 'author_anchor' GROUP BY b",
    "answer_trace": f"""{_R} SELECT question_id, concat_ws(chr(10), 'step1: ' || n_evidence || ' claims, ' || n_hypotheses || ' hypotheses', 'step2: ' || found, 'step3: ' || rule || ' fired=' || source_type,
      CASE WHEN goal = 'solved' THEN 'step4: answer = ' || answer || coalesce(', ' || scope_operator, '') ELSE 'halted' END) AS trace FROM r""",
    "state_dump": f"{_R} SELECT question_id, goal, CAST(answer AS BIGINT) AS answer, n_evidence, 'step2: ' || found AS step FROM r",
    "whole_state": f"""{_R} SELECT question_id, n_evidence, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT chunk || ':' || source_type AS x FROM a WHERE b = question_id)) AS keys,
      (SELECT string_agg('count=' || value || '/' || source_type || ':' || CASE WHEN n_values > 1 AND h_ord <> won THEN 'false' ELSE 'true' END, ',' ORDER BY h_ord) FROM h WHERE b = question_id) AS hypotheses,
      CASE WHEN n_hypotheses = 0 THEN found ELSE 'supported' END AS state, 'author_anchor,forward_reference,code_literal' AS priorities, goal FROM r""",
}
#: The extractor reads what the last detector of this set reads.
ORACLES["claims_plugin"] = ORACLES["claims_no_author_phrase"]
