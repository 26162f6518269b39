"""Scenarios of questions over small corpora, with the outcomes that the semantics fix."""

import pytest
from pyspark.sql import functions as F

from quillon.catalog import claims
from quillon.functions.text import overlap, query_words, starts_blank, to_int, trimmed
from quillon.operators import resolve
from quillon.operators.extract import extract
from quillon.operators.retrieve import refined, retrieve, score
from quillon.plans.answers import answer_alternative, answer_primary, dump, seeded, states, trace
from quillon.sources.tables import corpus, preferences, questions
from tests.conftest import SF
from tests.oracle import assert_same, connection

DEFS = "class Vector:\n" + "".join(f"    def __{n}__(self):\n        pass\n" for n in ("init", "repr", "abs", "bool", "add", "mul"))
VECTOR = [
    ("shape", "book", "prose", "The Vector type acts like a row of numbers."),
    ("list", "book", "prose", "Below are the special methods __repr__, __abs__, __add__, and __mul__ in use."),
    ("stated", "book", "prose", "Example 1-2 has the Vector type. We implemented five special methods in addition to  the usual __init__."),
    ("code", "book", "code", DEFS),
    ("tail", "book", "prose", "Own types with such methods feel built in."),
]
DECK_CODE = ("d_code", "book", "code", "Example 1-1: a deck of playing cards\nclass FrenchDeck:\n" + "".join(f"    def __{n}__(self):\n        pass\n" for n in ("init", "len", "getitem")))
DECK_TEST = ("d_test", "book", "code", ">>> deck = FrenchDeck()\n>>> len(deck)\n52\nReading single cards is easy.\n")
DECK_TEXT = ("d_text", "book", "prose", "In Example 1-1 a deck starts as a list made of 52 cards of all kinds.")
DECK = [DECK_CODE, DECK_TEST, DECK_TEXT]
Q_VECTOR = ("q", "c", "Example 1-2 Vector special methods count", "implemented special methods Vector count", "how_many", 4)
Q_DECK = ("q", "c", "FrenchDeck cards count Example 1-1", None, "how_many", None)


def primary(spark, chunks, question, detectors="base", registry=None):
    return answer_primary(corpus(spark, "c", chunks), questions(spark, [question]), preferences(spark, registry), detectors).first()


def test_retrieval_is_stable_and_cut_before_zero_scores_go(spark):
    got = retrieve(corpus(spark, "c", VECTOR), questions(spark, [Q_VECTOR])).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("stated", 5), ("list", 2), ("shape", 1), ("code", 1)]
    none = retrieve(corpus(spark, "c", VECTOR), questions(spark, [("q", "c", "zzz yyy", None, "how_many", 4)]))
    assert none.count() == 0


def test_query_words(spark):
    row = spark.range(1).select(query_words(F.lit("The THE of  1-2 A\tÉtude cards,")).alias("w")).first()
    assert row.w == ["the", "1-2", "étude", "cards,"]
    hits = spark.range(1).select(overlap(F.array(F.lit("art"), F.lit("xyz")), F.lit("a cart")).alias("n")).first()
    assert hits.n == 1


@pytest.mark.parametrize(("word", "value"), [("five", 5), ("TEN", 10), ("52", 52), ("eleven", None), ("", None), ("²", None), ("99999999999", None), (None, None)])
def test_to_int(spark, word, value):
    assert spark.createDataFrame([(word,)], "w string").select(to_int(F.col("w")).alias("v")).first().v == value


def test_detectors(spark):
    got = {(r.chunk_id, r.source_type): r for r in extract(corpus(spark, "c", VECTOR + DECK), "extended").collect()}
    assert {k: r.value for k, r in got.items()} == {
        ("stated", "author_anchor"): 5, ("list", "forward_reference"): 4, ("code", "code_literal"): 6, ("d_code", "code_literal"): 3, ("d_test", "code_literal"): 52, ("d_text", "author_anchor"): 52,
    }
    assert got["stated", "author_anchor"].scope_operator == "in addition to the usual __init__"
    assert got["stated", "author_anchor"].evidence.startswith("We implemented five") and got["list", "forward_reference"].items == ["__repr__", "__abs__", "__add__", "__mul__"]
    assert got["code", "code_literal"].evidence == "6 dunder def(s) in code body"


def test_detectors_need_their_context(spark):
    texts = [("a", "b", "prose", "x defines seven special methods"), ("b", "b", "prose", DEFS), ("c", "b", None, None), ("d", "b", "prose", "defines many special methods.")]
    assert extract(corpus(spark, "c", texts), "base").count() == 0


def claim_of(spark, text, detectors, kind="prose"):
    r = extract(corpus(spark, "c", [("a", "b", kind, text)]), detectors).collect()
    return [(x.pos, x.value, x.scope_operator, x.evidence) for x in r]


@pytest.mark.parametrize(
    ("text", "claim"),
    [
        ("It provides 3 special methods.", (3, None, "provides 3 special methods.")),
        ("so we\n implemented Two SPECIAL method\nrest", (2, None, "we\n implemented Two SPECIAL method")),
        ("It defines one special method not  counting  a b c .\n", (1, "not  counting a b c", "defines one special method not  counting  a b c .")),
        ("It defines one special method excluding x, y\nmore", (1, "excluding x, y", "defines one special method excluding x, y")),
        ("It defines two special methods and implements five special methods.", (5, None, "implements five special methods.")),
        ("It defines two special methods .", None), ("It defines two special methods", None), ("It defines two special methods excluding that", None), ("It defines two special methods excluding.", None),
        ("It redefines two special methods.", None), ("It defines two, special methods.", None), ("It defines two specials methods.", None), ("It defines eleven special methods. It defines two special methods.", None),
    ],
)
def test_stated_counts(spark, text, claim):
    assert claim_of(spark, text, "base") == ([(0, *claim)] if claim else [])


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("the special method __a__ , __b__", 2), ("The  special methods __a__,__b__,\nand __c__, __d__", 3), ("the special methods __a__, __b__ and __c__", 2), ("the special methods __a__, __b__, or", 2),
        ("the special methods __a__, and more. the special methods __x__, __y_z__", 2), ("the special methods __a__ and __b__", None), ("special methods __a__, __b__", None), ("the special methods a, __b__", None), ("the special methods __a__, _b_", None),
    ],
)
def test_listed_names(spark, text, names):
    got = [(p, v) for p, v, *_ in claim_of(spark, text, "base")]
    assert got == ([(1, names)] if names else [])


@pytest.mark.parametrize(
    ("text", "n"),
    [("def __a__(self): def __a__(x)", 2), ("def\n__a__ (x)", 1), ("def a(x)", None), ("def __a__:", None), ("__a__(x)", None), ("def __a_b__(x) def __(x) def ____(y)", 1)],
)
def test_defined_names(spark, text, n):
    assert [(p, v, e) for p, v, _, e in claim_of(spark, text, "base", "code")] == ([(2, n, f"{n} dunder def(s) in code body")] if n else [])
    assert claim_of(spark, text, "base") == []


@pytest.mark.parametrize(
    ("text", "claim"),
    [
        (">>>len(x)\n5", (5, ">>>len(x)\n5")), ("a >>> x\n1\n>>>  len( d.e )  \n\n  12 rest", (12, ">>>  len( d.e )  \n\n  12")), (">>> len(x) 5", None), (">>> len(x)\n5x", None), (">>> Len(x)\n5", None),
        (">>> len(x)\nNone\n>>> len(y)\n7", (7, ">>> len(y)\n7")), (">>> len(x", None), ("len(x)\n5", None), (">>> len(f(x))\n5", None),
    ],
)
def test_printed_lengths(spark, text, claim):
    assert [(p, v, e) for p, v, _, e in claim_of(spark, text, "no_author_phrase")] == ([(3, *claim)] if claim else [])


@pytest.mark.parametrize(
    ("text", "claim"),
    [
        ("a Deck of 52 cards.", (52, "Deck of 52 cards")), ("List  made\nof ten element", (10, "List  made\nof ten element")), ("a set of three Itemsets", (3, "set of three Items")), ("subset of two cards", (2, "set of two cards")),
        ("a deck of many cards and a set of two cards", None), ("a pack of 52 cards", None), ("made of two cards", None), ("a deck of 52 big cards", None), ("a deck of things, a set of two cards", (2, "set of two cards")),
    ],
)
def test_counted_things(spark, text, claim):
    assert [(p, v, e) for p, v, _, e in claim_of(spark, text, "extended")] == ([(1, *claim)] if claim else [])


def test_primary_narrows_by_priority(spark):
    a = primary(spark, VECTOR, Q_VECTOR)
    assert (a.n_evidence, a.n_hypotheses, a.found, a.state, a.rule, a.answer, a.goal) == (3, 3, "conflicting", "supported", "rule_1", 5, "solved")
    assert a.tensions == {} and a.active_after == 1 and a.scope_operator == "in addition to the usual __init__"


def test_alternative_stalls_on_conflict_and_leaves_the_goal_open(spark):
    a = answer_alternative(corpus(spark, "c", VECTOR), questions(spark, [Q_VECTOR])).first()
    assert (a.n_evidence, a.n_hypotheses, a.state, a.stalled, a.answer, a.goal) == (3, 3, "conflicting", True, None, "open")
    assert a.tensions == {"unresolved_ambiguity": "HIGH"}
    b = answer_alternative(corpus(spark, "c", DECK), questions(spark, [Q_DECK])).first()
    assert (b.state, b.stalled, b.answer, b.goal) == ("supported", False, 3, "open")


@pytest.mark.parametrize(
    ("chunks", "detectors", "expected"),
    [
        (DECK, "base", (1, "supported", None, 3, "solved")),
        (DECK, "extended", (3, "conflicting", "rule_1", 52, "solved")),
        ([DECK_TEST], "no_author_phrase", (1, "supported", None, 52, "solved")),
        ([DECK_CODE, DECK_TEST], "no_author_phrase", (2, "conflicting", "rule_3", 3, "solved")),
        ([], "extended", (0, "unsupported", None, None, "open")),
        (VECTOR[:1] + VECTOR[4:], "extended", (0, "unsupported", None, None, "open")),
    ],
)
def test_deck_scenarios(spark, chunks, detectors, expected):
    a = primary(spark, chunks, Q_DECK, detectors)
    assert (a.n_evidence, a.found, a.rule, a.answer, a.goal) == expected
    if a.found == "unsupported":
        assert a.tensions == {"evidence_gap": "HIGH"}


def test_second_rule_and_no_rule(spark):
    chunks = [VECTOR[1], VECTOR[3]]
    a = primary(spark, chunks, Q_VECTOR)
    assert (a.rule, a.answer, a.source_type) == ("rule_2", 4, "forward_reference")
    b = primary(spark, chunks, Q_VECTOR, registry={"how_many": ["author_anchor"]})
    assert (b.found, b.state, b.rule, b.answer, b.goal) == ("conflicting", "conflicting", None, None, "open")
    assert b.tensions == {"unresolved_ambiguity": "HIGH"}
    assert primary(spark, chunks, Q_VECTOR, registry={}).goal == "open"


def test_agreeing_types_ignore_priority_and_keep_doubt(spark):
    chunks = [("one", "b", "code", "Vector special methods Example 1-2 count\n def __a__(self): pass\n def __b__(self): pass"), ("two", "b", "prose", "It defines two special methods.")]
    a = primary(spark, chunks, Q_VECTOR)
    assert (a.found, a.answer, a.source_type, a.rule) == ("supported", 2, "code_literal", None)
    assert a.tensions == {"unresolved_ambiguity": "MEDIUM"} and a.active_after == 2


def test_last_evidence_and_first_hypothesis_win(spark):
    rows = [("q", "c1", 1, 0, 3, "t"), ("q", "c1", 1, 1, 4, "t"), ("q", "c2", 2, 0, 3, "t")]
    claims = spark.createDataFrame(rows, "question_id string, chunk_id string, rank int, pos int, value int, source_type string")
    assert {(r.key, r.value) for r in resolve.evidence(claims).collect()} == {("c1:t", 4), ("c2:t", 3)}
    assert [(r.label, r.support, r.h_ord) for r in resolve.hypotheses(claims).orderBy("h_ord").collect()] == [("count=3/t", ["c1:t"], 1), ("count=4/t", ["c1:t"], 2)]


def test_refined_query_falls_back_on_empty(spark):
    rows = [("a", "c", "x", "y", "i", 1), ("b", "c", "x", "", "i", 1), ("d", "c", "x", None, "i", 1)]
    assert {r.question_id: r.query for r in refined(questions(spark, rows)).collect()} == {"a": "y", "b": "x", "d": "x"}


def test_seed_trace_and_dump(spark):
    asked = questions(spark, [Q_VECTOR])
    assert seeded(asked).select("state", "goal", F.col("hypotheses")[0]["source_type"]).first() == ("unknown", "open", "unknown")
    done = answer_primary(corpus(spark, "c", VECTOR), asked, preferences(spark))
    lines = trace(done).first().trace
    assert lines[2] == "step3: rule_1 fired=author_anchor" and lines[3].startswith("step4: answer = 5")
    assert '"answer":5' in dump(done).first().dump
    assert resolve.drop_seed(spark.createDataFrame([("unknown",), ("t",)], "source_type string")).count() == 1


def test_null_texts_and_many_questions(spark):
    chunks = corpus(spark, "c", [("a", "b", "prose", None), *VECTOR])
    asked = questions(spark, [Q_VECTOR, ("q2", "c", None, None, "how_many", 2), ("q3", "none", "Vector", None, "how_many", 2)])
    out = {r.question_id: r.answer for r in answer_primary(chunks, asked, preferences(spark)).collect()}
    assert out == {"q": 5, "q2": None, "q3": None}
    assert score(chunks, asked).where("text is null and question_id = 'q'").first().score == 0


def test_texts_are_cut_once(spark):
    df = extract(corpus(spark, "c", VECTOR + DECK), "extended")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_many_starts_in_one_text(spark):
    """Reading on from a start takes its own sentence, not the rest of the text."""
    text = "It defines many special methods, the special methods __a__ of " * 400 + "It defines two special methods."
    assert claim_of(spark, text, "extended") == [(0, 2, None, "defines two special methods.")]


def test_whole_state(spark):
    s = states(corpus(spark, "c", VECTOR), questions(spark, [Q_VECTOR]), preferences(spark)).first()
    assert set(s.K) == {"stated:author_anchor", "list:forward_reference", "code:code_literal"} and s.K["list:forward_reference"]["value"] == 4
    assert [(h["label"], h["active"]) for h in s.H] == [("count=5/author_anchor", True), ("count=4/forward_reference", False), ("count=6/code_literal", False)]
    assert (s.E, s.T, s.P, s.goal) == ("supported", {}, ["author_anchor", "forward_reference", "code_literal"], "solved")
    none = states(corpus(spark, "c", VECTOR[:1]), questions(spark, [Q_VECTOR]), preferences(spark)).first()
    assert (none.K, none.H, none.E, none.goal) == (None, None, "unsupported", "open")


def test_claims_are_computed_once(spark):
    """The optimiser adds no filter on what it explodes."""
    plan = extract(corpus(spark, "c", VECTOR), "extended")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


@pytest.mark.parametrize("kind", range(4))
def test_white_space_as_regular_expressions_have_it(spark, kind):
    """Of each of a quarter of all characters, and at the ends of texts."""
    code = F.col("id") * 4 + kind
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    chars = spark.range(0x110000 // 4).where(~code.between(0xD800, 0xDFFF)).select(char.alias("c")).where("c <> ''")  # a byte order mark is decoded to nothing
    blank = F.rlike("c", F.lit(r"(?U)^\s"))
    assert chars.where(starts_blank(F.col("c")) != blank).count() == 0
    assert chars.where(trimmed(F.concat("c", F.lit("x y"), "c")) != F.when(blank, "x y").otherwise(F.concat("c", F.lit("x y"), "c"))).count() == 0


def test_tasks_hold_so_many_parts_whatever_the_table(spark, monkeypatch):
    """A file of parts is small, what is written from it is not."""
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    monkeypatch.setattr(claims, "PARTS_A_TASK", 20)
    chunks = claims._chunks(spark, SF)
    sizes = [r["count"] for r in chunks.groupBy(F.spark_partition_id()).count().collect()]
    assert chunks.rdd.getNumPartitions() == -(-n // 20) and sum(sizes) == claims.KINDS * n and max(sizes) < claims.KINDS * 60


@pytest.mark.parametrize("name", ["answer_from_claims", "answer_trace", "no_priority_halt", "state_dump", "whole_state"])
def test_parts_are_dealt_once_for_answers(spark, monkeypatch, name):
    """To many tasks for ranking, and not again for the questions; the rows are those of the SQL."""
    monkeypatch.setattr(claims, "PARTS_A_TASK", 20)
    answers = claims.QUERIES[name](spark, SF)
    assert answers._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert_same(answers, connection(SF), claims.ORACLES[name])
