"""Retrieval through the index gives the rows of the scan."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import index, retrieve
from quillon.sources.tables import CHUNK, QUESTION

LETTERS = "abcdeé\u0130\U0001f600"


def word(r, n=6):
    return "".join(r.choice(LETTERS) for _ in range(r.randint(1, n)))


def tables(spark, seed, n_chunks=150, n_questions=60):
    r = random.Random(seed)
    vocabulary = [word(r) for _ in range(60)]
    # frequent words first
    pick = lambda: vocabulary[min(int(r.paretovariate(0.7)) - 1, 59)]
    blank = lambda: r.choice([" ", " ", "\n", "\u00a0", "  "])
    text = lambda n: "".join(r.choice([str.upper, str])(pick()) + r.choice(["", ".", "x"]) + blank() for _ in range(n))
    chunks = [(f"c{r.randrange(3)}", k, f"n{k}", "d", "prose", None if k % 40 == 7 else text(r.choice([0, 3, 20, 60]))) for k in range(n_chunks)]
    asked = [(f"q{k}", f"c{r.randrange(4)}", None if k % 20 == 3 else text(r.choice([0, 1, 4, 12])), None, "how_many", r.choice([None, 1, 2, 5, 300])) for k in range(n_questions)]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(asked, QUESTION)


def rows(df):
    return sorted((r.question_id, r.rank, r.score, r.ord, r.chunk_id, r.text, r.query) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_rows_as_the_scan(spark, seed):
    chunks, asked = tables(spark, seed)
    plain = retrieve.retrieve(chunks, asked)
    found = index.retrieve(chunks, asked, index.build(chunks))
    assert found.columns == plain.columns and rows(found) == rows(plain) and found.count() > 50


def test_questions_beyond_the_broadcast_limit_use_the_index(spark):
    chunks, asked = tables(spark, 4)
    few, many = retrieve.retrieve(chunks, asked), retrieve.retrieve(chunks, asked, broadcast_bytes=100)
    assert rows(few) == rows(many)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower" in plan(few).lower().replace(" ", "") or "lowered" in plan(few)
    assert "broadcast" not in plan(many).lower()


def test_an_index_that_was_written(spark, tmp_path):
    chunks, asked = tables(spark, 5)
    index.write(index.build(chunks), str(tmp_path))
    assert rows(index.retrieve(chunks, asked, index.read(spark, str(tmp_path)))) == rows(retrieve.retrieve(chunks, asked))


def test_ten_thousand_questions_look_at_few_chunks(spark):
    """Work follows the lists of rare words, not questions times chunks."""
    n, m = 10_000, 2_000
    # every chunk holds the frequent words, and three of 300 rare ones
    rare = lambda k: F.format_string("rare%04d", (F.xxhash64("id", F.lit(k)) % 150 + 150).cast("int"))
    chunks = spark.range(m).select(F.lit("c").alias("corpus_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("doc"), F.lit("prose").alias("kind"), F.concat_ws(" ", F.lit("the and for with"), rare(1), rare(2), rare(3)).alias("text"))
    asked = spark.range(n).select(F.format_string("q%d", "id").alias("question_id"), F.lit("c").alias("corpus_id"), F.concat_ws(" ", F.lit("the and for with"), rare(4), rare(5)).alias("query"), F.lit(None).cast("string").alias("query2"), F.lit("how_many").alias("intent"), F.lit(2).alias("top_k"))
    words = asked.select("question_id", "corpus_id", "top_k", F.explode(F.split("query", " ")).alias("word"))
    found, _ = index.candidates(words.distinct(), index.occurrences(words, index.build(chunks)), 4)
    seen = found.count()
    assert seen < n * m // 20
    top = index.ranked(asked, index.build(chunks), 4, 2)
    assert top.count() == 2 * n and top.where("score < 4").count() == 0


def test_no_pair_of_question_and_chunk_is_a_row(spark):
    """Frequent words alone: every chunk is a candidate of every question, and a task gives k rows a block and question."""
    blocks, size, n = 3, 1 << index.BLOCK_BITS, 40
    chunks = spark.range(blocks * size).select(F.lit("c").alias("corpus_id"), F.col("id").alias("ord"), F.concat(F.lit("the and for"), F.when(F.col("id") % 20_000 == 9, " with")).alias("text"))
    chunks = chunks.withColumn("text", F.coalesce("text", F.lit("the and for")))
    asked = spark.range(n).select(F.col("id").alias("question_id"), F.lit("c").alias("corpus_id"), F.lit("and with the for").alias("query"), F.lit(4).alias("top_k"))
    ranked = index.ranked(asked, index.build(chunks), 4, 4)
    got = sorted((r.question_id, r["rank"], r.ord, r.score) for r in ranked.collect())
    assert got == [(q, k, o, s) for q in range(n) for k, o, s in ((1, 9, 4), (2, 20_009, 4), (3, 40_009, 4), (4, 0, 3))]
    # no join of questions and chunks: only their parts meet, and the questions' blocks
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "FlatMapCoGroupsInArrow" in plan


def test_questions_in_parts(spark, monkeypatch):
    monkeypatch.setattr(index, "PART", 7)
    chunks, asked = tables(spark, 7)
    assert rows(index.retrieve(chunks, asked, index.build(chunks))) == rows(retrieve.retrieve(chunks, asked))


def test_long_words_and_tokens():
    words = [b"a" * 64, b"a" * 70, b"a" * 64 + b"b", b"abc", b"bca"]
    tokens = [b"xabcabc", b"a" * 69, b"a" * 80 + b"b", b"ca", b"bca"]
    pairs = [tuple(map(int, p)) for p in zip(*index.holders(words, tokens))]
    assert pairs == [(k, j) for k, w in enumerate(words) for j, t in enumerate(tokens) if w in t]
    assert [len(x) for x in index.holders([], tokens)] == [0, 0] and [len(x) for x in index.holders(words, [])] == [0, 0]


@pytest.mark.parametrize(("seed", "frequent", "rows_", "pairs"), [(1, 64, 1 << 15, 1 << 20), (2, 2, 5, 9), (3, 0, 1 << 15, 50), (4, 1 << 20, 1, 1)])
def test_places_that_reach_a_score(monkeypatch, seed, frequent, rows_, pairs):
    for name, x in (("FREQUENT", frequent), ("ROWS", rows_), ("PAIRS", pairs), ("ROWS_AT_ONCE", 3), ("SLICE_BYTES", 20)):
        monkeypatch.setattr(index, name, x)
    r = random.Random(seed)
    words, tokens = sorted({word(r, 4).encode() for _ in range(40)}), sorted({word(r, 9).encode() for _ in range(60)})
    held = [sorted(r.sample(range(300), r.choice([1, 3, 30, 200]))) for _ in tokens]
    cuts = np.cumsum([0, *map(len, held)])
    lists = index.lists_of(words, tokens, cuts, np.array([p for h in held for p in h]))
    texts = [[t for t, h in zip(tokens, held) if p in h] for p in range(300)]
    has = lambda w, p: any(words[w] in t for t in texts[p])
    assert [lists.places[f : f + n].tolist() for f, n in zip(lists.first, lists.df)] == [[p for p in range(300) if has(w, p)] for w in range(len(words))]
    asked = [r.sample(range(len(words)), r.choice([1, 2, 9, 20])) for _ in range(50)]
    least = [r.randint(1, len(a)) for a in asked]
    got = [x for part in index.reaching(lists, np.array(sum(asked, [])), np.cumsum([0, *map(len, asked)]), np.array(least, np.int32)) for x in zip(*(a.tolist() for a in part))]
    true = [(q, p, n) for q, a in enumerate(asked) for p in range(300) if (n := sum(has(w, p) for w in a)) >= least[q]]
    assert sorted(got) == true and len(true) > 100


def test_a_block_gives_only_chunks_that_can_be_among_the_first(spark):
    """A question's least score comes from the longest chunks: blocks without a chunk that reaches it, or that come later and
    have none above it, give no row, so rows don't grow with blocks times questions."""
    size, n = 1 << index.BLOCK_BITS, 30
    schema = pa.schema([("question_id", pa.int64()), ("k", pa.int32()), ("ord", pa.int64()), ("score", pa.int32())])
    asked = pa.table({"corpus_id": ["c"] * n, "slice": pa.array([0] * n, pa.int32()), "part": pa.array([0] * n, pa.int32()), "question_id": pa.array(range(n)), "k": pa.array([2] * n, pa.int32()), "words": [[b"alpha", b"beta", b"gamma"]] * n})
    long = pa.table({"ord": pa.array([size + 5, size + 1, size + 9]), "tokens": pa.array([[b"alpha", b"beta"], [b"beta", b"alphas"], [b"alpha", b"xbeta"]])})
    bundles = index._least_scores(long, asked)
    assert bundles.num_rows == 1
    tokens = lambda block, held: pa.table({"block": [block] * 3, "token": [b"alpha", b"beta", b"gamma"], "places": pa.array(held, pa.list_(pa.int16()))})
    found = lambda block, held: [tuple(x.values()) for x in index._scored_block(tokens(block, held), bundles, schema).select(["question_id", "ord", "score"]).to_pylist()]
    # two of the three long ones come first: ords size + 1 and size + 5, with score 2
    assert found(0, [[1, 2, 3], [4, 5], [6]]) == []
    assert found(0, [[1, 2, 3], [2, 3], [3]]) == [x for q in range(n) for x in ((q, 3, 3), (q, 2, 2))]
    assert found(2, [[1, 2, 3], [1, 2, 3], [7]]) == []
    assert found(2, [[1, 2, 3], [1, 2, 3], [2]]) == [(q, 2 * size + 2, 3) for q in range(n)]


def test_corpora_far_from_the_first_block(spark):
    chunks, asked = tables(spark, 8)
    chunks = chunks.withColumn("ord", F.col("ord") * 700_001 + 10**12)
    assert rows(index.retrieve(chunks, asked, index.build(chunks))) == rows(retrieve.retrieve(chunks, asked))


def test_questions_that_nothing_answers(spark):
    chunks, asked = tables(spark, 9)
    asked = asked.withColumns({"query": F.lit("zzzz qqqq"), "question_id": F.substring("question_id", 2, 9).cast("long")})
    assert index.ranked(asked, index.build(chunks), 4, 4).count() == 0


def test_edge_cases(spark):
    none = spark.createDataFrame([], CHUNK)
    chunks, asked = tables(spark, 6, 20, 5)
    assert index.retrieve(none, asked, index.build(none)).count() == 0
    assert index.retrieve(chunks, spark.createDataFrame([], QUESTION), index.build(chunks)).count() == 0
    long = spark.createDataFrame([("c", 1, "n", "d", "prose", "x" * 50_000 + "needle" + "y" * 50_000)], CHUNK)
    one = spark.createDataFrame([("q", "c", "needle NEEDLEY absent", None, "how_many", 1)], QUESTION)
    assert [r.score for r in index.retrieve(long, one, index.build(long)).collect()] == [2]
