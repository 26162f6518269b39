import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quillon.llm import decontamination, mixing
from quillon.llm.common import staged
from quillon.llm.quality_gam import features, train
from tests.llm.helpers import DOCS, SMALL, roots

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given, and its result."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in p.STAGES:
        made = staged(stage(spark, docs, SMALL), "test")
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_columns(stages):
    assert [made.columns for *_, made in stages] == [NAMES] * 4 + [[*NAMES, "shard", "slot"]]
    assert all(made.count() > 0 for *_, made in stages)


def test_quality_stage_against_the_model(spark, stages):
    _, docs, made = stages[0]
    model = train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    import numpy as np

    want = {r.doc_id for r in docs.collect() if model.score(np.array([features(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in made.collect()} == want and len(want) < docs.count()


def test_dedup_stage_against_all_pairs(stages):
    _, docs, made = stages[1]
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    split = {i: rows[i].encode().lower().split() for i in ids}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in split.items()}
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if not (sets[a] or sets[b]) or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id for r in made.collect()} == set(roots(ids, alike).values())


def test_decontamination_stage_against_containment(spark, stages):
    _, docs, made = stages[2]
    grams = lambda t: {tuple(w) for w in zip(*(decontamination.tokens(t)[k:] for k in range(3)))}
    items = [grams(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in docs.collect() if not any(len(i & grams(r.text)) >= 0.9 * len(i) for i in items)}
    assert {r.doc_id for r in made.collect()} == clean


def test_mixing_and_sharding_stages(stages):
    _, docs, mixed = stages[3]
    times = {r.doc_id: r.times for r in mixing.mix_sources(docs).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: v for k, v in times.items() if v}
    _, _, sharded = stages[4]
    assert sharded.select(*NAMES).exceptAll(mixed).count() == 0 and sharded.count() == mixed.count()
    sizes = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_run_equals_the_stages(spark, stages):
    out = p.run(spark, SMALL)
    assert {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(r.doc_id, r.n) for r in stages[-1][2].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert p.ORACLE_SQL is None and 4 <= len(p.STAGES) <= 5


def test_stages_keep_columns_of_any_name_and_repeated_rows(spark):
    from tests.llm.helpers import docs_of, rng, words

    r = rng(9)
    texts = [(k, words(r, 80, 5000) + ". And so it goes on.", r.choice("abc")) for k in range(40)] + [(7, None, "a"), (99, "long " + words(r, 60_000, 9000), "b")]
    texts += [texts[3]] * 2 + [(100, texts[5][1], "c")]
    extra = {c: f"concat('{c}', doc_id)" for c in ("score", "predicted", "hits", "size", "target", "times", "node", "root", "keys", "words", "a.b", "part")}
    docs = docs_of(spark, texts).selectExpr("*", *[f"{e} AS `{c}`" for c, e in extra.items()])
    for name, stage in p.STAGES:
        made = stage(spark, docs, SMALL)
        assert made.columns[: len(docs.columns)] == docs.columns
        rows = made.collect()
        assert rows and all(x[c] == f"{c}{x.doc_id}" for x in rows for c in extra)
        count = {k: sum(x.doc_id == k for x in rows) for k in (3, 5, 100)}
        if name == "near-dedup":
            assert count == {3: 1, 5: 1, 100: 0} and len(rows) == 42
        elif name in ("decontamination", "sharding"):
            assert count == {3: 3, 5: 1, 100: 1} and len(rows) == len(texts)
        else:
            assert count[3] in (0, 3, 6)


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], DOCS)
    empty = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() <= 3
