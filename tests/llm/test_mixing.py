import re

import numpy as np
import pytest

from quillon.llm import mixing as m
from tests.llm.helpers import DOCS, SMALL, docs_of, rng, words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0d]+", text or ""))


def plain_targets(sizes, share=1.5, cap=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    free, budget = set(names), share * sum(sizes.values())
    while True:
        left = budget - sum(cap * sizes[s] for s in names if s not in free)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: level * w[s] if s in free else cap * sizes[s] for s in names}
        free -= over


def check(rows, texts):
    sizes, taken, targets = {}, {}, {}
    for r in rows:
        text, source = texts[r.doc_id]
        assert r["size"] == size(text) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[source] = sizes.get(source, 0) + r["size"]
        taken[source] = taken.get(source, 0) + r.taken
        targets[source] = (r.target, r.source_size)
    want = plain_targets(sizes)
    for s in sizes:
        assert targets[s][1] == sizes[s] and targets[s][0] == pytest.approx(want[s], rel=1e-9)
    return sizes, taken, want


def test_query(spark):
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = m.op7_mixing(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    _, taken, want = check(rows, texts)
    assert all(abs(taken[s] - want[s]) <= max(40, 0.05 * want[s]) for s in want)
    assert rows and {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in m.op7_mixing(spark, SMALL).collect()}


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, two = ({(r.doc_id, r.times) for r in m.mix_sources(d).collect()} for d in (docs, docs.orderBy("text").repartition(7)))
    assert one == two


def test_targets_of_very_many_sources(spark):
    n, r = 100_000, np.random.default_rng(3)
    sizes = [int(x) for x in r.pareto(0.7, n) * 50]
    rows = [(f"h{k}", x) for k, x in enumerate(sizes)] + [(None, 77), ("", 5)]
    got = {x.source: x.target for x in m.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    want = plain_targets(dict(rows))
    assert set(got) == set(want) and all(got[s] == pytest.approx(t, rel=1e-9, abs=1e-9) for s, t in want.items())


def best_sum(sizes, counts, budget):
    reach = {0}
    for s, c in zip(sizes, counts):
        for _ in range(c):
            reach |= {x + s for x in reach}
    return min(reach, key=lambda x: (abs(x - budget), x))


def test_knapsack_is_optimal():
    r = rng(2)
    for _ in range(200):
        n = r.randint(1, 5)
        sizes = np.array(sorted(r.sample([*range(0, 30), 200, 40_000, 90_000], n)), dtype=np.int64)
        counts = np.array([r.randint(1, 4) for _ in range(n)], dtype=np.int64)
        budget = r.choice([r.randint(0, 80), r.randint(0, 80), 39_990, 70_000])
        got = m._knapsack(sizes, counts, budget, np.arange(n))
        assert (got <= counts).all() and (got * sizes).sum() == best_sum(sizes.tolist(), counts.tolist(), budget)


def test_fit_of_large_sources_is_exact():
    r = np.random.default_rng(1)
    sizes = np.unique(r.integers(1, 20_000, 3_000))
    counts = r.integers(1, 400, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.01, 0.37, 1.0, 1.5, 1.99, 2.0):
        passes, extra = m.fit_lengths(sizes, counts, total * share)
        assert (extra >= 0).all() and (extra <= counts).all() and passes + (extra > 0).any() <= 2
        assert passes * total + int((sizes * extra).sum()) == round(total * share)


def test_edge_cases(spark):
    r = rng(4)
    texts = [(k, words(r, r.randint(1, 60)), r.choice(["a", "b", "é", None])) for k in range(150)]
    texts += [(900, None, "a"), (901, "", None), (902, " \n\t", "empty"), (903, words(r, 30_000), "long"), (904, "same words here", "a"), (905, "same words here", "a")]
    df = docs_of(spark, texts).selectExpr("*", "1 AS Size", "'x' AS target", "2 AS times")
    rows = m.mix_sources(df).collect()
    assert len(rows) == len(texts)
    sizes, taken, want = check(rows, {i: (t, s) for i, t, s in texts})
    assert {r.target for r in rows if r.doc_id == 902} == {0.0} and all(abs(taken[s] - want[s]) <= (15_000 if s == 'long' else 12) for s in sizes)
    drawn = m.draw_mix(docs_of(spark, texts)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in drawn} == {r.doc_id: r.times for r in rows if r.times}
    assert m.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    none = m.mix_sources(docs_of(spark, [None, ""])).collect()
    assert [(r.target, r.times, r.taken) for r in none] == [(0.0, 0, 0)] * 2


def test_equal_rows_go_together_and_one_length_is_ranked(spark):
    texts = [(k, f"w{k} x y", "a") for k in range(500)] + [(k, f"z{k}", "b") for k in range(1000, 1600)]
    rows = m.mix_sources(docs_of(spark, texts), share=0.5, weights=(1, 1)).collect()
    a = [r for r in rows if r.doc_id < 1000]
    assert sum(r.times for r in a) == round(a[0].target / 3) and {r.times for r in a} == {0, 1}
    twins = m.mix_sources(docs_of(spark, [(1, "a b", "s")] * 40 + [(2, "c d", "s")] * 40)).collect()
    assert len({(r.doc_id, r.times) for r in twins}) == 2


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = {(r.doc_id, r.times, r.target) for r in m.mix_sources(docs).collect()}
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    assert one == {(r.doc_id, r.times, r.target) for r in m.mix_sources(docs).collect()}
