import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import quality_gam as g
from tests.llm.helpers import DOCS, SMALL, docs_of

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in g.op8_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    unseen = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in unseen) and len(unseen) > 90
    assert sum(rows[r.doc_id].predicted == r.quality for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(g.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (g.score_quality(docs, g.train(docs, x)).select("doc_id", "score").collect() for x in (labels, flipped))
    assert {tuple(r) for r in one} == {tuple(r) for r in two}


def test_tables_add_up():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = g.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.95
    row = x[7]
    total = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, row))
    for (a, b), t in zip(model.pairs, model.pair_tables):
        total += t[np.searchsorted(model.pair_edges[a], row[a], side="right"), np.searchsorted(model.pair_edges[b], row[b], side="right")]
    assert model.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def slow_fit(x, y):
    """The same boosting over rows, one at a time, with dicts for tables: what a text scores, by a function."""
    bins = lambda v, of: sum(e <= v for e in of)
    cuts = lambda j, n: sorted({sorted(r[j] for r in x)[math.ceil(k / n * (len(x) - 1) - 1e-9)] for k in range(1, n)})
    p = (sum(y) + 0.5) / (len(y) + 1)
    start, edges = math.log(p / (1 - p)), [cuts(j, g.MAX_BINS) for j in range(len(x[0]))]
    tables, total = [[0.0] * (len(e) + 1) for e in edges], [start] * len(y)
    gain = lambda a, b: a * a / (b + g.L2)

    def leaves(gs, hs, depth):
        if depth and len(gs) > 1:
            best, at = 1e-9, None
            for k in range(1, len(gs)):
                l, r = (sum(gs[:k]), sum(hs[:k])), (sum(gs[k:]), sum(hs[k:]))
                if min(l[1], r[1]) * 4 >= g.LEAF_WEIGHT and (made := gain(*l) + gain(*r) - gain(sum(gs), sum(hs))) > best + 1e-12:
                    best, at = made, k
            if at:
                return leaves(gs[:at], hs[:at], depth - 1) + leaves(gs[at:], hs[at:], depth - 1)
        return [sum(gs) / (sum(hs) + g.L2)] * len(gs)

    for _ in range(g.ROUNDS):
        for j, e in enumerate(edges):
            gs, hs = [0.0] * len(tables[j]), [0.0] * len(tables[j])
            for row, label, t in zip(x, y, total):
                q, b = 1 / (1 + math.exp(-t)), bins(row[j], e)
                gs[b] += label - q
                hs[b] += q * (1 - q)
            step = [g.RATE * v for v in leaves(gs, hs, 2)]
            tables[j] = [a + b for a, b in zip(tables[j], step)]
            total = [t + step[bins(row[j], e)] for row, t in zip(x, total)]
    return lambda row: 1 / (1 + math.exp(-(start + sum(t[bins(v, e)] for t, e, v in zip(tables, edges, row)))))


def test_fit_against_a_plain_one(monkeypatch):
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(160, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + r.normal(size=160) * 0.4 > 0.4).astype(float)
    monkeypatch.setattr(g, "N_PAIRS", 0)
    monkeypatch.setattr(g, "ROUNDS", 25)
    slow, model = slow_fit(x.tolist(), y.tolist()), g.fit(x, y)
    assert model.score(x) == pytest.approx([slow(v) for v in x.tolist()], abs=1e-9)


def slow_pairs(x, y, model):
    """Boosting of pairs on top of ``model``'s main effects, cell by cell: every cut of one feature, and every cut of the
    other on either side of it. Gives the pairs and the whole score."""
    bins = lambda v, of: sum(e <= v for e in of)
    cuts = lambda j: sorted({sorted(r[j] for r in x)[math.ceil(k / g.PAIR_BINS * (len(x) - 1) - 1e-9)] for k in range(1, g.PAIR_BINS)})
    edges = [cuts(j) for j in range(len(x[0]))]
    main = lambda row: model.intercept + sum(t[bins(v, e)] for t, e, v in zip(model.tables, model.edges, row))
    total = [main(r) for r in x]
    gain = lambda a, b: a * a / (b + g.L2)

    def halves(sums):
        """Leaf of each column, and the gain, of the best cut of columns, if any is good."""
        gs, hs = sum(a for a, _ in sums), sum(b for _, b in sums)
        best, out = 1e-9, [gs / (hs + g.L2)] * len(sums)
        for k in range(1, len(sums)):
            (la, lb), (ra, rb) = ((sum(v) for v in zip(*part)) for part in (sums[:k], sums[k:]))
            if min(lb, rb) * 4 >= g.LEAF_WEIGHT and gain(la, lb) + gain(ra, rb) - gain(gs, hs) > best + 1e-12:
                best = gain(la, lb) + gain(ra, rb) - gain(gs, hs)
                out = [la / (lb + g.L2)] * k + [ra / (rb + g.L2)] * (len(sums) - k)
        return out

    def best_tree(a, b):
        grid = [[[0.0, 0.0] for _ in range(len(edges[b]) + 1)] for _ in range(len(edges[a]) + 1)]
        for row, label, t in zip(x, y, total):
            q, cell = 1 / (1 + math.exp(-t)), grid[bins(row[a], edges[a])][bins(row[b], edges[b])]
            cell[0] += label - q
            cell[1] += q * (1 - q)
        columns = lambda rows: [tuple(sum(r[c][i] for r in rows) for i in (0, 1)) for c in range(len(edges[b]) + 1)]
        whole = gain(*(sum(c[i] for r in grid for c in r) for i in (0, 1)))
        best, out = 0.0, [[0.0] * (len(edges[b]) + 1) for _ in grid]
        for k in range(1, len(grid)):
            made, parts = -whole, []
            for rows in (grid[:k], grid[k:]):
                sums = columns(rows)
                leaf = halves(sums)
                for v in sorted(set(leaf)):
                    made += gain(*(sum(s[i] for s, w in zip(sums, leaf) if w == v) for i in (0, 1)))
                parts += [leaf] * len(rows)
            if made > best + 1e-9:
                best, out = made, parts
        return best, out

    ranked = sorted((-best_tree(a, b)[0], a, b) for a in range(len(edges)) for b in range(a + 1, len(edges)))
    pairs = [(a, b) for got, a, b in ranked[: g.N_PAIRS] if got < 0]
    tables = {p: [[0.0] * (len(edges[p[1]]) + 1) for _ in range(len(edges[p[0]]) + 1)] for p in pairs}
    for _ in range(g.PAIR_ROUNDS):
        for a, b in pairs:
            step = best_tree(a, b)[1]
            tables[a, b] = [[t + g.RATE * s for t, s in zip(r, rs)] for r, rs in zip(tables[a, b], step)]
            total = [t + g.RATE * step[bins(r[a], edges[a])][bins(r[b], edges[b])] for r, t in zip(x, total)]
    added = lambda row: sum(tables[a, b][bins(row[a], edges[a])][bins(row[b], edges[b])] for a, b in pairs)
    return pairs, lambda row: 1 / (1 + math.exp(-(main(row) + added(row))))


def test_pairs_against_plain_ones(monkeypatch):
    r = np.random.default_rng(8)
    x = np.round(r.normal(size=(140, 4)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2) | (x[:, 2] * x[:, 3] > 1)).astype(float)
    monkeypatch.setattr(g, "ROUNDS", 6)
    monkeypatch.setattr(g, "PAIR_ROUNDS", 5)
    monkeypatch.setattr(g, "N_PAIRS", 3)
    model = g.fit(x, y)
    pairs, slow = slow_pairs(x.tolist(), y.tolist(), model)
    assert model.pairs == pairs and len(pairs) == 3
    assert model.score(x) == pytest.approx([slow(v) for v in x.tolist()], abs=1e-9)


def test_scores_of_documents_against_the_plain_model(spark, monkeypatch):
    """The query's scores, from its own training rows and features, by the plain boosting of mains and pairs."""
    monkeypatch.setattr(g, "ROUNDS", 4)
    monkeypatch.setattr(g, "PAIR_ROUNDS", 3)
    monkeypatch.setattr(g, "N_PAIRS", 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts:
            known[r.doc_id] = min(known.get(r.doc_id, 1), r.quality)
    x, y = [list(g.features(texts[i])) for i in sorted(known)], [float(known[i] > 0) for i in sorted(known)]
    model = g.fit(np.array(x), np.array(y))
    plain = slow_fit(x, y)
    mains = g.Additive(model.intercept, model.edges, model.tables)
    assert mains.score(np.array(x)) == pytest.approx([plain(v) for v in x], abs=1e-9)
    _, slow = slow_pairs(x, y, model)
    for r in g.op8_quality_classifier(spark, SMALL).collect():
        assert r.score == pytest.approx(slow(list(g.features(texts[r.doc_id]))), abs=1e-9)


def test_rows_to_learn_from_are_bounded_and_one_an_id(spark):
    texts = [(k % 40, f"{'w ' * (k % 7)}{k}", "s") for k in range(2_000)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(k, k % 2, 0) for k in range(40)], LABELS)
    seen = []
    g_fit, g.fit = g.fit, lambda x, y: seen.append(len(y)) or g_fit(x, y)
    try:
        one, two = g.train(docs, labels), g.train(docs.orderBy("text"), labels)
        g.train(docs, labels, max_rows=5)
    finally:
        g.fit = g_fit
    assert 20 < seen[0] == seen[1] < 40 and seen[2] <= 14 and one.intercept == two.intercept
    assert all((a == b).all() for a, b in zip(one.tables, two.tables))


def test_main_effects_alone():
    r = np.random.default_rng(1)
    x = r.uniform(size=(1500, 2))
    y = (r.uniform(size=1500) < 1 / (1 + np.exp(-8 * (x[:, 0] - 0.5)))).astype(float)
    model = g.fit(x, y)
    grid = np.column_stack([np.linspace(0.05, 0.95, 10), np.full(10, 0.5)])
    assert np.corrcoef(model.score(grid), grid[:, 0])[0, 1] > 0.95 and model.score(grid)[0] < 0.2 < 0.8 < model.score(grid)[-1]


def test_features():
    assert len(g.features("a b")) == len(g.FEATURES) == len(g.features(None)) == len(g.features(" \n"))
    got = dict(zip(g.FEATURES, g.features("The THE THE! | x\nx\nx")))
    assert got["bare_marks"] == pytest.approx(1 / 7) and got["shouted"] == pytest.approx(2 / 7) and got["distinct_lines"] == pytest.approx(2 / 3) and got["adjacent_repeats"] == pytest.approx(2 / 7)
    assert np.isfinite(g.features("é" * 100_000 + " #")).all()


def test_edge_cases(spark):
    empty = spark.createDataFrame([], LABELS)
    docs = docs_of(spark, [None, "", "a b", "a b", "x " * 100_000, (None, "id", None)])
    rows = g.score_quality(docs.selectExpr("*", "1 AS Score", "2 AS predicted"), g.train(docs, empty)).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 6
    kept = g.keep_quality(docs.selectExpr("*", "doc_id + 1 AS score", "2 AS predicted"), g.train(docs, empty))
    assert kept.columns == [*docs.columns, "score", "predicted"] and sorted(r.score for r in kept.where("doc_id < 5").collect()) == [1, 2, 3, 4, 5]
    some = spark.createDataFrame([(0, 1, 0), (2, None, 0), (None, 0, 0), (2, 1, 1), (2, 0, 0), (77, 1, 0)], LABELS)
    scored = g.score_quality(docs, g.train(docs, some)).collect()
    assert all(0 < r.score < 1 for r in scored) and scored[2].score == scored[3].score and scored[0].score == scored[1].score
    assert g.score_quality(spark.createDataFrame([], DOCS), g.train(spark.createDataFrame([], DOCS), some)).collect() == []
    held = docs.select(g.held_out(F.col("doc_id")).alias("h"), "doc_id").collect()
    assert all(r.h == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in held)
