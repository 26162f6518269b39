import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import sharding
from quillon.llm.sharding import communication_matrix, hypergeometric, hypergeometric_law, op1_sharding, shard_uniformly, write_shards
from tests.llm.helpers import DOCS, SMALL, docs_of
from tests.oracle import assert_same, connection


def test_query_is_whole_and_balanced(spark):
    rows = op1_sharding(spark, SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1 and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_reruns_agree(spark):
    one = {(r.doc_id, r.shard, r.slot) for r in op1_sharding(spark, SMALL).collect()}
    assert one == {(r.doc_id, r.shard, r.slot) for r in op1_sharding(spark, SMALL).collect()}


@pytest.mark.parametrize("parts", [{}, {0: 1}, {0: 5, 3: 11, 9: 0}, {k: 7 * k for k in range(20)}])
def test_matrix_margins(parts):
    got = communication_matrix(parts, 8, 5)
    assert {p: c[-1] for p, c in got.items()} == parts
    sums = np.sum([np.diff([0, *c]) for c in got.values()], axis=0) if got else np.zeros(8)
    total = sum(parts.values())
    assert [int(x) for x in sums] == [total // 8 + (s < total % 8) for s in range(8)]


def test_matrix_follows_the_law():
    """Of two partitions of 4 rows in two shards, the mean sent from the first to the first shard is 2, its variance 4 x 1/2 x 1/2 x 4/7."""
    draws = [communication_matrix({0: 4, 1: 4}, 2, seed)[0][0] for seed in range(3000)]
    assert abs(np.mean(draws) - 2) < 0.06 and abs(np.var(draws) - 4 / 7) < 0.06


@pytest.mark.parametrize(("good", "bad", "n"), [(5, 7, 6), (40, 3, 20), (3, 40, 20), (300, 2_000, 900), (1, 1, 1)])
def test_law_against_counted_choices(good, bad, n):
    first, law = hypergeometric_law(good, bad, n)
    ways = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(first, first + len(law))]
    assert sum(ways) == pytest.approx(1, abs=1e-12) and law / law.sum() == pytest.approx(ways, rel=1e-9, abs=1e-15)


def test_law_beyond_the_generator():
    """At 2.4 x 10^12 rows: neighbours have the exact ratio, mean and variance are those of the law, draws follow it."""
    good, bad, n = 3 * 10**11, 21 * 10**11, 40_000_000
    first, law = hypergeometric_law(good, bad, n)
    law, k = law / law.sum(), np.arange(first, first + len(law), dtype=float)
    mean, share = n * good / (good + bad), n / (good + bad)
    variance = mean * bad / (good + bad) * (1 - share)
    assert law @ k == pytest.approx(mean, rel=1e-9) and law @ (k - mean) ** 2 == pytest.approx(variance, rel=1e-6)
    at = len(law) // 2
    exact = Fraction((good - first - at) * (n - first - at), (first + at + 1) * (bad - n + first + at + 1))
    assert law[at + 1] / law[at] == pytest.approx(float(exact), rel=1e-9)
    rng = np.random.default_rng(3)
    z = np.array([(hypergeometric(good, bad, n, rng) - mean) / variance**0.5 for _ in range(2_000)])
    assert abs(z.mean()) < 0.1 and abs(z.var() - 1) < 0.15 and abs((z < -1).mean() - 0.1587) < 0.03 and abs((z > 2).mean() - 0.0228) < 0.015


def test_both_ways_of_drawing_agree(monkeypatch):
    one = [hypergeometric(600, 1_400, 500, np.random.default_rng(s)) for s in range(3_000)]
    monkeypatch.setattr(sharding, "GENERATOR_ROWS", 0)
    two = [hypergeometric(600, 1_400, 500, np.random.default_rng(s)) for s in range(3_000)]
    assert abs(np.mean(one) - np.mean(two)) < 0.7 and abs(np.std(one) / np.std(two) - 1) < 0.06


def test_matrix_of_very_many_rows():
    got = communication_matrix({p: 3_000_000_000 for p in range(4)}, 8, 1)
    assert np.sum([np.diff([0, *c]) for c in got.values()], axis=0).tolist() == [1_500_000_000] * 8


def test_edge_cases(spark):
    texts = [None, "", "x" * 300_000, "same", "same"] + [(None, "a", None)] * 3
    rows = shard_uniformly(docs_of(spark, texts).selectExpr("*", "7 AS Shard", "'x' AS slot"), 3, rows_per_block=1)
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = rows.collect()
    assert Counter(r.shard for r in got) == {0: 3, 1: 3, 2: 2} and Counter(r.text for r in got)["a"] == 3
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    assert shard_uniformly(spark.createDataFrame([], DOCS)).collect() == []
    assert [r.slot for r in shard_uniformly(docs_of(spark, ["one"])).collect()] == [0]


def test_main_path_is_native(spark):
    plan = op1_sharding(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_written_shards(spark, tmp_path):
    write_shards(shard_uniformly(docs_of(spark, list("abcdefghijk")), 2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r["count"]) for r in back.groupBy("shard").count().collect()} == {(0, 6), (1, 5)}


def test_sizes_and_checksums_agree_with_sql(spark):
    """What SQL can tell of the query's rows; a checksum takes a step for each bit, so short texts only."""
    bits = lambda x: f"list_reduce([{x}] || [CAST(k AS BIGINT) FOR k IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    step = f"lambda a, x: xor(a >> 8, {bits('xor(a, x) & 255')})"
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE length(coalesce(text, '')) < 300), b AS (SELECT doc_id, t, hex(encode(t)) AS h FROM d)
      SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT) FOR i IN range(strlen(t))], {step}), 4294967295) AS text_crc32 FROM b"""
    short = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(coalesce(text, '')) < 300").select("doc_id")
    out = op1_sharding(spark, SMALL).join(short, "doc_id").select("doc_id", "size", "text_crc32")
    assert assert_same(out, connection(SMALL), sql) == short.count() > 10
