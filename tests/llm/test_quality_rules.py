import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import quality_rules as q
from tests.llm.helpers import DOCS, SMALL, docs_of, rng, words
from tests.oracle import assert_same, connection


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def got(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = q.op9_quality_rules(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert got(r) == base(texts[r.doc_id]) and not (r.kept and r.base_failed)


def test_plain_counts_agree_with_sql(spark):
    """The counts that SQL can express, over all documents."""
    sql = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x FROM d),
      l AS (SELECT doc_id, x, t, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS y FROM w)
      SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(length(array_to_string(x, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(y) - len(list_distinct(y)) AS BIGINT) AS n_dup_lines FROM l"""
    of = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = q.base_rules(of).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines")
    assert assert_same(out, connection(SMALL), sql) == of.count()


def test_trusted_ids_beyond_the_broadcast_limit(spark, monkeypatch):
    docs = docs_of(spark, [f"a b w{k % 7} w{k % 3}" for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    one = q.fit_ratios(docs, labels)
    monkeypatch.setattr(q, "BROADCAST_BYTES", 0)
    assert q.fit_ratios(docs, labels) == one


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in q.op9_quality_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    assert all(r.kept for r in good if not r.base_failed)
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_ratio_is_that_of_the_multinomials(spark):
    docs = docs_of(spark, ["a b a", "c c", "a d", None])
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = q.fit_ratios(docs, labels)
    assert math.isinf(ratios.threshold)  # the only trusted document is counted
    raw, target = Counter(buckets("a b a") + buckets("c c") + buckets("a d")), Counter(buckets("a b a"))
    for b in range(q.N_BUCKETS):
        assert ratios.of[b] == pytest.approx(math.log(share(target[b], 5) / share(raw[b], 11)), abs=6e-5)
    scored = {r.doc_id: r.llr for r in q.apply_rules(docs, ratios).collect()}
    assert scored[0] == pytest.approx(sum(ratios.of[b] for b in buckets("a b a")) / 5) and scored[3] == 0.0


def hashed(*xs, seed=42):
    """The hash of strings and longs one after the other, each seeded by the one before, as Spark has it."""
    for x in xs:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<Q", x), seed)
    return seed


def buckets(text):
    h = [hashed(w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]
    return [x % q.N_BUCKETS for x in h] + [hashed(a, b) % q.N_BUCKETS for a, b in zip(h, h[1:])]


def share(n, total):
    return (1 - q.SMOOTHING) * n / total + q.SMOOTHING / q.N_BUCKETS


def test_verdicts_against_brute_force(spark):
    """Both multinomials, the threshold and every verdict of the query, counted plainly."""
    sf = SMALL.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted = {r.doc_id for r in labels.where("q = 1").collect()} & set(texts)
    last = {i for i in trusted if spark_hash(i) % q.HELD_OUT == 0}
    of = {i: buckets(t) for i, t in texts.items()}
    raw, target = Counter(b for x in of.values() for b in x), Counter(b for i in trusted - last for b in of[i])
    n_raw, n_target = raw.total(), target.total()
    log = {b: round(math.log(share(target[b], n_target) / share(raw[b], n_raw)), 4) for b in raw}
    llr = {i: sum(log[b] for b in x) / len(x) if x else 0.0 for i, x in of.items()}
    least, low, high = np.quantile([llr[i] for i in last if not base(texts[i])[5]], [0.005, 0.25, 0.75])
    threshold = least - 0.5 * (high - low)
    rows = q.op9_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and len(last) > 20
    for r in rows:
        assert r.llr == pytest.approx(llr[r.doc_id], abs=2e-6)
        if abs(llr[r.doc_id] - threshold) > 1e-6:
            assert r.kept == (not base(texts[r.doc_id])[5] and llr[r.doc_id] >= threshold)


def spark_hash(doc_id):
    """Of an int, which is hashed as four bytes, and a long; modulo as a signed number has it."""
    seed = xxhash.xxh64_intdigest(struct.pack("<i", 17), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed)
    return h - (1 << 64) if h >> 63 else h


def test_threshold_is_that_of_all_held_out_documents(spark):
    """Of more of them than a sample would have."""
    n = 30_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(52)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(900)).cast("string"))), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    ratios = q.fit_ratios(docs, labels)
    held = q.trusted_ids(labels).where("good = 0").select("doc_id")
    scores = [r.llr for r in q.apply_rules(docs.join(held, "doc_id"), ratios).where("NOT base_failed").select("llr").collect()]
    least, low, high = np.quantile(scores, [0.005, 0.25, 0.75])
    assert len(scores) > 5_000 and ratios.threshold == pytest.approx(least - 0.5 * (high - low), abs=1e-9)


def test_edge_cases(spark):
    r = rng(1)
    clean = words(r, 80)
    texts = [
        None, "", " \n\x0b ", "a", "a b", "a b c", "a b c a b c", "x x x x", "l1\nl1\n \n\nl1\nl2 ", "| # & % é é", clean, clean, "w " * 40_000, "a\x0bb\x0cc\rd\te", "a b c d a b c e a b c", "é\U0001f600 x",
    ]
    df = docs_of(spark, texts).selectExpr("*", "true AS Kept", "1 AS n_words")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ratios = q.fit_ratios(df, labels)
    assert set(ratios.of) == {0.0} and math.isinf(ratios.threshold)
    rows = q.apply_rules(df, ratios).collect()
    for x in rows:
        assert got(x) == base(texts[x.doc_id]), texts[x.doc_id]
    assert [x.kept for x in rows if x.doc_id in (10, 11)] == [True, True]
    assert q.apply_rules(spark.createDataFrame([], DOCS), ratios).collect() == []


def test_random_texts(spark):
    r = rng(6)
    texts = ["".join(r.choice(["a", "b", "c", "\n", " ", " ", "#", "\t", "dd"]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    for x in q.base_rules(docs_of(spark, texts)).collect():
        assert got(x) == base(texts[x.doc_id])


def test_main_path_is_native(spark):
    plan = q.op9_quality_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
