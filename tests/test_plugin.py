"""Extractors in Python, from SQL and beside native detectors."""

import pytest
from pyspark.errors import PySparkException

from quillon.functions.plugin import extract_by, extractor
from quillon.operators.extract import extract
from quillon.sources.tables import corpus

CHUNKS = [("a", "d", "prose", "One! Two! It defines two special methods.\n"), ("b", "d", "code", "none"), ("c", "d", None, "!"), ("e", "d", "prose", None)]


def shouts(text, kind):
    n = text.count("!")
    return [{"value": n or None, "source_type": "author_anchor", "evidence": f"{kind}:{n}", "items": ["!"] * n}, {"value": 0, "source_type": "code_literal"}][: 1 + (n > 1)]


def test_from_sql(spark):
    corpus(spark, "c", CHUNKS).createOrReplaceTempView("plugin_chunks")
    spark.udtf.register("shouts", extractor(shouts))
    got = spark.sql("SELECT c.chunk_id, x.* FROM plugin_chunks c, LATERAL shouts(c.text, c.kind) x ORDER BY c.chunk_id, nth").collect()
    assert [tuple(r) for r in got] == [("a", 0, 2, "author_anchor", None, "prose:2", ["!", "!"]), ("a", 1, 0, "code_literal", None, None, None), ("c", 0, 1, "author_anchor", None, "prose:1", ["!"])]
    with pytest.raises(PySparkException, match="text is no string"):
        spark.sql("SELECT * FROM shouts(1, 'prose')").collect()


def test_beside_the_native_set(spark):
    chunks = corpus(spark, "c", CHUNKS)
    native, own = extract(chunks, "base"), extract_by(chunks, extractor(shouts), 3)
    both = native.unionByName(own.select(*native.columns)).orderBy("chunk_id", "pos", "value").collect()
    assert [(r.chunk_id, r.pos, r.value) for r in both] == [("a", 0, 2), ("a", 3, 0), ("a", 3, 2), ("c", 3, 1)]


def test_extractors_get_batches_not_rows(spark):
    own = extract_by(corpus(spark, "c", CHUNKS), extractor(shouts), 3)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "UDTF" not in plan
    assert sorted((r.chunk_id, r.value, r["items"]) for r in own.collect()) == [("a", 0, None), ("a", 2, ["!", "!"]), ("c", 1, ["!"])]


def test_unknown_fields_are_an_error(spark):
    chunks = corpus(spark, "c", CHUNKS[:1])
    with pytest.raises(PySparkException, match="a claim has no colour"):
        extract_by(chunks, extractor(lambda text, kind: [{"value": 1, "colour": "red"}]), 0).collect()


