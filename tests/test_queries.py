"""Every registered query against its SQL, on the smallest tables."""

import ast
from pathlib import Path

import pytest

from quillon import catalog
from tests.conftest import ROOT, SF
from tests.oracle import assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_only_the_entry_knows_the_optional_part():
    for path in Path(ROOT, "quillon").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def test_batch_plans_run_no_python(spark):
    for name in ("answer_primary", "lifecycle_outcomes", "frame_loop", "present_recovery"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = catalog.QUERIES["deferred_present"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,view)" in plan and "props" not in plan


@pytest.mark.parametrize(("name", "scans"), [("total_reconcile", 2), ("evaluate_state", 2), ("tensions", 2), ("single_claim_path", 1), ("whole_state", 3), ("answer_primary", 3), ("state_dump", 3)])
def test_evidence_is_read_once(spark, name, scans):
    """Tables are scanned once for claims, and for questions and their answers where these are a table of their own."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and "NestedLoop" not in plan
