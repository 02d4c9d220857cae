"""Every query that SQL expresses, side by side with it over the small tables; the others give rows."""

from __future__ import annotations

import pytest

from wayfield.plans import registry

from .oracle import TESTDATA, difference

SMALL = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, registry.QUERIES[name], registry.SQL[name], SMALL) == ""


@pytest.mark.parametrize("name", ["gra3_biconnected_blocks", "gra8_task_graphs", "mdp2_committor", "mdp13_matched_controls", "agg38_dynamics", "joi3_library_similarity", "key17_parsed_responses"])
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_nested_logistic_needs_ten_observations(spark):
    """Five tasks and models of the smallest tables are too few for a fit; ten times as many are enough."""
    assert registry.QUERIES["sta6_nested_logistic"](spark, SMALL).count() == 0
    assert [r.model for r in registry.QUERIES["sta6_nested_logistic"](spark, f"{TESTDATA}/sf0.01").collect()] == ["benchmarks", "models", "measures"]


def test_flagship_is_what_the_driver_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["model_id", "event", "supply", "n_tasks"]
    by = {}
    for r in df.collect():
        by[r.event] = by.get(r.event, 0) + r.supply
    assert all(abs(v) < 1e-4 for v in by.values())  # every model is in every task
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "wayfield", tmp_path / "wayfield", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL)), "False"], said.stderr
