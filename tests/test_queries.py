"""A few registered queries against their SQL twins; tools/check_queries.py runs them all."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_DIR = "/root/testdata/sf0.001"


def load(path, name):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, path))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


check, entry = load("tools/check_queries.py", "check_queries"), load("__spark_entry__.py", "spark_entry")


@pytest.mark.parametrize("name", ["recognition_eval", "smooth_metrics", "mix_datasets", "keep_owned", "bigram_score"])
def test_same_rows(spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no driver tables here")
    state, note = check.compare(spark, check.connect(SF_DIR), name, SF_DIR)
    assert state == "ok", note


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
