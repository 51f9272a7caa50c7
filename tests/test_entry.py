"""The driver contract, with and without the removable subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80 and len(o) >= 60


WITHOUT = "import __spark_entry__ as e; q = e.queries(); assert 'trust_score' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"


def copied(tmp_path, *left_out):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    return copy


def ran(copy, *command):
    """Runs Python in the copy: the search path is the given one without this repository."""
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    return subprocess.run([sys.executable, *command], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(path)})


#: A quick test of each module, without the removable folders.
ONE_EACH = [
    "tests/test_functions.py::test_changes", "tests/test_operators.py::test_graph", "tests/test_operators.py::test_run_lengths", "tests/test_sources_and_plans.py::test_config", "tests/test_sources_and_plans.py::test_loaders",
    "tests/test_effect_intervals.py::test_state_effect_sizes_by_subject", "tests/test_production_parameters.py::test_learned_weights_rows", "tests/test_entry.py::test_names",
]


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_works_without_the_removable_subpackage(tmp_path, left_out):
    copy = copied(tmp_path, *left_out)
    out = ran(copy, "-c", WITHOUT)
    assert out.returncode == 0, out.stderr
    out = ran(copy, "-m", "pytest", "--collect-only", "-q", "tests")
    assert out.returncode == 0, out.stdout
    out = ran(copy, "-m", "pytest", "-q", "-x", *ONE_EACH)
    assert out.returncode == 0, out.stdout


def test_works_where_the_subpackage_cannot_be_imported(tmp_path):
    out = ran(copied(tmp_path), "-c", "import sys; sys.modules['xxhash'] = None; " + WITHOUT)
    assert out.returncode == 0, out.stderr


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "overall" in df.columns
