"""The driver contract, with and without the optional operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["l_returnflag", "l_linestatus"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def alone(folder, code: str, **copy) -> str:
    """Output of some code run in a copy of the repository."""
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", *copy.get("without", ())))
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stdout[-2000:] + run.stderr[-2000:]
    return run.stdout


COUNT = "import __spark_entry__ as e; assert not e.HAS_LLM and not e.HAS_PIPELINE and not any(k[:2] == 'op' or k == 'pipeline' for k in e.queries()); e.oracle_sql(); print(len(e.queries()))"


@pytest.mark.parametrize("without", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_without_optional_operators(tmp_path, without):
    assert int(alone(tmp_path / "repo", COUNT, without=without)) > 100


def test_without_a_module_that_optional_operators_need(tmp_path):
    for name in ("xxhash", "zstandard"):
        code = f"import sys; sys.modules[{name!r}] = None; {COUNT}"
        assert int(alone(tmp_path / name, code)) > 100


def test_the_rest_passes_without_optional_operators(tmp_path):
    """Some of the other tests, run in a copy that lacks the two folders and nothing else."""
    code = "import pytest, sys; sys.exit(pytest.main(['tests', '-q', '-x', '-k', 'test_entry and (oracles or imports) or test_explain or test_parser or test_random_changes or scan_ or join_inner']))"
    assert "passed" in alone(tmp_path / "repo", code, without=("llm",))


def test_nothing_else_imports_the_optional_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "tessera")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "tessera.llm" not in f.read(), name
