"""The driver's contract, with and without the optional package."""

import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())


def test_works_without_the_optional_package(tmp_path):
    for name in ("__spark_entry__.py", "millrace"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(source) else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q01' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 80


def test_nothing_else_imports_the_optional_package():
    for folder, _, names in os.walk(os.path.join(ROOT, "millrace")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", f.read(), re.M), n
