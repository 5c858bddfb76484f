"""The engine without the language-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = """
import sys
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert q and set(o) <= set(q)
assert not [k for k in q if k.startswith("op") and k[2].isdigit() or k == "pipeline"], sorted(q)
assert not [m for m in sys.modules if m.startswith("weftgraph.llm") or m == "corpus_pipeline"]
"""


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_rest_stands_without_llm(tmp_path, pipeline_stays):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("weftgraph/llm", "tests/llm"):
        shutil.rmtree(tree / folder, ignore_errors=True)
    if not pipeline_stays:
        (tree / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=tree, env=os.environ | {"PYTHONPATH": str(tree)}, check=True)


def test_nothing_else_imports_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "weftgraph")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert "weftgraph.llm" not in text, name
