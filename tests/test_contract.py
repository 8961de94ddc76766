"""The driver contract: names, columns, and that nothing outside it needs the document subpackage."""

import ast
import os
import subprocess
import sys

import __spark_entry__ as entry
from dyadica.plans import catalog
from tests.conftest import ROOT


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows_and_stable_columns(spark):
    df = entry.entry(spark)
    assert df.columns == ["mother", "node", "l", "r", "len", "cnt", "frequency"] and df.count() > 0


def test_library_imports_nothing_of_the_document_subpackage():
    for top, _, names in os.walk(os.path.join(ROOT, "dyadica")):
        if os.path.basename(top) == "llm":
            continue
        for name in (n for n in names if n.endswith(".py")):
            with open(os.path.join(top, name)) as f:
                for node in ast.walk(ast.parse(f.read())):
                    modules = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(m.startswith(("dyadica.llm", "corpus_pipeline")) for m in modules), name


def test_contract_works_without_the_document_subpackage(tmp_path):
    import shutil

    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "dyadica"), tmp_path / "dyadica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, named = done.stdout.split()
    assert int(n) == len(catalog.QUERIES) and named == "False"
