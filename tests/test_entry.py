import ast
import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_queries_run(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and {"intake_outcomes", "consent_gated_projection", "retention"} <= names


def test_entry_works_without_the_llm_folder(tmp_path):
    for name in ("quillmesh", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillmesh" / "llm")], check=True)
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    from quillmesh.plans.queries import ORACLES, QUERIES

    assert found.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))] and set(QUERIES) == set(ORACLES), found.stderr


def test_nothing_outside_imports_the_llm_folder():
    for folder, _, files in os.walk(os.path.join(ROOT, "quillmesh")):
        for name in files:
            if name.endswith(".py") and "llm" not in folder.split(os.sep):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    tree = ast.parse(f.read())
                for node in ast.walk(tree):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(re.search(r"\bllm\b", n) for n in names)
