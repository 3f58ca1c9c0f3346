"""The package works with and without its corpus subpackage."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_sql_twins_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "spheretiles").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path
