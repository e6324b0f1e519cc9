from __future__ import annotations

import ast
import pathlib

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_names_agree():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_only_the_entry_knows_the_llm_folder():
    for path in (ROOT / "lekhya").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any(n.startswith("lekhya.llm") for n in names), path
