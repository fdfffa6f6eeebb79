import ast
from pathlib import Path

import sluice

TOP = Path(sluice.__file__).parent


def test_the_library_does_not_import_the_training_data_subpackage():
    for path in TOP.rglob("*.py"):
        if "llm" in path.relative_to(TOP).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import | ast.ImportFrom) else []
            module = getattr(node, "module", None) or ""
            assert "llm" not in module.split(".") and not any("llm" in n.split(".") for n in names), path


def test_functions_do_not_depend_on_operators():
    for path in (TOP / "functions").glob("*.py"):
        assert "operators" not in path.read_text()


def test_every_query_with_sql_is_registered():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
