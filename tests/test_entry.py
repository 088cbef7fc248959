import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_package():
    for path in (ROOT / "deskloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT / "deskloom").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "episode_id", "score", "rank"] and df.count() > 0
