import __spark_entry__ as entry


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "project" in out.columns


def test_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_llm", None)
    monkeypatch.setattr(entry, "_pipeline", None)
    assert "transitions_rollup" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    assert "pipeline" not in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    import ast
    from pathlib import Path

    root = Path(entry.__file__).parent
    files = [p for p in [*(root / "strandline").rglob("*.py"), *(root / "tests").glob("*.py"), root / "bench.py"] if "llm" not in p.relative_to(root).parts]
    assert len(files) > 20
    for p in files:
        for node in ast.walk(ast.parse(p.read_text("utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("strandline.llm", "corpus_pipeline")) for n in names), p
