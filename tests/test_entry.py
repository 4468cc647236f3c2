import subprocess
import sys
import types
from importlib.abc import MetaPathFinder
from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_registry_is_consistent(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "impact_reasons" in sql
    assert all(callable(q) for q in queries.values())


def test_only_a_missing_module_is_forgiven(tmp_path, monkeypatch):
    assert entry.optional("rippletrace.not_there.queries") is None
    (tmp_path / "broken_module.py").write_text("import surely_missing_dependency\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry.optional("broken_module")
    assert isinstance(entry.optional("json"), types.ModuleType) and "json" in sys.modules


class Hidden(MetaPathFinder):
    """Makes the subpackage of training-data operators look deleted."""

    def find_spec(self, fullname, path=None, target=None):
        if fullname == entry.OPTIONAL or fullname.startswith(entry.OPTIONAL + "."):
            raise ModuleNotFoundError(f"No module named {fullname!r}", name=entry.OPTIONAL)
        return None


def test_registry_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith(entry.OPTIONAL)]:
        monkeypatch.delitem(sys.modules, name)
    import rippletrace

    monkeypatch.delattr(rippletrace, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "impact_reasons" in queries and "impact_reasons" in sql
    assert "pipeline" not in queries and not [q for q in [*queries, *sql] if q.startswith("op1")]


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; e.queries(), e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(entry.__file__).parent, check=True, timeout=120)
