import importlib.util

import pytest
from oracle import SF

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert len(entry.entry(spark).collect()) == 12


def test_every_query_has_a_function_and_sql_has_its_query():
    names = entry.queries()
    assert all(callable(f) for f in names.values())
    assert set(entry.oracle_sql()) <= set(names)
    assert SF


def test_training_data_operators_are_there_only_with_their_package():
    llm, pipeline = (importlib.util.find_spec(n) is not None for n in ("cellarium.llm", "corpus_pipeline"))
    found = {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    assert len(found) == 13 * llm + (llm and pipeline)


def test_a_missing_file_inside_the_package_is_an_error(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError(f"No module named '{missing}'", name=missing)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: object())
    missing = "tokenizers"
    assert entry._llm() is None
    missing = "cellarium.llm.words"
    with pytest.raises(ModuleNotFoundError):
        entry._llm()
