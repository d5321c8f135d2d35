"""The driver's entry points."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import __spark_entry__ as entry  # noqa: E402

from ruleframe import queries  # noqa: E402


def test_absent_modules_are_left_out_and_broken_ones_are_not(tmp_path, monkeypatch):
    (tmp_path / "brokenpart").mkdir()
    (tmp_path / "brokenpart" / "__init__.py").write_text("")
    (tmp_path / "brokenpart" / "lacking.py").write_text("import surely_not_installed\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._module("brokenpart.nothing") is None
    assert entry._module("no_such_package.queries") is None
    with pytest.raises(ModuleNotFoundError, match="surely_not_installed"):
        entry._module("brokenpart.lacking")


def test_every_rule_query_is_registered_with_sql():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
