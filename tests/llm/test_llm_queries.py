"""The subpackage's queries run over the smallest tables and equal their SQL where there is some."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, same  # noqa: E402

from siltstone.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, data, name):
    same(registry.queries()[name](spark, data), connect(data), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
