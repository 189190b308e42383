import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare  # noqa: E402

from palimpsest.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name]) > 0
