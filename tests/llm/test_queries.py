"""Every query that has SQL against it, on the small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import gate

from sightline.llm import queries


@pytest.fixture(scope="module")
def con(small):
    return gate.duck(small)


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_query_equals_sql(spark, small, con, name):
    assert gate.compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], small, con) is None
