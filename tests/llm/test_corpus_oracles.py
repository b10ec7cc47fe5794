from __future__ import annotations

import pytest

from casequeue.llm import catalog
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, database, name):
    assert difference(catalog.queries()[name](spark, SF_DIR), database, catalog.oracles()[name]) is None
