"""Every registered query against its SQL oracle on the smallest driver tables."""

from __future__ import annotations

import pytest

from catalog import registry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
# Legitimately without rows on the smallest tables.
MAY_BE_EMPTY = {"anomaly_report", "quick_filter", "filter_queue", "trends_issue"}


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_matches_oracle(spark, database, name):
    note = difference(registry.queries()[name](spark, SF_DIR), database, registry.oracles()[name])
    assert note is None or (note == "EMPTY" and name in MAY_BE_EMPTY), note


def test_every_oracle_has_a_query():
    assert registry.oracles().keys() <= registry.queries().keys()
