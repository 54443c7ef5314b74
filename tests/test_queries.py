"""Every query of the engine against its SQL."""

from __future__ import annotations

from collections import Counter

import pytest

from setloom.queries import ORACLES, QUERIES

from .oracle import TABLES, both

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert ours == theirs


def test_random_rows_are_bounded_and_repeat(spark):
    one, two = (sorted(map(tuple, QUERIES["sample_rows_random"](spark, str(TABLES)).collect())) for _ in range(2))
    assert one == two and one and max(Counter(r[0] for r in one).values()) <= 3


def test_words_are_extracted_once(spark):
    """The documents are read to write the index, and not again to ask it."""
    plan = QUERIES["metric_jaccard"](spark, str(TABLES))._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan
