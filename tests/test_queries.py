"""Every registered query against its check SQL on the smallest data."""

import os

import pytest
from check import compare

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


# Queries of the corpus package without check SQL are covered by its own tests.
NAMED = [q for q in entry_points.queries() if q in entry_points.oracle_sql()]


@pytest.mark.parametrize("name", NAMED)
def test_query(spark, name):
    assert compare(spark, FOLDER, [name]) == 0


def test_entry(spark):
    out = entry_points.entry(spark)
    assert "file_name" in out.columns and out.count() > 0


def test_contract():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries)
    # Trained models, SimHash, pieces and seeded clusters are tested against brute force instead, personal data and pages by their rules.
    assert set(queries) - set(oracle) <= {"pipeline", "seeded_clusters"} | {q for q in queries if q.startswith("op")}
