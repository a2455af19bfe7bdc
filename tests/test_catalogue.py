"""Every registered query of the base engine against DuckDB."""

import pytest

from tessera.plans import catalogue
from tests.oracle import compare

import tessera.plans.dialect_queries  # noqa: F401, E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_oracle(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
