"""Every registered query agrees with its SQL on the smallest data."""

import pytest

from tallymark.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_oracle(spark, con, name):
    assert oracle.compare(spark, SF, name, con) == ""


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracles())
