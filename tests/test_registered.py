"""Every registered query against its SQL on the smallest tables."""

import re

import check_oracle
import pytest

import __spark_entry__ as entry
from worktrail.catalog import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()  # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message = check_oracle.compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_inventory():
    """Every operator of the blueprint has a query or a test named here."""
    elsewhere = {"r6", "u1", "u3"}  # late data and dialects: tests; claims: j21
    have = {re.sub(r"^([a-z])0?(\d+).*", r"\1\2", n) for n in QUERIES}
    want = {f"{p}{i}" for p, n in (("s", 15), ("f", 12), ("j", 24), ("a", 41), ("t", 9), ("w", 7), ("r", 6), ("u", 3)) for i in range(1, n + 1)}
    want |= {f"c{i}" for i in (1, 2, 3, 4, 5, 6, 8, 9, 11, 12)}
    assert want - have - elsewhere == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
