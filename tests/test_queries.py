"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__
from archloom.plans.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    db = connect(SF)
    assert differences(spark, db, QUERIES[name], ORACLES[name], SF) == ""
    assert db.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0  # a row on both sides at least


def test_streams_give_the_same_again(spark):
    got = [QUERIES["stream_requests_tail"](spark, SF).count() for _ in range(3)]
    assert len(set(got)) == 1 and got[0] > 0
