"""Every query runs and equals its DuckDB equivalent; the inventory is covered."""

from __future__ import annotations

import pytest

from millrace.catalog import FLAGSHIP, ORACLES, QUERIES
from millrace.registry import covered_ids
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(name, spark, sf, duck):
    assert_same(QUERIES[name](spark, sf), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


#: Ids of the inventory that no query can show here: they need a service, a connector or a library that is not there.
OUTSIDE = {"UDF-10", "SUP-8", "SUP-16", "SUP-17", "SRC-10", "SRC-12", "SRC-13", "SRC-14", "SRC-21", "SRC-22"}


def test_inventory_is_covered():
    wanted = {f"{group}-{n}" for group, last in {"PRJ": 9, "FLT": 18, "JOIN": 22, "AGG": 31, "WIN": 8, "TOP": 11, "SET": 5, "TXT": 15, "ML": 6, "SRC": 28, "SNK": 20, "STR": 20, "UDF": 10, "DQ": 13, "SUP": 17}.items() for n in range(1, last + 1)}
    assert wanted - covered_ids() - OUTSIDE == {"DQ-11"}  # given/expect rows: the tests themselves
