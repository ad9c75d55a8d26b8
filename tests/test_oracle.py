"""Registered queries run and agree with their SQL: the headline ones by default, all of them with GRIDLOOM_ALL=1.

``python tests/compare.py`` runs all of them at another scale and prints times.
"""

import os

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

from bench import HEADLINE

DIR = f"/root/testdata/sf{os.environ.get('GRIDLOOM_SF', '0.001')}"
RUN, SQL = queries(), oracle_sql()
if not os.environ.get("GRIDLOOM_ALL"):
    RUN = {k: v for k, v in RUN.items() if k in HEADLINE}
    SQL = {k: v for k, v in SQL.items() if k in HEADLINE}


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(RUN[name](spark, DIR), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_runs(spark, name):
    assert RUN[name](spark, DIR).count() >= 0


def test_entry(spark):
    assert entry(spark).count() == 3
