"""Every registered query against its SQL; queries without SQL return rows."""

import pytest

import harness
from tapeframe.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return harness.oracle(sf)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf, name):
    query = registry.queries()[name]
    if name in SQL:
        assert harness.mismatch(spark, con, query, SQL[name], sf) == ""
    else:
        assert query(spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_contract_is_importable_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0], capture_output=True).returncode == 0
