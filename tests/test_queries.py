"""Every registered query of the reference's operators against its SQL, over whole small tables."""

import oracle
import pytest

import __spark_entry__ as entry
from filigree.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert oracle.compare(QUERIES[name](spark, sf), con, SQL[name]) == ""


#: The given pages hold no HTML tables; the queries named s*_order_* read tables that Spark writes of the orders.
WITHOUT_TABLES = {"s7_cells", "s8_header_paths", "s9_promoted_labels", "s11_key_value_facts"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert (QUERIES[name](spark, sf).count() > 0) == (name not in WITHOUT_TABLES)


def test_every_query_is_tested(request):
    """What the entry registers is what runs above, but for the queries of the subpackage, which tests/llm runs."""
    names = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    assert names == set(QUERIES) and set(SQL) <= names
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
