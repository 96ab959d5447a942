"""Every query that has SQL beside it, on the smallest tables, and that the others give rows."""

import pytest
from run_oracle import compare, connect

from loomgraph.plans import QUERIES, SQL

SLOW = {"link_prediction_eval", "gmm_assign", "dpmm_assign", "node2vec_embed", "node_classification_eval"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in SLOW])
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
