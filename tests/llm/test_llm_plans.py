"""Plans of the operators on training text: no cross joins, no work that grows on one task."""

import pytest

from folioscope.llm import queries
from folioscope.session import ship


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cross_joins_but_of_one_row(spark, sf, name):
    """A nested-loop join is one with the one-row totals of the sources' shares, which p9 broadcasts."""
    ship(spark)
    p = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name in ("p9_mix", "p9_shares")


def test_survivors_have_few_exchanges(spark, sf):
    p = queries.QUERIES["p7_found"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange") <= 8
