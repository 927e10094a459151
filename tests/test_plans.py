"""Every query of the library over the smallest tables, against its SQL where it has one."""

import pytest
from compare import assert_same
from conftest import SMALL

from glossarium.plans import all_plans


@pytest.mark.parametrize("plan", all_plans(), ids=lambda p: p.name)
def test_plan(spark, plan):
    df = plan.run(spark, SMALL)
    if plan.oracle:
        assert_same(df, plan.oracle, SMALL)
    else:
        assert df.columns and df.count() > 0  # what they hold is checked in test_independent.py
