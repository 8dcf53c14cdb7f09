
import os

import pytest

from docsmelt.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_task_recovery_filters_no_ids(spark):
    plan = queries.QUERIES["task_recovery"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "event_id" in line]
