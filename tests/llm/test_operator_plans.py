"""Plans of every table that an operator writes on its way."""

import re

import pytest

from airtoll.llm import queries
from tests.test_plans import written_plans

PYTHON = re.compile(r"Python|InPandas|InArrow|ArrowEval")


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n != "pipeline"))
def test_plans_on_the_way(spark, monkeypatch, name):
    for plan in written_plans(spark, monkeypatch, name):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
        if name.startswith(("op1_", "op4_")):
            assert not PYTHON.search(plan)
