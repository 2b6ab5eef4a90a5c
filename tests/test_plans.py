"""No registered query plans a cartesian product or a nested-loop join."""

import contextlib
import io

import pytest

from tillroll.plans.registry import load_all

SF = "/root/testdata/sf0.001"
QUERIES = load_all()[0]
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_or_nested_loop_join(spark, name):
    df = QUERIES[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    plan = buf.getvalue()
    assert not any(op in plan for op in FORBIDDEN), plan
