"""Ends that no node has: tasks by the number of rows, whatever the session's shuffles."""

from mnemoscope import plans
from mnemoscope.plans import graph_facts

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    few = plans.QUERIES["grf_validation"](spark, SF)
    rows = graph_facts.edges(spark, SF).count() + graph_facts.nodes(spark, SF).count()
    monkeypatch.setattr(graph_facts, "_TASK_ROWS", rows // 8)
    many = plans.QUERIES["grf_validation"](spark, SF)
    assert many.rdd.getNumPartitions() >= 8 > few.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(few.collect()) != []
