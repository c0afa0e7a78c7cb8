"""Steps of the star contraction: their results, and what they leave to the driver."""

from __future__ import annotations

from slatekit.llm.common import Scratch
from slatekit.llm.neardup import components

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def found(edges, scratch, name="t"):
    return {(r["node"], r["comp"]) for r in components(edges, scratch, name).collect()}


def test_components_of_chains_loops_and_nulls(spark):
    scratch = Scratch(spark, "components")
    edges = [(k, k + 1) for k in range(10, 40)] + [(3, 3), (7, 5), (5, 6), (None, 1), (2, None)]
    edges = spark.createDataFrame(edges, "a long, b long")
    assert found(edges, scratch) == {(k, 10) for k in range(10, 41)} | {(5, 5), (6, 5), (7, 5)}
    assert found(edges.where("a = 3"), scratch, "loop") == set()
    assert found(edges.limit(0), scratch, "none") == set()


def test_steps_broadcast_no_small_tables(spark):
    """Many short steps: none builds a relation on the driver unasked."""
    limits = []
    before = spark.conf.get(LIMIT)

    class Steps(Scratch):
        def write(self, df, name):
            limits.append(spark.conf.get(LIMIT))
            return super().write(df, name)

    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    components(edges, Steps(spark, "components"), "t")
    assert set(limits) == {"-1"} and spark.conf.get(LIMIT) == before
