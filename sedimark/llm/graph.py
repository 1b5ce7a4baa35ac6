"""Connected components by distributed label propagation with pointer jumping.

Edge cases: repeated links and links of a node with itself change nothing; a link with a null end is left out;
an empty table has no nodes; columns other than a and b are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import cut, release


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the least node reachable.

    Each round takes the least label among neighbours, then the label of that label; every round is
    written to the shared folder, so lineage stays short.  Neither links nor labels reach the driver.
    """
    both = links.select("a", "b").where("a <> b").union(links.selectExpr("b", "a").where("a <> b")).distinct()
    both = cut(both, f"{label}-links")
    state = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{label}-0")
    step = 0
    while True:
        step += 1
        near = both.join(state, both.b == state.node).groupBy("a").agg(F.min("root").alias("least"))
        moved = state.join(near, state.node == near.a).select("node", F.least("root", "least").alias("up"), F.col("root").alias("was"))
        jump = state.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = cut(moved.join(jump, "up", "left").select("node", F.least("up", "top").alias("root"), "was"), f"{label}-{step}")
        release(state)
        changed = new.where("root <> was").limit(1).count()
        state = new
        if not changed:
            release(both)
            return state.select("node", "root")
