"""Connected components of links in a table, by hooking to the least neighbour and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsqc.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Per linked id: id, component (the least id that links reach). links has the long columns a and b.

    Links stay in a table; each round is an aggregation and two joins, and the number of rounds is about the logarithm of
    the longest path. No links: no rows.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "label")
    while True:
        # Least label among neighbours, told to the own root as well, so that whole trees hook.
        edge = both.join(label, both.a == label.id).select("a", "b", F.col("component").alias("ca"))
        other = label.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        seen = edge.join(other, "b").filter("cb < ca")
        hooks = seen.select(F.col("ca").alias("id"), F.col("cb").alias("c")).union(seen.select(F.col("a").alias("id"), F.col("cb").alias("c"))).groupBy("id").agg(F.min("c").alias("c"))
        hooks = stored(hooks, "hooks")
        if hooks.isEmpty():
            return label
        hooked = stored(label.join(hooks, "id", "left").select("id", F.coalesce(F.least("component", "c"), "component").alias("component")), "hooked")
        for _ in range(2):
            up = hooked.select(F.col("id").alias("component"), F.col("component").alias("up"))
            hooked = hooked.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        label = stored(hooked, "label")
