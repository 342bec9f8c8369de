"""Connected components by alternating large-star and small-star steps, each a join and an aggregate.

Every round is written to the shared folder, so a lost executor repeats one round at most; the edges never reach the
driver. A node with many neighbours is a skewed join side of a stored table, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.sources.scratch import drop, save, save_counted, small

MAX_ROUNDS = 50
#: What a round's joins may broadcast, in rows and stored bytes: little, as each round sends two tables by way of the driver.
ROUND_ROWS, ROUND_BYTES = 50_000, 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it is linked with) for every node of an edge of ``edges`` (a, b). Null ends are ignored."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b")
    now, state = save_counted(ends.distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # large-star: neighbours above a node are tied to the smallest one around it
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
        large = both.join(small(least, ROUND_ROWS, ROUND_BYTES), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small-star: a node and its smaller neighbours are tied to the smallest of them
        low = save(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        ties = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        following, reached = save_counted(large.join(small(low, ROUND_ROWS, ROUND_BYTES), "u").select(F.inline(ties)).where("u != v").distinct(), "edges")
        for used in (now, least, low):
            drop(used)
        now = following
        if reached == state:
            break
        state = reached
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    found = save(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(now)
    return found
