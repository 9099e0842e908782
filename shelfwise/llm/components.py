"""Connected components of a link table by minimum labels and pointer jumping, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.session import drop_scratch, materialize


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> (v long, comp long): every vertex of a link and the least vertex it can reach.

    Each turn takes the least label among a vertex and its neighbours, then jumps to that label's own label, so long
    chains shrink geometrically. Labels are Parquet in the shared folder between turns; only a count reaches the driver.
    Links may repeat, loops are allowed, an empty table gives an empty result."""
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.v == near.a, "left").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("v").alias("w"), F.col("comp").alias("far"))
        moved = step.join(up, step.comp == up.w, "left").select("v", "old", F.least("comp", "far").alias("comp"))
        new = materialize(moved, "labels")
        changed = new.filter("comp <> old").limit(1).count()
        drop_scratch(labels)
        labels = new.select("v", "comp")
        labels._scratch_path = new._scratch_path
        if not changed:
            drop_scratch(both)
            return labels
