"""Connected components of links that stay in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over ``links`` (``a, b``), for every id that has a link.

    Rounds of pointing to the smallest neighbour and then to that one's own pointer, until nothing
    changes. Each round is a table in the shared folder; the driver sees one count a round.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).select(F.col("a").alias("id"), "component"), "labels")
    while True:
        near = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        ahead = label.select(F.col("id").alias("component"), F.col("component").alias("ahead"))
        step = step.join(ahead, "component", "left").select("id", "old", F.coalesce("ahead", "component").alias("component"))
        done = materialize(step, "labels")
        label = done.select("id", "component")
        if done.where("component <> old").isEmpty():
            return label
