"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.session import materialize

c = F.col


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for each node of the links ``a, b``: the smallest node that it reaches.

    Each round gives a node the smallest label among its neighbours and then the label of its label, so
    paths halve; a round is written to the shared folder, and the last one changes nothing.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(c("b").alias("a"), c("a").alias("b"))))
    both = materialize(links.where("a <> b").select(ways.alias("way")).select("way.*").distinct(), "links")
    labels = materialize(
        both.groupBy(c("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels.select(c("node").alias("b"), "label"), "b").groupBy(c("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", c("label").alias("before"), F.least("label", "near").alias("label"))
        above = labels.select(c("node").alias("label"), c("label").alias("above"))
        jumped = moved.join(above, "label", "left").select("node", "before", F.least("label", "above").alias("label"))
        labels = materialize(jumped, "labels")
        if labels.where("label < before").isEmpty():
            return labels.select("node", c("label").alias("component"))
        labels = labels.select("node", "label")
