"""Connected components of a table of links, by smallest labels and pointer jumping.

``components`` takes any links. Where links come in rounds, ``roots`` labels a forest, and
``merged`` adds links to labels: only those between different labels count, so the graph it
works on gets small. Its two steps are ``moves``, which labels change, and ``with_moves``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableset.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``links``: columns ``a`` and ``b``. Returns ``node``, ``label`` (smallest node reachable) of all linked nodes.

    Every round takes the smallest label among neighbours, then the label of that label, so
    the number of rounds grows with the logarithm of a component's length. Labels stay in
    tables; only the number of changed ones comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("b")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("next"))
        labels = lower.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "next").alias("label"))
        labels = stored(labels.select("node", "label", (F.col("label") != F.col("old")).alias("changed")), "labels")
        if labels.filter("changed").isEmpty():
            return labels.select("node", "label")


def roots(parents: DataFrame) -> DataFrame:
    """``parents``: ``node`` and its only ``parent``, a smaller one. Returns ``node`` and the ``label`` where its parents end."""
    labels = stored(parents.select("node", F.col("parent").alias("label")), "labels")
    while True:
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = labels.select("node", "label").join(up, F.col("label") == F.col("at"), "left")
        labels = stored(jumped.select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("changed")), "labels")
        if labels.filter("changed").isEmpty():
            return labels.select("node", "label")


def moves(labels: DataFrame, links: DataFrame) -> DataFrame | None:
    """Labels that ``links`` (``a``, ``b``) join, each as ``label`` with the ``least`` of those it is joined with; None if
    there are none. A node without a label is its own."""
    of = {x: labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "ab"}
    ends = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    ends = stored(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct(), "ends")
    if ends.isEmpty():
        return None
    return components(ends).select(F.col("node").alias("label"), F.col("label").alias("least"))


def with_moves(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """``labels`` after ``moves``."""
    # Labels are nodes themselves, also where no row says so.
    own = labels.union(changed.select("label", "label")).groupBy("node").agg(F.min("label").alias("label"))
    return stored(own.join(changed, "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after ``links`` (``a``, ``b``) are added to those that made ``labels``."""
    changed = moves(labels, links)
    return labels if changed is None else with_moves(labels, changed)
