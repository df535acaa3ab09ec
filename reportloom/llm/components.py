"""Connected components of a graph of links, without bringing links or labels to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.runtime import discard, materialize

# The alternating star steps end after a number of rounds that grows with the logarithm of the graph.
MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node of its component.

    Alternating large-star and small-star steps. Each step is an aggregate with partial sums, written to the shared
    folder, and an equi-join of two tables, so a node with very many links is pre-aggregated, and its links can be
    split over tasks, as nothing in the join's stage needs them together. Each round's links are written too, which
    cuts the lineage. Links of a node to itself and repeated links are
    allowed, null ends are dropped; no links give no rows.
    """
    links = links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct()
    links = materialize(links, "links")
    for _ in range(MOST_ROUNDS):
        large = _star(links, _large)
        after = _star(large, _small)
        same = _sums(after) == _sums(links)
        for table in (links, large):
            discard(table)
        links = after
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _sums(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _star(links: DataFrame, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The links after a step, written. The least neighbours are written before they are joined to the links."""
    ends, least = step(links)
    least = materialize(least, "least")
    out = materialize(ends.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct(), "links")
    discard(least)
    return out


def _large(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node sends its larger neighbours to the smallest of its neighbours and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.filter("v > u"), both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _small(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every node sends its smaller neighbours and itself to the smallest of them. In links a < b holds."""
    least = links.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    own = links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("b").alias("v")).distinct())
    return own, least
