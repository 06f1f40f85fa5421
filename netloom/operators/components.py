"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..runtime import discard, stored


def _written(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The links as a table, with their number and a sum over them that tells when they stay."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 24)).alias("x")), "links")
    got = seen.get
    return out, (got["n"], got["x"] or 0)


def components(links: DataFrame) -> DataFrame:
    """links: ``u, v`` of one type, in any direction, repeats allowed.

    Returns ``node, root`` for every node that has a link to another node; ``root`` is the
    smallest node of its component. Nulls and self-links are left out. The number of rounds grows
    with the logarithm of the component size; every round is a written table, so neither links
    nor components reach the driver.
    """
    edges, mark = _written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")), F.struct("u", F.col("low").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        old, was = edges, mark
        edges, mark = _written(small)
        discard(old)
        if mark == was:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
