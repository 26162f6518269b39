"""Connected components of a link table, by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import staged


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) -> (node, root): every node that has a link, with the smallest node it reaches.

    Each round is written to the shared folder, so a lost executor costs one round at most. Links stay in
    the cluster; the driver sees a count and a checksum per round. Self-links and repeated links are ignored;
    rows with a null end are ignored; an empty table gives an empty one."""
    links = staged(_tidy(links.where("a <> b")), "links")
    before = None
    while True:
        links = staged(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Links every node's larger neighbours to the smallest node next to it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _tidy(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Links every node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    up = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(up.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b"))
