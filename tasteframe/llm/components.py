"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """A written table: id and comp of every node of the links (a, b) but each component's least node, which is its
    comp. Repeated links, links in both directions and links of a node with itself count once or not at all; a link with
    a null end does not count.

    Each round links every node's larger neighbours, then its smaller ones, to the least of its neighbours; the number
    of rounds grows with the logarithm of the longest path. A round joins links with one row a node, so that a node
    with many neighbours can be split, and is written to the shared folder.
    """
    edges = links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("comp")).where("a is not null and b is not null and a != b").distinct()
    edges = written(edges, "links")
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("comp", "id"))
        least = both.groupBy("id").agg(F.min("comp").alias("m")).select("id", F.least("m", "id").alias("m"))
        large = both.where("comp > id").join(least, "id").select(F.col("comp").alias("id"), F.col("m").alias("comp")).where("id != comp").distinct()
        least = large.groupBy("id").agg(F.min("comp").alias("m"))
        small = large.join(least, "id").select(F.col("comp").alias("id"), F.col("m").alias("comp")).where("id != comp")
        last, edges = edges, written(small.union(least.select("id", "m")).distinct(), "links")
        discard(last)
        before, mark = mark, edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "comp").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges
    raise RuntimeError("links have not settled")
