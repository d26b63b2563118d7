"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: A vertex with more links than this part of them all, and than LEAST_HUB, is a hub; there are fewer than HUB_PART of them.
HUB_PART, LEAST_HUB = 2000, 5000
#: Links that a task handles at least.
TASK_LINKS = 200_000


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _met(rows: DataFrame, least: DataFrame, hubs: DataFrame) -> DataFrame:
    """rows (u, v) with m of least (u, m). Rows of a hub are dealt by v into as many parts as it has, which hubs (u, parts) tells."""
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(F.broadcast(hubs), "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), parts))
    least = least.join(F.broadcast(hubs), "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return rows.drop("parts").join(least.drop("parts"), ["u", "part"])


def _round(links: DataFrame, hubs: DataFrame | None, tasks: int) -> DataFrame:
    """A large-star and a small-star step."""
    both = _both(links).coalesce(tasks)
    both = both.repartition("u") if hubs is None else both  # without hubs, one exchange serves the minimum and its join
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    above = both.filter(F.col("v") > F.col("u"))
    large = (above.join(least, "u") if hubs is None else _met(above, least, hubs)).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.coalesce(tasks).repartition("u") if hubs is None else large.coalesce(tasks)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u") if hubs is None else _met(large, least, hubs)
    small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
    return small.unionByName(least.withColumnRenamed("m", "v")).coalesce(tasks).distinct().coalesce(tasks)


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """(id, component) for every id that occurs in a link; component is the least id that links lead to.

    Links join src and dst in both directions; null ends and loops between an id and itself are left out, repeated
    links count once. Large-star and small-star rounds (Kiveris et al. 2014) shrink every component to a star around
    its least id, in a number of rounds that grows with the logarithm of the longest path. They end when the links are
    stars: every vertex has either larger neighbours only, or one smaller neighbour and no other. The minimum of a
    vertex's neighbours is a partial aggregate that is joined back to its links; those of hubs are dealt over tasks.
    """
    edge = F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    links = written(links.filter(edge).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    n = F.col("n")
    # Few links in many partitions would write a file for each pair of them in every exchange.
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // TASK_LINKS))
    links = links.coalesce(tasks)
    for _ in range(most_rounds):
        degrees = _both(links).coalesce(tasks).groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("least"))
        row = degrees.agg(F.max((F.col("least") < F.col("u")) & (n > 1)), F.max("n"), F.sum("n")).first()
        if not row[0]:
            break
        hubs, most = None, max(LEAST_HUB, row[2] // HUB_PART)
        if row[1] > most:
            hubs = written(degrees.filter(n > most).select("u", F.ceil(n / most).cast("long").alias("parts")))
        links = written(_round(links, hubs, tasks), links)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
