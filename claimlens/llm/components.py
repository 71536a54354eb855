"""Connected components of a link table, without leaving Spark."""

from pyspark.sql import functions as F

from claimlens.session import write_once

from .work import folder


def components(links, src="a", dst="b", rounds=60):
    """``(node, component)``: the smallest node reachable from every linked node.

    Alternating large-star and small-star steps. A node's smallest neighbour is a
    plain aggregate (map-side combine), so a node with very many links is no hot
    group; each step is written to the shared folder, so lineage stays short and a
    lost executor costs one step. Null ends and self links are ignored; repeated
    links count once; no links give an empty frame.
    """
    spark = links.sparkSession
    e = (links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
         .filter("u > v").distinct())
    e = write_once(e, folder(spark, "cc"))
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u > v").distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = (large.join(small_low, "u")
             .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                       F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
             .select("x.*").filter("u > v").distinct())
        e = write_once(e, folder(spark, "cc"))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
