"""Closures and components of edge tables, by loops of DataFrames.

Each round cuts the lineage with checkpoint() in the folder that the cluster shares.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file:///tmp/checkpoints")
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """A table that several parts of a plan read, written once to the folder that the cluster shares: columns, compressed."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = posixpath.join(folder or "file:///tmp/checkpoints", f"kept-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importers(edges: DataFrame) -> DataFrame:
    """(to_module, importers): who imports a module, itself left out."""
    return edges.where("from_module <> to_module").groupBy("to_module").agg(F.array_sort(F.collect_set("from_module")).alias("importers"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): nodes that the start nodes reach over edges (a, b), with the length of the shortest way. Semi-naive:
    each round follows only the nodes that the last one found."""
    edges = checkpointed(edges.select("a", "b").distinct())
    known = checkpointed(start.select("node").distinct().withColumn("depth", F.lit(0)))
    fresh, depth = known, 0
    while True:
        depth += 1
        fresh = checkpointed(fresh.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if fresh.isEmpty():
            return known
        known = checkpointed(known.unionByName(fresh))


def blast_radius(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(module, depth): modules with changed files, and all that import them, directly or not."""
    backwards = edges.where("from_module <> to_module").select(F.col("to_module").alias("a"), F.col("from_module").alias("b"))
    found = reachable(backwards, changed.select(F.col("module").alias("node")))
    return found.select(F.col("node").alias("module"), "depth")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose ends both have a way in and a way out: all that cycles can be made of."""
    edges = checkpointed(edges.where("a <> b").select("a", "b").distinct())
    n = edges.count()
    while n:
        inner = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges = checkpointed(inner.select("a", "b"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The least label that reaches each node over edges (a, b). labels: (node, label)."""
    while True:
        heard = edges.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        new = checkpointed(labels.join(heard, "node", "left").select("node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their least node. Colouring:
    the least name that reaches a node colours it; nodes of a colour that reach the name's node back are its component.
    Work is linear in the edges for each round; pairs of nodes are never made."""
    edges = trimmed(edges)
    done: DataFrame | None = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        colours = spread(checkpointed(nodes.withColumn("label", F.col("node"))), edges)
        # backwards from each root, inside its colour
        ends = colours.withColumnRenamed("node", "a").withColumnRenamed("label", "colour_a").join(edges, "a").join(colours.withColumnRenamed("node", "b").withColumnRenamed("label", "colour_b"), "b")
        inside = checkpointed(ends.where("colour_a = colour_b").select("a", "b", F.col("colour_a").alias("colour")))
        known = checkpointed(colours.where("node = label").select("node", F.col("label").alias("component")))
        fresh = known
        while True:
            fresh = checkpointed(inside.join(fresh, (F.col("b") == F.col("node")) & (F.col("colour") == F.col("component"))).select(F.col("a").alias("node"), "component").distinct().join(known, "node", "left_anti"))
            if fresh.isEmpty():
                break
            known = checkpointed(known.unionByName(fresh))
        found = known.join(known.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component").select("node", "component")
        done = found if done is None else done.unionByName(found)
        gone = known.select("node")
        edges = trimmed(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    if done is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return done


def cycles(found: DataFrame, owner: DataFrame) -> DataFrame:
    """(component, members, n_files, n_modules) of components; owner: (node, module), module null where none owns the file."""
    return found.join(owner, "node", "left").groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("node")), " -> ").alias("members"), F.count("*").alias("n_files"), F.count_distinct("module").alias("n_modules"))
