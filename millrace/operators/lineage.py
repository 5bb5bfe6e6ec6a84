"""Checks on the graph of topics and the jobs that read and write them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from millrace.session import work_dir


def dead_ends(edges: DataFrame) -> DataFrame:
    """Topics written but never read. Edges: ``job, topic, direction`` ("read" or "write")."""
    written = edges.where("direction = 'write'").select("topic").distinct()
    return written.join(edges.where("direction = 'read'").select("topic"), "topic", "left_anti")


def shared_sources(edges: DataFrame) -> DataFrame:
    """Topics read by more than one job."""
    return (edges.where("direction = 'read'").groupBy("topic").agg(F.count_distinct("job").alias("readers"))
            .where("readers > 1"))


def job_edges(edges: DataFrame) -> DataFrame:
    """Edges as a directed graph ``src, dst`` of topics and jobs.

    Jobs stay nodes, so that a topic with many readers and writers does not turn into all their pairs.
    """
    job, topic = F.concat(F.lit("job:"), "job"), F.concat(F.lit("topic:"), "topic")
    read = F.col("direction") == "read"
    return edges.select(F.when(read, topic).otherwise(job).alias("src"), F.when(read, job).otherwise(topic).alias("dst"))


def _cut(df: DataFrame) -> DataFrame:
    """Write and read back: a cut of the lineage that also gives the true size.

    After ``checkpoint`` a join keeps its estimate, the product of its sides; round by round its digits double, until planning takes longer than the work.
    """
    path = work_dir(df.sparkSession, "lineage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chain_ends(edges: DataFrame) -> DataFrame:
    """``node, end`` of every node with one edge out: the first node along its only ways that has none or several, null if they never end.

    Pointers double: after k steps a node points 2^k edges ahead and knows the least of the nodes it passed, so a chain or cycle of n nodes takes
    log2(n) steps. Two stretches, one after the other, have the same least node only where the way goes round a cycle. An edge to null stands
    for one that is known to lead into a cycle.
    """
    one = _cut(edges.groupBy("src").agg(F.min("dst").alias("end"), F.count(F.lit(1)).alias("n")).where("n = 1")
               .select(F.col("src").alias("node"), "end", F.col("end").alias("low")))
    while True:
        ahead = one.select(F.col("node").alias("end"), F.col("end").alias("_next"), F.col("low").alias("_low"), F.lit(True).alias("_moves"))
        moved = _cut(one.join(ahead, "end", "left").select(
            "node", F.expr("CASE WHEN _moves IS NULL THEN end WHEN low != _low THEN _next END").alias("end"), F.least("low", "_low").alias("low"), "_moves"))
        if moved.where("_moves AND end IS NOT NULL").isEmpty():
            return moved.select("node", "end")
        one = moved.drop("_moves")


def endless(edges: DataFrame) -> DataFrame:
    """``node`` of every node from which ways lead on for ever, that is, into a cycle. Edges ``src, dst`` are distinct.

    A round gives each node with one way on the name of its chain's end, which shares its fate, so only nodes with several ways stay. Of these, one
    with a way back to itself or into a cycle is found and leaves the graph, and ways to nodes that lead nowhere are dropped. A round that changes
    nothing has met no node without a way on, so all that are left are endless.
    """
    found, chains, left = [], [], None
    while True:
        ends = chain_ends(edges)
        chains.append(ends)
        ahead = ends.select(F.col("node").alias("dst"), "end", F.lit(True).alias("_moves"))
        merged = (edges.join(ends.select(F.col("node").alias("src")), "src", "left_anti").join(ahead, "dst", "left")
                  .select("src", F.when(F.col("_moves"), F.col("end")).otherwise(F.col("dst")).alias("dst")).distinct())
        cyclic = F.max(F.col("dst").isNull() | (F.col("dst") == F.col("src"))).over(Window.partitionBy("src"))
        merged = _cut(merged.withColumn("cyclic", cyclic))
        fates = merged.select("src", "cyclic").distinct()
        found.append(fates.where("cyclic").select(F.col("src").alias("node")))
        edges = _cut(merged.where("NOT cyclic").select("src", "dst").join(fates.toDF("dst", "_cyclic"), "dst")
                     .select("src", F.expr("CASE WHEN NOT _cyclic THEN dst END").alias("dst")).distinct())
        was, left = left, edges.count()
        if left == was:
            found.append(edges.select(F.col("src").alias("node")).distinct())
        if left in (0, was):
            break
    found = _cut(reduce(DataFrame.unionByName, found))
    fate = chain_ends(reduce(DataFrame.unionByName, chains).toDF("src", "dst"))
    on_chains = fate.where("end IS NULL").select("node").unionByName(fate.join(found.toDF("end"), "end", "left_semi").select("node"))
    return found.unionByName(on_chains)


def cyclic_core(graph: DataFrame) -> DataFrame:
    """Edges that remain when nodes without a way in or a way out are removed again and again.

    Empty exactly if the graph has no cycle; otherwise the cycles and the paths between them: edges that come from a cycle and lead into one. Each of
    both is found for itself (``endless``), in rounds that grow with how often branches nest and not with the length of chains. Lineage is cut by
    files. Edges from or to null are left out.
    """
    edges = _cut(graph.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    onward = endless(edges).withColumnRenamed("node", "dst")
    back = endless(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("node", "src")
    return edges.join(onward, "dst", "left_semi").join(back, "src", "left_semi").select("src", "dst")
