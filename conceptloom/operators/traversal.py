"""Numbers of paths, and the first paths, without listing all that there are.

edges: child, parent (and pos, the parent's place among the child's parents; without it parents go by
name). A DAG with 2^40 paths has few nodes: paths are counted node by node and length by length,
and of the paths in order only those are built that the counts say are among the first.

In a graph with cycles a path may not pass a node twice. Nodes that no cycle is above have the same
paths whatever is below them: their first paths are built once, from the roots down, and shared by all codes.
Below a cycle each code's ways are followed by themselves until they reach such nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: The most nodes of a path and paths of a code, paths of a node where caps hold at every node, and expansions of a code.
MOST_NODES, MOST_PATHS, NODE_PATHS, FEW_NODE_PATHS, EXPANSIONS = 200, 2000, 1000, 100, 3000
_COUNT = "decimal(38,0)"


def _union(found: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found) if found else empty.limit(0)


def numbered(edges: DataFrame) -> DataFrame:
    """child, parent, pos: distinct edges, a child's parents numbered from 1 by pos, then name."""
    rows = edges.groupBy("child", "parent").agg(F.min("pos").alias("pos")) if "pos" in edges.columns else edges.select("child", "parent", F.lit(0).alias("pos")).distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("child").orderBy("pos", "parent")))


def roots(edges: DataFrame) -> DataFrame:
    """node: parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")


def path_counts(edges: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """node, length, n: numbers of paths of so many nodes from a root to each node of a DAG.

    One grouped join a length, from the roots down; longer paths than most_nodes are not counted.
    """
    links = cut_lineage(edges.select("child", "parent").distinct(), "links")
    now, found = roots(links).withColumn("n", F.lit(1).cast(_COUNT)), []
    for length in range(1, most_nodes + 1):
        now = cut_lineage(now.select("node", F.lit(length).alias("length"), "n"), "counts")
        if now.isEmpty():
            break
        found.append(now)
        now = now.join(links, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.sum("n").cast(_COUNT).alias("n"))
    return _union(found, now)


def counts_down(codes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """code, node, length, n: numbers of ways of so many nodes from a node down to a code."""
    links = cut_lineage(edges.select("child", "parent").distinct(), "links")
    known = links.select(F.col("child").alias("code")).union(links.select("parent"))
    now = codes.select("code").distinct().join(known, "code", "left_semi").select("code", F.col("code").alias("node"), F.lit(1).cast(_COUNT).alias("n"))
    found = []
    for length in range(1, most_nodes + 1):
        now = cut_lineage(now.select("code", "node", F.lit(length).alias("length"), "n"), "counts")
        if now.isEmpty():
            break
        found.append(now)
        now = now.join(links, F.col("node") == F.col("child")).groupBy("code", F.col("parent").alias("node")).agg(F.sum("n").cast(_COUNT).alias("n"))
    return _union(found, now)


def first_paths(codes: DataFrame, edges: DataFrame, paths_a_code: int = MOST_PATHS, most_nodes: int = MOST_NODES, root_first: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """code, rank, path: of each code's paths of most_nodes nodes or fewer the first, in a DAG; paths run from root to code.

    Paths go by the code's parents in order, then by their parents; with root_first by the names of their nodes
    from the root down. Longer paths are dropped before the first are taken. Each way is told how many paths it
    still owes; a step shares that out among the ways ahead by their counts, so what is built at any
    step is at most what is returned. counts: path_counts of the same edges, if they are at hand.
    """
    codes = codes.select("code").distinct()
    if root_first:
        counts = cut_lineage(counts_down(codes, edges, most_nodes), "down")
        links = edges.select("child", "parent").distinct()
        ahead = counts.join(links, counts["node"] == links["child"]).select("code", F.col("parent").alias("at"), F.col("node").alias("next"), F.col("node").alias("pos"), "length", "n")
        tops = counts.join(roots(edges), "node", "left_semi").select("code", F.lit(None).cast("string").alias("at"), F.col("node").alias("next"), F.col("node").alias("pos"), "length", "n")
        ahead, keys = cut_lineage(ahead.unionByName(tops), "ahead"), ["code", "at"]
        now = counts.groupBy("code").agg(F.lit(None).cast("string").alias("at")).select("code", "at", F.lit(most_nodes + 1).alias("room"), F.lit(paths_a_code).cast("long").alias("owed"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("order"))
        ended = F.col("at").eqNullSafe(F.col("code"))
    else:
        counts = path_counts(edges, most_nodes) if counts is None else counts
        links = numbered(edges)
        ahead = counts.join(links, counts["node"] == links["parent"]).select(F.col("child").alias("at"), F.col("parent").alias("next"), "pos", "length", "n")
        ahead, keys = cut_lineage(ahead, "ahead"), ["at"]
        tops = cut_lineage(roots(edges).select(F.col("node").alias("top")), "tops")
        now = codes.join(counts.select(F.col("node").alias("code")).distinct(), "code", "left_semi")
        now = now.select("code", F.col("code").alias("at"), F.lit(most_nodes).alias("room"), F.lit(paths_a_code).cast("long").alias("owed"), F.array("code").alias("path"), F.array().cast("array<int>").alias("order"))
        ended = None
    found = []
    for _ in range(most_nodes + 1):
        now = cut_lineage(now, "ways")
        if now.isEmpty():
            break
        if root_first:
            done, now = now.where(ended), now.where(~ended)
        else:
            done, now = now.join(tops, now["at"] == tops["top"], "left_semi"), now.join(tops, now["at"] == tops["top"], "left_anti")
        found.append(done.select("code", "order", "path"))
        here = ahead.withColumnsRenamed({k: f"_{k}" for k in keys})
        fits = reduce(lambda a, b: a & b, [now[k].eqNullSafe(here[f"_{k}"]) for k in keys])
        # more than is owed need not be told apart, so sums stay small
        ways = now.join(here, fits & (F.col("length") < F.col("room"))).groupBy("code", "at", "room", "owed", "path", "order", "next", "pos").agg(F.least(F.sum("n"), F.col("owed").cast(_COUNT)).cast("long").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("code", "order").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ways = ways.withColumn("owed", F.least(F.col("n"), F.col("owed") - before)).where("owed > 0")
        path = F.concat("path", F.array("next")) if root_first else F.concat(F.array("next"), "path")
        now = ways.select("code", F.col("next").alias("at"), (F.col("room") - 1).alias("room"), "owed", path.alias("path"), F.concat("order", F.array("pos")).alias("order"))
    out = _union(found, codes.select("code", F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("path")))
    return out.select("code", F.row_number().over(Window.partitionBy("code").orderBy("order")).alias("rank"), "path")


def counted_stats(counts: DataFrame, by: list[str]) -> DataFrame:
    """Numbers and lengths of paths of a group's codes, from counts (by, code, length, n) alone."""
    per_code = counts.groupBy(*by, "code").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("nodes"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    n = F.col("n").cast("double")
    return per_code.groupBy(*by).agg(
        F.count("*").alias("codes"),
        F.sum("n").alias("total_paths"),
        (F.sum("n").cast("double") / F.count("*")).alias("mean_paths"),
        F.median(n).alias("median_paths"),
        F.min("lo").alias("min_length"),
        F.max("hi").alias("max_length"),
        (F.sum("nodes").cast("double") / F.sum("n").cast("double")).alias("mean_length"),
    )


def above(codes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lead up from the codes, directly or by others."""
    links = cut_lineage(edges, "links")
    now = cut_lineage(codes.select(F.col("code").alias("child")).distinct(), "reached")
    found = [now]
    while True:
        new = now.join(links, "child").select(F.col("parent").alias("child")).distinct()
        now = cut_lineage(reduce(lambda a, b: a.join(b, "child", "left_anti"), found, new), "reached")
        if now.isEmpty():
            return cut_lineage(links.join(_union(found, now), "child", "left_semi"), "above")
        found.append(now)
        if len(found) > 8:
            found = [cut_lineage(_union(found, now), "reached")]


def _shared_sets(links: DataFrame, most: int) -> DataFrame:
    """node, place, path: the first `most` paths of every node that no cycle is above, built from the roots down."""
    awaited = cut_lineage(links.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("parents")), "awaited")
    fresh = cut_lineage(roots(links).select("node", F.lit(1).alias("place"), F.array("node").alias("path")), "sets")
    sets, met = [fresh], None
    while not fresh.isEmpty():
        # how many of a node's parents have their paths; it has its own once all have
        met_now = links.join(fresh.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").groupBy(F.col("child").alias("node")).agg(F.count("*").alias("met"))
        met = cut_lineage(met_now if met is None else met.unionByName(met_now).groupBy("node").agg(F.sum("met").alias("met")), "met")
        ready = met.join(awaited, "node").where("met = parents").select("node")
        rows = links.join(ready, links["child"] == ready["node"], "left_semi").join(_union(sets, fresh).select(F.col("node").alias("parent"), F.col("place").alias("_place"), F.col("path").alias("_path")), "parent")
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("child").orderBy("pos", "_place"))).where(F.col("place") <= most)
        fresh = cut_lineage(rows.select(F.col("child").alias("node"), "place", F.concat("_path", F.array("child")).alias("path")), "sets")
        sets.append(fresh)
        met = cut_lineage(met.join(ready, "node", "left_anti"), "met")
    return _union(sets, fresh)


def bounded_paths(codes: DataFrame, edges: DataFrame, paths_a_node: int = NODE_PATHS, root_fallback: bool = False) -> DataFrame:
    """code, rank, path: of each code's paths, none of which passes a node twice, the first by its parents in order, then by theirs.

    No node passes on more than paths_a_node paths. A node whose parents are all below it has no path, or
    with root_fallback is a root there. Codes that no edge names have no path; parents that are nobody's child
    are roots, whether or not the vocabulary knows them.
    """
    every = cut_lineage(numbered(edges), "numbered")
    known = every.select(F.col("child").alias("code")).union(every.select("parent")).distinct()
    wanted = cut_lineage(codes.select("code").distinct().join(known, "code", "left_semi"), "wanted")
    links = above(wanted, every)
    sets = cut_lineage(_shared_sets(links, paths_a_node).unionByName(_lone(wanted, links)), "shared")
    clean = sets.select("node").distinct()
    found = [wanted.join(sets, wanted["code"] == sets["node"]).select("code", F.array("place").alias("order"), "path")]
    open_ = links.join(clean.withColumnRenamed("node", "child"), "child", "left_anti")
    into = cut_lineage(open_.join(clean.select(F.col("node").alias("parent"), F.lit(True).alias("shared")), "parent", "left").withColumn("shared", F.coalesce("shared", F.lit(False))), "into")
    now = wanted.join(clean.withColumnRenamed("node", "code"), "code", "left_anti").select("code", F.col("code").alias("node"), F.array("code").alias("path"), F.array().cast("array<int>").alias("order"))
    done = cut_lineage(now.select("code", "order", "path").limit(0), "done")
    while True:
        now = cut_lineage(now, "ways")
        if now.isEmpty():
            break
        ahead = now.join(into, now["node"] == into["child"]).where(~F.array_contains("path", F.col("parent"))).select("code", "parent", "shared", "path", F.concat("order", F.array("pos")).alias("order"), F.col("order").alias("way"))
        ahead = cut_lineage(ahead, "ahead")
        reached = ahead.where("shared").join(sets.select(F.col("node").alias("parent"), "place", F.col("path").alias("_path")), "parent")
        ends = [done, reached.select("code", F.concat("order", F.array("place")).alias("order"), F.concat("_path", "path").alias("path"))]
        if root_fallback:
            going = ahead.select("code", F.col("way").alias("order")).distinct()
            ends.append(now.join(going, ["code", "order"], "left_anti").select("code", "order", "path"))
        ranked = _union(ends, done).withColumn("_rank", F.row_number().over(Window.partitionBy("code").orderBy("order")))
        done = cut_lineage(ranked.where(F.col("_rank") <= paths_a_node).drop("_rank"), "done")
        # a way behind the last path that counts leads to none that does
        last = done.groupBy("code").agg(F.count("*").alias("_many"), F.max("order").alias("_last")).where(F.col("_many") == paths_a_node).select("code", "_last")
        ways = ahead.where("not shared").join(last, "code", "left").where(F.col("_last").isNull() | (F.col("order") < F.col("_last")))
        now = ways.select("code", F.col("parent").alias("node"), F.concat(F.array("parent"), "path").alias("path"), "order")
    out = _union([*found, done], done)
    return out.select("code", F.row_number().over(Window.partitionBy("code").orderBy("order")).alias("rank"), "path")


def _lone(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """Codes that are roots and nobody's parent among the links."""
    named = links.select(F.col("child").alias("code")).union(links.select("parent"))
    return wanted.join(named, "code", "left_anti").select(F.col("code").alias("node"), F.lit(1).alias("place"), F.array("code").alias("path"))


def expanded_paths(codes: DataFrame, edges: DataFrame, expansions: int = EXPANSIONS, steps_a_job: int = 4) -> DataFrame:
    """code, rank, path: paths to roots in the order in which a queue finds them that takes so many ways of a code and no more.

    A queue of ways begins with the code; what it takes is a path if its last node has no parent, else each parent makes a
    longer way, at the queue's end. Nothing but the number taken stops a cycle, so paths may pass a node again.

    All codes' queues go level by level at once: a way's rank in its level says whether it is still taken. A code none of
    whose ways leads to a root finds nothing more and is left. steps_a_job levels are one job.
    """
    every = cut_lineage(numbered(edges), "numbered")
    known = every.select(F.col("child").alias("code")).union(every.select("parent")).distinct()
    wanted = cut_lineage(codes.select("code").distinct().join(known, "code", "left_semi"), "wanted")
    links = above(wanted, every)
    leads = _leading(links, wanted)
    into = cut_lineage(links.join(leads.select(F.col("node").alias("parent"), F.lit(True).alias("leads")), "parent", "left").select(F.col("child").alias("_child"), "parent", "pos", F.coalesce("leads", F.lit(False)).alias("leads")), "into")
    now = wanted.join(leads, wanted["code"] == leads["node"], "left_semi")
    now = now.select("code", F.col("code").alias("node"), F.array("code").alias("path"), F.lit(0).alias("level"), F.lit(1).alias("rank"), F.lit(expansions).alias("left"), F.lit(False).alias("done"))
    now, level, found = now.where(F.lit(expansions > 0)), 0, []
    while True:
        for _ in range(steps_a_job):
            level += 1
            now = _expanded(now, into, level)
        now = cut_lineage(now, "queue")
        found.append(now.where("done").select("code", "level", "rank", "path"))
        now = now.where("not done")
        if now.isEmpty():
            out = _union(found, now)
            return out.select("code", F.row_number().over(Window.partitionBy("code").orderBy("level", "rank")).alias("rank"), "path")


def _leading(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """node: nodes from which a root is reached."""
    lone = wanted.join(links.select(F.col("child").alias("code")), "code", "left_anti").select(F.col("code").alias("node"))
    now = cut_lineage(roots(links).union(lone).distinct(), "leading")
    found = [now]
    while True:
        new = links.join(now.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        now = cut_lineage(reduce(lambda a, b: a.join(b, "node", "left_anti"), found, new), "leading")
        if now.isEmpty():
            return _union(found, now)
        found.append(now)
        if len(found) > 8:
            found = [cut_lineage(_union(found, now), "leading")]


def _expanded(now: DataFrame, into: DataFrame, level: int) -> DataFrame:
    """The queue's next level, with the paths found so far: a way without a parent ahead is done and stays as it is.

    Ranks of a level have no gaps, so the greatest is how many ways it takes.
    """
    rows = now.join(into, (now["node"] == into["_child"]) & ~now["done"], "left").withColumn("_ended", F.col("_child").isNull())
    rows = rows.withColumn("_left", F.col("left") - F.max("rank").over(Window.partitionBy("code", "done")))
    queue = Window.partitionBy("code", "done", "_ended")
    rows = rows.withColumn("_rank", F.row_number().over(queue.orderBy("rank", "pos"))).withColumn("_taken", F.col("_rank") <= F.col("_left"))
    rows = rows.withColumn("_leads", F.max(F.col("_taken") & F.coalesce("leads", F.lit(False))).over(queue))
    rows = rows.where(F.col("_ended") | (F.col("_taken") & F.col("_leads")))
    pick = lambda ended, going: F.when(F.col("_ended"), ended).otherwise(going)
    return rows.select(
        "code",
        F.col("parent").alias("node"),
        pick(F.col("path"), F.concat(F.array("parent"), "path")).alias("path"),
        pick(F.when(F.col("done"), F.col("level")).otherwise(level), F.lit(level)).alias("level"),
        pick(F.col("rank"), F.col("_rank")).alias("rank"),
        pick(F.col("left"), F.col("_left")).alias("left"),
        F.col("_ended").alias("done"),
    )
