"""Hierarchical communities by modularity, as rounds of Spark jobs.

One round of local moving: every node weighs the communities of its neighbours
and goes to the best strict gain (ties to the smaller community). All nodes
decide at once on the same state, so only those move whose turn it is: a half
picked by hash, then the other half, then by another hash; that keeps
neighbours from swapping for ever. Only those whose turn it is are weighed. After
both halves only the nodes that moved and those next to one are weighed again: the
edges of all others stay out of the next rounds, so rounds shrink as a graph
settles. A graph of at most moving.TASK_EDGES edges is worked on by one task, in
arrays, by the same rounds; what follows is for larger ones. Their edges lie in buckets by the end whose community is
asked for, so a round shuffles sums and no edges. A pass ends when none moves;
then communities become nodes and the next pass begins, until a pass joins nothing. The sums of a community are aggregates, the neighbours a
join; no group is gathered, and a hub costs its number of neighbouring communities.

Leiden adds the refinement: inside every community nodes start alone again and
join parts they are well connected to, with a gain, so that parts are connected;
the parts become the nodes of the next pass, which starts from the communities.
A node may only join while it is alone and it is its turn, and only parts whose
founder stays put in that round, so no part loses what held it together. At the
end a community that moving has left in several pieces is these pieces: that
costs no edge, so modularity can only gain.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.scratch import release, save, save_buckets
from . import moving
from .components import components
from .rank import global_rank

log = logging.getLogger("graphweave.communities")
#: Arcs of a bucket; a graph with no more is not dealt.
BUCKET_ARCS = 500_000


def _turn(node: str, turn: int, seed: int) -> Column:
    """Whether it is a node's turn: a half in even turns, the other half in the next."""
    return F.pmod(F.xxhash64(node, F.lit(turn // 2), F.lit(seed)), F.lit(2)) == turn % 2


def _dealt(arcs: DataFrame, n: int) -> DataFrame:
    """arcs, at most n, saved in buckets by (graph, b): a round asks where the b's are, and only what it adds up is
    shuffled. A bucket is one file, and a table of few rows is a plain one."""
    if n <= BUCKET_ARCS:
        return save(arcs)
    buckets = max(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ARCS))
    return save_buckets(arcs.repartition(buckets, "graph", "b"), ["graph", "b"], buckets)


def _turned(arcs: DataFrame) -> DataFrame:
    """The same arcs, which stand both ways, from their other end: those of an a lie in one bucket."""
    return arcs.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "weight")


def _half(nodes: DataFrame, arcs: DataFrame, again: DataFrame | None, resolution: float, turn: int, seed: int) -> tuple[DataFrame, Observation]:
    """nodes(graph, node, c, k, total, was) after those whose turn it is went to their best community, saved, and how many
    there are and are not where they were. arcs: both ways, without loops; again(graph, a): the nodes to be weighed, None:
    all; total is twice the weight of the graph."""
    sums = nodes.groupBy("graph", "c").agg(F.sum("k").alias("tot"))
    state = nodes.join(sums, ["graph", "c"])
    to = state.select("graph", F.col("node").alias("b"), F.col("c").alias("to"), F.col("tot").alias("to_tot"))
    links = arcs.filter(_turn("a", turn, seed)).join(to.hint("shuffle_hash"), ["graph", "b"]).groupBy("graph", F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"), F.max("to_tot").alias("to_tot"))
    weighed = state.filter(_turn("node", turn, seed)).select("graph", "node", "c", "k", "total", "tot")
    if again is not None:
        weighed = weighed.join(again.withColumnRenamed("a", "node"), ["graph", "node"], "left_semi")
    # Without the node itself in its own community.
    lost = resolution * F.col("k") / F.col("total")
    here = F.col("to") == F.col("c")
    gain = F.col("w") - lost * (F.col("to_tot") - F.when(here, F.col("k")).otherwise(0.0))
    best = links.join(weighed, ["graph", "node"]).withColumn("gain", gain).groupBy("graph", "node").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best"), F.max(F.when(here, F.col("gain"))).alias("stay"), F.max(-lost * (F.col("tot") - F.col("k"))).alias("alone"))
    moves = best.filter((-F.col("best.loss") > F.coalesce("stay", "alone") + 1e-9)).select("graph", "node", F.col("best.to").alias("next"))
    moved = Observation()
    out = nodes.join(moves, ["graph", "node"], "left").select("graph", "node", F.coalesce("next", "c").alias("c"), "k", "total", "was")
    return save(out.observe(moved, F.count_if(F.col("c") != F.col("was")).alias("moved"), F.count(F.lit(1)).alias("nodes"))), moved


def _local(nodes: DataFrame, arcs: DataFrame, resolution: float, config: EngineConfig, weighed: list[int] | None = None) -> DataFrame:
    """Rounds until no node gains, one half's and then the other's; config.community_rounds bounds them, and a pass that it
    ends is logged. weighed: gets the arcs of the nodes that each two rounds weigh."""
    n_arcs = arcs.count()
    near, again, some = arcs, None, None
    for turn in range(0, config.community_rounds, 2):
        if weighed is not None:
            weighed.append(n_arcs if again is None else _turned(arcs).join(again, ["graph", "a"], "left_semi").count())
        first, _ = _half(nodes.withColumn("was", F.col("c")), near, again, resolution, turn, config.seed)
        before, (nodes, figures) = nodes, _half(first, near, again, resolution, turn + 1, config.seed)
        # What a small graph weighs again is read from the nodes before, so these stay until now.
        release(first, *(t for t in (before, again, some) if t is not None))
        n_moved, n_nodes = figures.get["moved"], figures.get["nodes"]
        if not n_moved:
            break
        # Weighed again is what moved and what stands next to it.
        moved = nodes.filter("c <> was").select("graph", F.col("node").alias("b"))
        again = arcs.join(moved.hint("shuffle_hash"), ["graph", "b"]).select("graph", "a").unionByName(moved.withColumnRenamed("b", "a")).distinct()
        near, some = arcs, None
        if n_arcs > BUCKET_ARCS:
            n_again = Observation()
            again = save(again.observe(n_again, F.count(F.lit(1)).alias("n")))
            # Few nodes with few arcs: theirs are a table for the next rounds. Else all arcs are read, which needs no shuffle.
            own = _turned(arcs).join(again.hint("shuffle_hash"), ["graph", "a"], "left_semi")
            if 4 * n_again.get["n"] < n_nodes and 4 * own.count() < n_arcs:
                near = some = save(own)
    else:
        log.warning("a pass of local moving ended after %d rounds, the last two with %d moves", config.community_rounds, n_moved)
    return nodes.drop("was")


def _refine(nodes: DataFrame, arcs: DataFrame, resolution: float, config: EngineConfig) -> DataFrame:
    """nodes(graph, node, c, k, total) -> (graph, node, c, r): r, the part of c, is the node that founded it."""
    c_of = nodes.select("graph", F.col("node").alias("b"), F.col("c").alias("cb"))
    inner = arcs.join(nodes.select("graph", F.col("node").alias("a"), "c"), ["graph", "a"]).join(c_of, ["graph", "b"]).filter("c = cb").select("graph", "a", "b", "weight")
    inner = save(inner)
    size = nodes.groupBy("graph", "c").agg(F.sum("k").alias("kc"))
    to_c = inner.groupBy("graph", F.col("a").alias("node")).agg(F.sum("weight").alias("wc"))
    base = nodes.select("graph", "node", "c", "k", "total").join(size, ["graph", "c"]).join(to_c, ["graph", "node"], "left")
    own_fit = F.coalesce("wc", F.lit(0.0)) >= resolution * F.col("k") * (F.col("kc") - F.col("k")) / F.col("total") - 1e-12
    parts = save(base.withColumn("wc", F.coalesce("wc", F.lit(0.0))).withColumn("fit", own_fit).withColumn("r", F.col("node")))
    idle = 0
    for turn in range(config.community_rounds):
        r_of = parts.select("graph", F.col("node").alias("b"), F.col("r").alias("to"))
        links = inner.join(r_of, ["graph", "b"]).groupBy("graph", F.col("a").alias("node"), "to").agg(F.sum("weight").alias("w"))
        at_home = links.withColumnRenamed("to", "r").join(parts.select("graph", "node", "r"), ["graph", "node", "r"]).groupBy("graph", "r").agg(F.sum("w").alias("inside"))
        sums = parts.groupBy("graph", "r").agg(F.sum("k").alias("kr"), F.sum("wc").alias("wr"), F.count(F.lit(1)).alias("n")).join(at_home, ["graph", "r"], "left")
        state = parts.join(sums, ["graph", "r"])
        # A part may be joined while it is well connected to the rest of its community.
        fit = F.col("wr") - F.coalesce("inside", F.lit(0.0)) >= resolution * F.col("kr") * (F.col("kc") - F.col("kr")) / F.col("total") - 1e-12
        target = state.filter(F.col("r") == F.col("node")).filter(fit & ((F.col("n") > 1) | ~_turn("node", turn, config.seed))).select("graph", F.col("r").alias("to"), F.col("kr").alias("to_k"))
        alone = state.filter((F.col("n") == 1) & F.col("fit")).select("graph", "node", "k", "total")
        gain = F.col("w") - resolution * F.col("k") * F.col("to_k") / F.col("total")
        best = links.join(alone, ["graph", "node"]).filter("node <> to").join(target, ["graph", "to"]).withColumn("gain", gain).filter("gain > 1e-12")
        best = best.groupBy("graph", "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best")).withColumn("mine", _turn("node", turn, config.seed))
        step = save(best.select("graph", "node", "best.to", "mine"))
        # Founders that may be joined change from turn to turn: two turns without a wish end it.
        idle = idle + 1 if step.isEmpty() else 0
        if idle == 2:
            break
        before, parts = parts, save(parts.join(step.filter("mine").select("graph", "node", "to"), ["graph", "node"], "left").withColumn("r", F.coalesce("to", "r")).drop("to"))
        release(before, step)
    release(inner)
    return parts.select("graph", "node", "c", "r")


def partition(edges: DataFrame, nodes: DataFrame, resolution: float, config: EngineConfig = EngineConfig()) -> DataFrame:
    """edges(graph, u, v, weight) over longs, nodes(graph, node) -> (graph, node, c).

    Graphs are independent: each has its own total weight. c is a node of the
    community. A graph without edges is left in single nodes. Louvain's passes
    end when one joins nothing; config.leiden_iterations bounds Leiden's. Graphs
    that fit a task are worked on there, whole; larger ones by rounds of jobs.
    """
    e = save(edges.select("graph", "u", "v", "weight"))
    large = save(e.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > moving.TASK_EDGES).select("graph"))
    if large.isEmpty():
        found = moving.in_tasks(e, resolution, config)
    else:
        found = moving.in_tasks(e.join(large, "graph", "left_anti"), resolution, config)
        found = found.unionByName(_by_jobs(e.join(large, "graph", "left_semi"), nodes.join(large, "graph", "left_semi"), resolution, config))
    return save(nodes.select("graph", "node").join(found, ["graph", "node"], "left").withColumn("c", F.coalesce("c", "node")))


def _by_jobs(edges: DataFrame, nodes: DataFrame, resolution: float, config: EngineConfig) -> DataFrame:
    """partition() of graphs of any size, as rounds of jobs over all of them."""
    leiden = config.community_algorithm == "leiden"
    member = save(nodes.select("graph", "node", F.col("node").alias("at")))  # at: the node of the current graph that holds it
    start: DataFrame | None = None  # (graph, node of the current graph, c)
    e, done = edges.select("graph", "u", "v", "weight"), 0
    while not leiden or done < config.leiden_iterations:
        done += 1
        e = save(e)
        if not (n := e.count()):
            break
        total = e.groupBy("graph").agg((2 * F.sum("weight")).alias("total"))
        arcs = e.filter("u <> v").select("graph", F.col("u").alias("a"), F.col("v").alias("b"), "weight")
        arcs = _dealt(arcs.unionByName(_turned(arcs)), 2 * n)
        k = e.select("graph", F.explode(F.array("u", "v")).alias("node"), "weight").groupBy("graph", "node").agg(F.sum("weight").alias("k"))
        # Every end of an edge stands for a community; those without edges have nowhere to go.
        level = k.join(total, "graph").select("graph", "node", F.col("node").alias("c"), "k", "total")
        if start is not None:
            level = level.drop("c").join(start, ["graph", "node"], "left").select("graph", "node", F.coalesce("c", "node").alias("c"), "k", "total")
        level = _local(save(level), arcs, resolution, config)
        if leiden:
            step = save(_refine(level, arcs, resolution, config).select("graph", F.col("node").alias("at"), "c", F.col("r").alias("new")))
            heads = step.groupBy("graph", "c").agg(F.min("new").alias("head"))
            start = save(step.select("graph", F.col("new").alias("node"), "c").distinct().join(heads, ["graph", "c"]).select("graph", "node", F.col("head").alias("c")))
        else:
            step = level.select("graph", F.col("node").alias("at"), F.col("c").alias("new"))
        n, n_new = step.agg(F.count(F.lit(1)), F.countDistinct("graph", "new")).first()
        member = save(member.join(step.select("graph", "at", "new"), ["graph", "at"], "left").select("graph", "node", F.coalesce("new", "at").alias("at")))
        if n == n_new:
            break
        a, b = step.select("graph", F.col("at").alias("u"), F.col("new").alias("nu")), step.select("graph", F.col("at").alias("v"), F.col("new").alias("nv"))
        e = e.join(a, ["graph", "u"]).join(b, ["graph", "v"]).groupBy("graph", F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).agg(F.sum("weight").alias("weight"))
    if start is not None:
        member = member.join(start.withColumnRenamed("node", "at"), ["graph", "at"], "left").select("graph", "node", F.coalesce("c", "at").alias("at"))
    found = save(member.select("graph", "node", F.col("at").alias("c")))
    return save(_pieces(edges, found)) if leiden else found


def _pieces(edges: DataFrame, found: DataFrame) -> DataFrame:
    """found(graph, node, c) with every community's connected pieces as communities, each named by its smallest node."""
    key = lambda node: F.concat_ws("|", F.col("graph").cast("string"), F.col(node).cast("string"))
    of = lambda end: found.select("graph", F.col("node").alias(end), F.col("c").alias(f"{end}_c"))
    inner = edges.filter("u <> v").join(of("u"), ["graph", "u"]).join(of("v"), ["graph", "v"]).filter("u_c = v_c")
    roots = components(inner.select(key("u").alias("u"), key("v").alias("v"))).withColumnRenamed("node", "key")
    placed = found.withColumn("key", key("node")).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = placed.groupBy("root").agg(F.min("node").alias("least"))
    return placed.join(names, "root").select("graph", "node", F.col("least").alias("c"))


def hierarchy(entities: DataFrame, edges: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """entities(name), edges(u, v, weight) by name -> members (id, level, parent_id, size, name).

    Level 0 is the broadest. A community larger than the limit is split again,
    with a higher resolution, on the graph inside it, if that gives more than
    one part. Ids are L{level}_C{n}: n counts by parent, then smallest name.
    """
    # Places in the order of the names: dense, and no two names share one.
    ranked = save(global_rank(entities.select("name").distinct(), [F.col("name")], "node"))
    by_id = lambda x, y: ranked.select(F.col("name").alias(x), F.col("node").alias(y))
    e = save(edges.join(by_id("u", "nu"), "u").join(by_id("v", "nv"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"), "weight"))
    graph_edges, graph_nodes = e.select(F.lit(0).cast("long").alias("graph"), "*"), ranked.select(F.lit(0).cast("long").alias("graph"), "node")
    parents: DataFrame | None = None
    resolution, out = config.community_resolution, None
    for level in range(config.max_community_levels):
        split = partition(graph_edges, graph_nodes, resolution, config)
        if parents is not None:
            several = split.groupBy("graph").agg(F.countDistinct("c").alias("n")).filter("n > 1")
            split = split.join(several.select("graph"), "graph", "left_semi")
        groups = split.join(ranked, "node").groupBy("graph", "c").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("first"))
        groups = groups.withColumn("parent", F.col("graph") if parents is not None else F.lit(None).cast("long"))
        groups = save(global_rank(groups, [F.col("graph"), F.col("first")], "n"))
        members = save(split.join(groups, ["graph", "c"]).select("node", "n", "parent", "size"))
        named = members.join(ranked, "node").select(
            F.format_string(f"L{level}_C%d", "n").alias("id"), F.lit(level).alias("level"),
            F.when(F.col("parent").isNotNull(), F.format_string(f"L{level - 1}_C%d", "parent")).alias("parent_id"), "size", "name")
        out = named if out is None else out.unionByName(named)
        big = members.filter(F.col("size") > config.max_cluster_size)
        if level + 1 == config.max_community_levels or big.isEmpty():
            break
        graph_nodes = save(big.select(F.col("n").alias("graph"), "node"))
        u, v = graph_nodes.withColumnRenamed("node", "u"), graph_nodes.select(F.col("graph").alias("gv"), F.col("node").alias("v"))
        graph_edges = save(e.join(u, "u").join(v, "v").filter("graph = gv").select("graph", "u", "v", "weight"))
        parents, resolution = members, resolution * config.community_resolution_multiplier
    return save(out)


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """edges(u, v, weight), members(name, c) -> one row q."""
    e = edges.join(members.select(F.col("name").alias("u"), F.col("c").alias("cu")), "u").join(members.select(F.col("name").alias("v"), F.col("c").alias("cv")), "v")
    # Either end of an edge adds its weight to its community; twice the weight inside is what both ends share.
    end = lambda c: F.struct(F.col(c).alias("c"), "weight", F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0).alias("own"))
    parts = e.select(F.inline(F.array(end("cu"), end("cv")))).groupBy("c").agg(F.sum("weight").alias("k"), F.sum("own").alias("l"))
    whole = parts.agg(F.sum("l").alias("l"), F.sum(F.pow("k", F.lit(2.0))).alias("k2"), F.sum("k").alias("m2"))
    return whole.select(F.coalesce(F.col("l") / F.col("m2") - resolution * F.col("k2") / F.pow("m2", F.lit(2.0)), F.lit(0.0)).alias("q"))


def choose_level(communities: DataFrame, requested: int) -> DataFrame:
    """One row level: the requested one, else the highest below it, else the lowest there is, else 0."""
    at_most = F.max(F.when(F.col("level") <= requested, F.col("level")))
    return communities.agg(F.coalesce(at_most, F.min("level"), F.lit(0)).alias("level"))

