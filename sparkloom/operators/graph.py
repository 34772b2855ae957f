"""Dependency graphs as edge tables (u, v): u depends on v. Expansion, closure, levels, cycles.

Rounds are written to the shared folder, so a lost executor costs one round and plans stay short. Edges with a null end are
left out, repeated ones count once, an empty table gives no rows. Joins are on node columns; a node with very many edges is
split by adaptive execution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.shared import stored, together, told_apart

#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this.
HOT = 1000
#: So many nodes one row of closure() lists, and come together for one row, at most.
LISTED = 100_000
#: Steps along the edges in one job of cycles().
HOPS = 4


def _edges(edges: DataFrame) -> DataFrame:
    return stored(told_apart(stored(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"))))


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _with_key(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose columns `on` are in keys; both are cheap to read twice. Hot keys are broadcast, so no task gets all rows of one."""
    often = rows.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > rows.count() / HOT).drop("n")
    hot = F.broadcast(stored(often))
    known = F.broadcast(stored(keys.join(hot, on, "left_semi").distinct()))
    return rows.join(known, on, "left_semi").unionByName(rows.join(hot, on, "left_anti").join(keys, on, "left_semi"))


def expand_dependencies(dependencies: DataFrame, upstream: DataFrame, declared: DataFrame | None = None, root: str = "//") -> DataFrame:
    """(package, task, on_package, on_task) of dependencies (package, task, depends_on, scope), as task_edges() makes them.

    A task of scope `upstream` is that of every package in upstream (package, upstream) of the package, one of scope `root`
    the root's, any other the package's own. With declared (package, task), ends that no package declares are left out."""
    d = dependencies.select("package", "task", F.col("depends_on").alias("on_task"), "scope")
    own = d.where("scope <> 'upstream'").select("package", "task", F.when(F.col("scope") == "root", root).otherwise(F.col("package")).alias("on_package"), "on_task")
    above = d.where("scope = 'upstream'").join(upstream.select("package", F.col("upstream").alias("on_package")), "package").select("package", "task", "on_package", "on_task")
    out = told_apart(stored(own.unionByName(above)))
    if declared is None:
        return out
    ends = declared.select(F.col("package").alias("on_package"), F.col("task").alias("on_task"))
    return _with_key(stored(out), stored(ends), ["on_package", "on_task"]).select("package", "task", "on_package", "on_task")


def closure(edges: DataFrame) -> DataFrame:
    """(u, v) of every v that u depends on, directly or not; (u, u) on a cycle.

    Cycles count as one node, and nodes are taken by level: what one reaches is put together, once, from what the nodes right
    below it reach. The level is how far a node is from those that nothing depends on, so that a node is taken just before it
    is needed: as most nodes are near these, the rounds' tables grow fast, and looking through all earlier ones costs about as
    much as one round more. Nodes that nothing depends on come last and are not stored.

    A row lists up to LISTED nodes; a node for which more come together (repeats included) has them told apart as pairs and
    gets several rows. There are as many rounds as the longest way. Numbers are much cheaper than texts as nodes."""
    edges = _edges(edges)
    members = stored(cycles(edges).select(F.col("node").alias("member"), F.col("cycle").alias("node")))
    between = stored(_contracted(edges, members.select(F.col("member").alias("node"), F.col("node").alias("head"))))
    rings = members.select("node", F.lit(True).alias("ring")).distinct()
    at = levels(between.select(F.col("v").alias("u"), F.col("u").alias("v")), members.select("node"))
    at = stored(at.join(rings, "node", "left").select("node", "level", F.coalesce("ring", F.lit(False)).alias("ring")))
    own = stored(at.join(members, "node", "left").select(F.col("node").alias("u"), "ring", "level", F.array(F.coalesce("member", "node")).alias("part"), F.lit(1).alias("n")))
    steps = stored(between.join(at.withColumnRenamed("node", "u"), "u"))
    if own.isEmpty():
        return edges
    fan = _most(steps) + _most(own)  # lists that come together for one node
    done: list[DataFrame] = []
    most = 1  # nodes in a list so far; none if a node has several lists

    def lists(of: str) -> DataFrame:
        nonlocal most
        parts = own.where(of).select("u", "ring", "part", "n")
        if done:
            parts = parts.unionByName(steps.where(of).join(together(done).select(F.col("u").alias("v"), "part", "n"), "v").select("u", "ring", "part", "n"))
        whole = lambda rows: rows.groupBy("u", "ring").agg(F.array_distinct(F.flatten(F.collect_list("part"))).alias("part"))
        if most and most * fan <= LISTED:
            return whole(parts)
        long = stored(parts.groupBy("u").agg(F.sum("n").alias("all")).where(F.col("all") > LISTED))
        if long.isEmpty():
            return whole(parts)
        most = 0
        pairs = parts.join(long, "u").select("u", "ring", "all", F.explode("part").alias("v")).distinct()
        piece = F.pmod(F.xxhash64("v"), F.ceil(2 * F.col("all") / LISTED))
        return whole(parts.join(long, "u", "left_anti")).unionByName(pairs.groupBy("u", "ring", piece.alias("piece")).agg(F.collect_list("v").alias("part")).drop("piece"))

    for (k,) in at.where("level > 0").select("level").distinct().orderBy(F.desc("level")).collect():
        done.append(stored(lists(f"level = {k}").withColumn("n", F.size("part"))))
        most = most and max(most, done[-1].agg(F.max("n")).first()[0] or 0)
    last = lists("level = 0")
    every = together(done).drop("n").unionByName(last) if done else last
    single = every.where("NOT ring").select("u", F.explode("part").alias("v")).where("u <> v")
    return single.unionByName(every.where("ring").withColumnRenamed("u", "node").join(members, "node").select(F.col("member").alias("u"), F.explode("part").alias("v")))


def _most(rows: DataFrame) -> int:
    """Rows of the u that has most."""
    return rows.groupBy("u").agg(F.count("*").alias("rows")).agg(F.max("rows")).first()[0] or 0


def _contracted(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges whose ends in heads (node, head) are the heads; no loops, each once."""
    to = lambda end: heads.select(F.col("node").alias(end), F.col("head").alias(f"{end}_head"))
    ends = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_head", "u").alias("u"), F.coalesce("v_head", "v").alias("v"))
    return ends.where("u <> v").distinct()


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): 0 for what depends on nothing, else one more than the highest level that it depends on; null on a cycle
    and for whatever depends on one. Nodes are the edges' ends, and those of nodes (node).

    Peeling: each round goes back along the edges of the nodes peeled last, so an edge counts once; a node is peeled when all
    of its edges have counted. Only nodes with some counted are kept between rounds."""
    every = _edges(edges)
    of = stored(every.join(every.groupBy("u").agg(F.count("*").alias("n")), "u"))
    ends = every.select(F.col("u").alias("node")).union(every.select("v"))
    rest = stored((ends if nodes is None else ends.union(nodes.select("node").where("node IS NOT NULL"))).distinct())
    ready = stored(rest.join(every.select(F.col("u").alias("node")), "node", "left_anti"))
    peeled: list[DataFrame] = []
    some = None
    while not ready.isEmpty():
        peeled.append(ready.select("node", F.lit(len(peeled)).cast("long").alias("level")))
        hit = of.join(ready.select(F.col("node").alias("v")), "v").select("u", "n", F.lit(1).cast("long").alias("got"))
        state = stored((hit if some is None else hit.unionByName(some)).groupBy("u", "n").agg(F.sum("got").alias("got")))
        ready, some = state.where("got = n").select(F.col("u").alias("node")), state.where("got < n")
    stuck = rest.join(_union(peeled), "node", "left_anti") if peeled else rest
    return _union([*peeled, stuck.select("node", F.lit(None).cast("long").alias("level"))])


def _joined(pairs: DataFrame) -> DataFrame:
    """(node, head) of the ends of pairs (u, v): the least node of those that pairs join, in either direction.

    Each step takes the least head of a node's neighbours, then that head's own, which halves the way."""
    both = stored(pairs.union(pairs.select("v", "u")))
    heads = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("head"))
    while True:
        ahead = heads
        for _ in range(HOPS // 2):
            near = both.join(ahead.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "head").union(ahead.select("node", "head"))
            near = near.groupBy("node").agg(F.min("head").alias("head"))
            ahead = near.join(ahead.select(F.col("node").alias("head"), F.col("head").alias("far")), "head").select("node", F.col("far").alias("head"))
        moved = stored(ahead.join(heads.withColumnRenamed("head", "had"), "node"))
        heads = moved.select("node", "head")
        if moved.where("head < had").isEmpty():
            return heads


def _core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and an edge out; what is on a cycle is among them."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        edges = stored(kept.select("u", "v"))
        if (m := edges.count()) == n:
            break
        n = m
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of every node on a cycle; `cycle` is the least node of those that depend on each other.

    Nodes with edges there and back are put together first. Each round spreads the least node along the edges until nothing changes, which colours what it reaches. Of each colour,
    what reaches that node too is one set; it is taken out, and the rest goes on without the edges from one colour to another,
    which are on no cycle. No pairs of a set's nodes are made."""
    every = _edges(edges)
    loops = every.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("cycle"))
    pairs = stored(every.where("u < v").join(every.where("u > v").select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]))
    alone = pairs.isEmpty()
    heads = pairs.select(F.col("u").alias("node"), F.col("v").alias("head")) if alone else _joined(pairs)
    edges = _core(every.where("u <> v") if alone else stored(_contracted(every, heads)))
    found: list[DataFrame] = []
    while not edges.isEmpty():
        stay = edges.select("u").distinct()  # in _core() these are all nodes
        moves = stored(edges.unionByName(stay.select("u", F.col("u").alias("v"))).distinct())
        colours = stay.select(F.col("u").alias("node"), F.col("u").alias("colour"))
        while True:
            ahead = colours
            for _ in range(HOPS):
                ahead = moves.join(ahead.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.min("colour").alias("colour"))
            spread = stored(ahead.join(colours.withColumnRenamed("colour", "had"), "node"))
            colours = spread.select("node", "colour")
            if spread.where("colour < had").isEmpty():
                break
        ends = moves.join(colours.withColumnRenamed("node", "u"), "u").join(colours.withColumnsRenamed({"node": "v", "colour": "of"}), "v").where("colour = of")
        inside = stored(ends.select("u", "v"))
        sets, n, before = colours.where("node = colour"), 1, 0
        while n > before:
            for _ in range(HOPS):
                sets = inside.join(sets.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "colour").distinct()
            sets = stored(sets)
            n, before = sets.count(), n
        found.append(sets)
        gone = sets.select(F.col("node").alias("u"))
        edges = _core(stored(inside.where("u <> v").join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")))
    if found:
        sets = _union(found)
        long = stored(sets.join(sets.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1"), "colour").select(F.col("node").alias("head"), F.col("colour").alias("cycle")))
        whole = heads.join(long, "head", "left").select("node", F.coalesce("cycle", "head").alias("cycle"))
        whole = stored(whole.unionByName(long.withColumnRenamed("head", "node").join(heads.select("node"), "node", "left_anti")))
    else:
        whole = heads.withColumnRenamed("head", "cycle")
    return whole.unionByName(loops.join(whole.select("node"), "node", "left_anti"))
