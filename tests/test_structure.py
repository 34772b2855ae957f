"""Inheritance, dependency graphs, global order and as-of search against brute force, and where they used to break."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import asof, graph, ranking, recursive

CHAIN = "config string, parent string, options map<string,string>"


def resolved(spark, rows):
    return {r.config: (r.options, r.cyclic) for r in recursive.inherited(spark.createDataFrame(rows, CHAIN)).collect()}


def brute_options(rows):
    of = {c: (p, o or {}) for c, p, o in rows}
    out = {}
    for c in of:
        path, at = [], c
        while at in of and at not in path:
            path.append(at)
            at = of[at][0]
        merged = {}
        for x in reversed(path):
            merged |= {k: v for k, v in of[x][1].items() if v is not None}
        out[c] = (merged, at in of)
    return out


def test_chain_of_many_levels(spark):
    rows = [(f"c{i}", f"c{i + 1}" if i < 700 else None, {f"k{i % 9}": str(i)}) for i in range(701)]
    got = resolved(spark, rows)
    assert got == brute_options(rows) and got["c0"][0] == {f"k{i}": str(i) for i in range(9)}


@pytest.mark.parametrize("seed", range(3))
def test_random_inheritance(spark, seed):
    r = random.Random(seed)
    rows = [(f"c{i}", r.choice([None, "gone", *(f"c{r.randrange(60)}" for _ in range(6))]), r.choice([None, {f"k{r.randrange(5)}": str(i)}, {"null": None, "a": str(i)}])) for i in range(60)]
    got, want = resolved(spark, rows), brute_options(rows)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert {k: {x: y for x, y in v[0].items() if y is not None} for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_inheritance_of_nothing_and_of_oneself(spark):
    assert resolved(spark, []) == {}
    assert resolved(spark, [("a", "a", {"x": "1"}), ("b", "a", None)]) == {"a": ({"x": "1"}, True), "b": ({"x": "1"}, True)}


def test_many_configurations_on_one_parent(spark):
    n = 700_000
    child = spark.range(n).select(F.concat(F.lit("c"), "id").alias("config"), F.lit("base").alias("parent"), F.create_map(F.lit("own"), F.col("id").cast("string")).alias("options"))
    base = spark.createDataFrame([("base", None, {"own": "base", "lib": "es"})], CHAIN)
    got = recursive.resolve_extends(child.union(base))
    assert got.where("options['lib'] = 'es' AND (config = 'base' OR config = 'c' || options['own'])").count() == n + 1


def test_documents_with_relative_parents(spark):
    docs = [("/a/b/tsconfig.json", '{"extends": "../base", "compilerOptions": {"strict": true, "lib": ["es", null]}}'), ("/a/base.json", '{"extends": "pkg/tsconfig.json", "compilerOptions": {"strict": false, "target": "es5", "x": null}}'), ("pkg/tsconfig.json", '{"compilerOptions": {"jsx": {"a": 1}}}'), ("/a/none.json", '{"files": []}'), ("/a/broken.json", "{")]
    got = resolved(spark, [tuple(r) for r in recursive.configurations(spark.createDataFrame(docs, "path string, value string")).collect()])
    assert got["/a/b/tsconfig.json"][0] == {"strict": "true", "lib": '["es",null]', "target": '"es5"', "x": "null", "jsx": '{"a":1}'}
    assert got["/a/none.json"] == ({}, False) and got["/a/broken.json"] == ({}, False)


# ---- graphs


def brute_closure(edges):
    ahead = defaultdict(set)
    for u, v in edges:
        ahead[u].add(v)
    out = set()
    for u in list(ahead):
        seen, todo = set(), [u]
        while todo:
            for v in ahead.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        out |= {(u, v) for v in seen}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    nodes = 30
    edges = [(r.randrange(nodes), r.randrange(nodes)) for _ in range([20, 35, 60, 30][seed])]
    if seed == 3:
        edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]  # no cycle
    df = spark.createDataFrame([*edges, *edges[:5], (None, 1), (2, None)], "u int, v int")
    want = brute_closure(edges)
    assert {tuple(x) for x in graph.closure(df).collect()} == want
    mutual = defaultdict(set)
    for u, v in want:
        if (v, u) in want:
            mutual[u].add(v)
    assert sorted(map(tuple, graph.cycles(df).collect())) == sorted((u, min(vs)) for u, vs in mutual.items())
    deep = {}

    def level(n):
        if n not in deep:
            below = [v for u, v in edges if u == n]
            deep[n] = max((level(v) for v in below), default=-1) + 1
        return deep[n]

    ends = {x for e in edges for x in e} | {99}
    stuck = {n for n in ends if n in mutual or any((n, m) in want for m in mutual)}
    got = graph.levels(df, spark.createDataFrame([(99,), (None,), (edges[0][0],)], "node int")).collect()
    assert sorted((x.node, x.level) for x in got if x.level is not None) == sorted((n, level(n)) for n in ends - stuck)
    assert {x.node for x in got if x.level is None} == stuck


def test_graph_of_many_edges(spark):
    """100,000 edges: 10,000 packages that use nine others above them, one used by all, in four levels; and a cycle."""
    n = 10_000
    ids = spark.range(n).withColumn("level", F.col("id") % 4)
    edges = ids.where("level > 0").select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("i")).select("u", ((F.col("u") * 7 + F.col("i") * 400) % n).alias("v"))
    edges = edges.where("v % 4 < u % 4").union(ids.select(F.col("id").alias("u"), F.lit(-1).cast("long").alias("v"))).union(spark.createDataFrame([(-5, -6), (-6, -7), (-7, -5)], "u long, v long"))
    fan = spark.range(60_000).select((F.col("id") + 20_000).alias("u"), (F.col("id") % n).alias("v"))
    edges = edges.union(fan)
    assert edges.distinct().count() >= 100_000
    got = {r.level: r["count"] for r in graph.levels(edges).groupBy("level").count().collect()}
    assert got[None] == 3 and got[0] == 1 and sum(got.values()) == n + 60_000 + 1 + 3 and max(k for k in got if k is not None) <= 5
    assert {tuple(x) for x in graph.cycles(edges).collect()} == {(-5, -7), (-6, -7), (-7, -7)}
    assert graph.closure(edges.where("u < 20000")).where("u = v").count() == 3


def test_graphs_of_nothing(spark):
    none = spark.createDataFrame([], "u int, v int")
    assert graph.closure(none).count() == graph.cycles(none).count() == graph.levels(none).count() == 0


# ---- global order


@pytest.mark.parametrize("partitions", [1, 5, 30])
def test_global_rank(spark, partitions):
    r = random.Random(1)
    rows = [(r.choice(["b", "B", "a", "é", "e", "É", "", None, "Z", "z z", "10", "9"]) if i % 3 else "hot", i, "p") for i in range(400)]
    df = spark.createDataFrame(rows, "x string, i int, piece string").repartition(3)
    got = ranking.global_rank(df, [F.col("x").asc(), F.col("i").asc()], "at", partitions)
    assert got.columns == ["x", "i", "piece", "at"]
    want = sorted(rows, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1]))
    assert [tuple(x)[:3] for x in sorted(got.collect(), key=lambda x: x["at"])] == want and sorted(x["at"] for x in got.collect()) == [*range(1, 401)]


def test_locale_rank_and_no_rows(spark):
    df = spark.createDataFrame([(x,) for x in "b B a A é z Z e".split()], "x string")
    got = ranking.global_rank(df, ranking.locale_order("x"), partitions=4).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.place)] == "a A b B e é z Z".split()
    assert ranking.global_rank(df.where("false"), ranking.locale_order("x")).count() == 0


# ---- as-of search


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_as_of(spark, forward, partitions):
    r = random.Random(partitions)
    key = lambda i: "hot" if i % 3 == 0 else r.choice(["a", "b", "c", None])
    marks = {(key(i), r.choice([None, r.randrange(500)])): f"m{i}" for i in range(60)}
    rows = [(key(i), r.choice([None, r.randrange(500)]), i) for i in range(300)]
    got = asof.as_of(spark.createDataFrame(rows, "key string, at long, found_ int"), spark.createDataFrame([(*k, v) for k, v in marks.items()], "key string, at long, value string"), forward=forward, partitions=partitions)

    def want(k, t):
        near = [] if k is None or t is None else [(at, v) for (k2, at), v in marks.items() if k2 == k and at is not None and (at >= t if forward else at <= t)]
        return (min(near) if forward else max(near))[1] if near else None

    assert sorted((x.found_, x.found) for x in got.collect()) == sorted((i, want(k, t)) for k, t, i in rows)


# ---- rounds and sizes of the operators above


def written(monkeypatch, module):
    """Row counts of what the module stores."""
    counts, old = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df: (got := old(df), counts.append(got.count()))[0])
    return counts


def test_closure_of_long_lists(spark, monkeypatch):
    """Nodes that reach more than a row lists get several rows, and no pair twice."""
    monkeypatch.setattr(graph, "LISTED", 6)
    r = random.Random(7)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(12)]
    got = [tuple(x) for x in graph.closure(spark.createDataFrame(edges, "u int, v int")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_closure(edges)


def test_rounds_of_cycles(spark, monkeypatch):
    """A ring is walked several steps a job."""
    counts = written(monkeypatch, graph)
    n = 24
    assert {tuple(x) for x in graph.cycles(spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "u int, v int")).collect()} == {(i, 0) for i in range(n)}
    assert len(counts) < n


def test_hot_ends_are_declared_or_not(spark):
    """A task that most others depend on is one key, whose rows stay where they are."""
    d = spark.range(3000).select(F.col("id").cast("string").alias("package"), F.lit("t").alias("task"), F.explode(F.array(F.lit("gen"), F.lit("gone"))).alias("depends_on"), F.lit("root").alias("scope"))
    got = graph.expand_dependencies(d, spark.createDataFrame([], "package string, upstream string"), spark.createDataFrame([("//", "gen"), ("//", "gen")], "package string, task string"))
    assert got.count() == got.distinct().count() == 3000 and got.where("on_task <> 'gen'").count() == 0
    assert "LeftSemi, BuildRight" in got._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_a_small_cycle_beside_many(spark, monkeypatch):
    """Rounds end with the longest chain and the cycle, not with the table."""
    counts = written(monkeypatch, recursive)
    rows = [(f"c{i}", None, {"a": "x"}) for i in range(3000)] + [("x", "y", {"x": "1"}), ("y", "z", {"y": "2"}), ("z", "x", {"x": "3"})]
    got = resolved(spark, rows)
    assert got["z"] == ({"x": "3", "y": "2"}, True) and got["y"] == ({"y": "2", "x": "3"}, True) and sum(c for _, c in got.values()) == 3
    assert len(counts) <= 4


def test_pairs_of_edges_there_and_back_are_put_together(spark, monkeypatch):
    """A long chain of them takes few rounds: no colours are spread."""
    counts = written(monkeypatch, graph)
    n = 120
    edges = [(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)] + [(n + 5, 3), (3, n + 9), (n + 9, n + 9)]
    got = {tuple(x) for x in graph.cycles(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {(i, 0) for i in range(n + 1)} | {(n + 9, n + 9)}
    assert len(counts) < 20


def test_closure_stores_only_what_others_need(spark, monkeypatch):
    """Nodes that nothing depends on are not stored as lists, and an early round's table is small: nodes are taken as late as can be."""
    kept, old = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (got := old(df), kept.append(got.count()) if got.columns == ["u", "ring", "part", "n"] else None)[0])
    tree = [(i, i // 2) for i in range(2, 256)] + [(1000 + i, i) for i in range(2, 40)]
    got = [tuple(x) for x in graph.closure(spark.createDataFrame(tree, "u int, v int")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_closure(tree)
    assert kept == [1, 2, 4, 8, 16, 32, 64]
