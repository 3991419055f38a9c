"""Networks of any depth: contraction against plain walks, on long chains, random trees, braided graphs and cycles."""

from __future__ import annotations

from collections import Counter, defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import network, overlay

DEPTH = 5230


def random_tree(n: int, reach: int, seed: int) -> dict[int, int | None]:
    """line -> the line below; line 1 is the outlet. A small ``reach`` makes it deep."""
    rng = np.random.default_rng(seed)
    return {k: None if k == 1 else int(max(1, k - 1 - rng.integers(0, reach))) for k in range(1, n + 1)}


def frame(spark, tree):
    return spark.createDataFrame([(k, v) for k, v in tree.items()], "line long, down long")


def plain_orders(tree):
    ups = defaultdict(list)
    for k in sorted(tree, reverse=True):  # upstream lines have larger numbers
        o = ups[k]
        ups[k] = order = 1 if not o else o[0] + 1 if min(o) == max(o) else max(o)
        if tree[k] is not None:
            ups[tree[k]].append(order)
    return {k: ups[k] for k in tree}


@pytest.fixture(scope="module")
def chain(spark):
    k = F.col("id")
    return spark.range(1, DEPTH + 1).select(k.alias("line"), k.alias("start"), (k - 1).alias("end"), F.when(k > 1, k - 1).alias("down"), F.lit(2.0).alias("length"))


def test_orders_of_a_long_chain(spark, chain):
    got = {r["line"]: r["stream_order"] for r in network.strahler(chain).collect()}
    assert got == {k: DEPTH + 1 - k for k in range(1, DEPTH + 1)}


def test_a_long_chain_is_merged(spark, chain):
    middle = network.classify(network.with_headwater_order(chain), 0).where("kind = 'middle'").select("vertex")
    assert [tuple(r) for r in network.merge(chain, middle).collect()] == [(1, DEPTH, DEPTH, 2.0 * DEPTH)]


def test_a_long_chain_is_turned(spark, chain):
    back = F.col("line") % 7 == 3
    mixed = chain.select("line", F.when(back, F.col("end")).otherwise(F.col("start")).alias("start"), F.when(back, F.col("start")).otherwise(F.col("end")).alias("end"))
    got = network.orient(mixed, 0).collect()
    assert {tuple(r) for r in got} == {(k, k, k - 1, k, int(k % 7 == 3)) for k in range(1, DEPTH + 1)}


@pytest.mark.parametrize("reach", [3, 100])
def test_orders_and_sums_of_random_trees(spark, reach):
    tree = random_tree(120, reach, reach)
    t = frame(spark, tree).repartition(7)
    assert {r["line"]: r["stream_order"] for r in network.strahler(t).collect()} == plain_orders(tree)
    size, depth = Counter(), {}
    for k in sorted(tree, reverse=True):
        size[k] += 1
        if tree[k]:
            size[tree[k]] += size[k]
    for k in sorted(tree):
        depth[k] = 1 + depth.get(tree[k], 0)
    one = t.withColumn("one", F.lit(1).cast("long"))
    assert {r["line"]: r["total"] for r in network.subtree_sum(one, "one").collect()} == dict(size)
    assert {r["line"]: (r["root"], r["total"]) for r in network.jump(one, "one").collect()} == {k: (1, d) for k, d in depth.items()}


def test_cycles_are_an_error(spark):
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "line long, down long").withColumn("one", F.lit(1))
    with pytest.raises(RuntimeError, match="stay open"):
        network.strahler(loop)
    with pytest.raises(RuntimeError, match="stay open"):
        network.jump(loop, "one")
    with pytest.raises(RuntimeError, match="stay open"):
        network.subtree_sum(loop, "one")
    assert [r["line"] for r in network.jump(loop, "one", drop_cycles=True).collect()] == [4]
    assert network.strahler(loop.limit(0)).count() == network.jump(loop.limit(0), "one").count() == 0


def plain_distances(edges, origin):
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    dist, queue = {origin: 0}, deque([origin])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in dist:
                dist[v] = dist[u] + 1
                queue.append(v)
    return dist


@pytest.mark.parametrize("extra", [0, 3, 120])
def test_braided_networks_are_turned_to_the_outlet(spark, extra):
    rng = np.random.default_rng(extra)
    tree = random_tree(200, 4, extra + 1)
    edges = [(k, v if v else 0) for k, v in tree.items()] + [(int(a), int(b)) for a, b in rng.integers(1, 201, (extra, 2))]
    edges += [(900, 901), (901, 902), (902, 900), (5, 5), (950, 951)]  # out of reach; a loop at one vertex
    edges = [(b, a) if i % 3 == 0 else (a, b) for i, (a, b) in enumerate(edges)]
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "line long, start long, end long")
    dist = plain_distances(edges, 0)
    want = {}
    for i, (a, b) in enumerate(edges):
        if a in dist and a != b:
            turned = (dist[a], a) < (dist[b], b)
            want[i] = (b, a, dist[b if not turned else a] + 1, 1) if turned else (a, b, dist[b] + 1, 0)
    got = {r["line"]: (r["start"], r["end"], r["level"], r["turned"]) for r in network.orient(d, 0).collect()}
    assert got == want
    assert network.orient(d.limit(0), 0).count() == 0


def test_walks_follow_every_branch(spark):
    rng = np.random.default_rng(4)
    links = {(k, k - 1 - int(rng.integers(0, 3))) for k in range(10, 600)} | {(k, k - 7) for k in range(50, 600, 50)} | {(2000, 2001), (2001, 2000)}
    known, starts = set(range(10)) | {300}, {599, 450, 2000, 300, 7, 5000}
    below = defaultdict(set)
    for a, b in links:
        below[a].add(b)
    want, todo = set(), [s for s in starts if s not in known]
    while todo:
        x = todo.pop()
        if x not in want:
            want.add(x)
            todo += [y for y in below[x] if y not in known]
    one = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long")
    got = [r[0] for r in network.trace_downstream(one(starts), spark.createDataFrame([*links, (None, 3), (4, None)], "from long, to long"), one(known)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    chain = spark.range(1, DEPTH + 1).selectExpr("id AS `from`", "id - 1 AS to")
    assert network.trace_downstream(one([DEPTH]), chain, one([0])).count() == DEPTH
