"""Reachability and shortest paths against plain searches."""

import random

from waymark.operators import graph


def plain_path(edges, start, goal):
    best, frontier = {start: []}, {start: []}
    while frontier and goal not in best:
        nxt = {}
        for src, path in frontier.items():
            for e in edges:
                if e[0] == src and e[1] not in best:
                    nxt[e[1]] = min(nxt.get(e[1], [(9e9,)]), [*path, (e[2], e[0], e[1])])
        best |= nxt
        frontier = nxt
    return best.get(goal, [])


def test_searches_on_a_random_graph_and_a_chain(spark):
    r = random.Random(4)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}", i) for i in range(70)] + [(f"c{i}", f"c{i + 1}", 100 + i) for i in range(12)]
    table = spark.createDataFrame(edges, "src string, dst string, seq long")
    got = {x["node"]: x["hops"] for x in graph.reachable(table, "c0").collect()}
    assert got == {f"c{i}": i for i in range(1, 13)}
    assert graph.reachable(table, "nowhere").count() == 0
    far = max((f"n{i}" for i in range(40)), key=lambda n: len(plain_path(edges, "n15", n)))
    for start, goal in (("n15", far), ("c0", "c12"), ("n15", "n15"), ("c3", "n0")):
        want = [] if start == goal else plain_path(edges, start, goal)
        rows = graph.shortest_path(table, start, goal).orderBy("step").collect()
        assert [(x["seq"], x["src"], x["dst"]) for x in rows] == want
    assert len(plain_path(edges, "n15", far)) == 2


def test_a_wide_hop_writes_only_its_new_nodes(spark):
    edges = [("s", f"w{i}", i) for i in range(3_000)] + [(f"w{i}", f"w{(i * 7) % 3_000}", 5_000 + i) for i in range(3_000)] + [("w9", "end", 9_000)]
    table = spark.createDataFrame(edges, "src string, dst string, seq long")
    got = graph.reachable(table, "s").groupBy("hops").count().collect()
    assert {x["hops"]: x["count"] for x in got} == {1: 3_000, 2: 1}
    assert [x["dst"] for x in graph.shortest_path(table, "s", "end").orderBy("step").collect()] == ["w9", "end"]
