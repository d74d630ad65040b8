import random

import pytest

from pagemill.operators.components import connected_components
from pagemill.operators.hierarchy import descendant_pairs, hierarchies


def brute(parent):
    out = {}
    for node in set(parent) | set(parent.values()):
        path, at, seen = [node], node, {node}
        while at in parent:
            at = parent[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        out[node] = (path[-1], len(path) - 1, list(reversed(path))) if path else ("", -1, None)
    return out


def forest(seed, n):
    r = random.Random(seed)
    parent = {f"n{i:03}": f"n{r.randrange(i):03}" for i in range(1, n) if r.random() < 0.9}
    parent |= {"r1": "r2", "r2": "r3", "r3": "r1", "below": "r2", "deep": "below", "self": "self"}
    return parent


@pytest.mark.parametrize("most", [100_000, 4])
def test_against_brute_force(spark, most):
    parent = forest(1, 60)
    rows = [(c, p, "x") for c, p in parent.items()] * 2 + [(None, "n001", "x"), ("n001", None, "x")]
    got = {r.node: r for r in hierarchies(spark.createDataFrame(rows, "node string, root string, path string"), "node", "root", most).collect()}
    want = brute(parent)
    assert set(got) == set(want)
    for node, (root, depth, path) in want.items():
        assert (got[node].root, got[node].depth, got[node].path) == (root, depth, path)
    for node in want:
        if want[node][1] >= 0:
            assert got[node].descendants == sum(node in (w[2] or [])[:-1] for w in want.values())
    bare = hierarchies(spark.createDataFrame(rows, "node string, root string, path string"), "node", "root", most, paths=False).collect()
    assert {(r.node, r.root, r.depth) for r in bare} == {(n, w[0], w[1]) for n, w in want.items()} and len(bare) == len(want) and all(r.path is None for r in bare)
    assert {n for n, r in got.items() if r.ring == "r1"} == {"r1", "r2", "r3"} and got["self"].ring == "self" and got["below"].ring is None


def test_deep_chain_and_several_parents(spark):
    rows = [(f"{i:05}", f"{i - 1:05}") for i in range(1, 1500)] + [("b", "z"), ("b", "a")]
    got = {r.node: r for r in hierarchies(spark.createDataFrame(rows, "c string, p string"), "c", "p").collect()}
    assert got["01499"].depth == 1499 and got["00000"].descendants == 1499
    assert got["b"].root == "a" and "z" not in got


def test_empty(spark):
    none = spark.createDataFrame([], "c string, p string")
    assert hierarchies(none, "c", "p").collect() == []
    assert descendant_pairs(hierarchies(none, "c", "p")).collect() == []


def test_components(spark):
    r = random.Random(3)
    edges = [(f"{r.randrange(200)}", f"{r.randrange(200)}") for _ in range(120)] + [("hub", f"s{i}") for i in range(300)] + [("x", None)]
    got = {n.node: n.component for n in connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    group = {n: {n} for e in edges if None not in e for n in e}
    for a, b in edges:
        if b is not None and group[a] is not group[b]:
            union = group[a] | group[b]
            for n in union:
                group[n] = union
    assert got == {n: min(g) for n, g in group.items()}
