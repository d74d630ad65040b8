"""Parent-child rows to full hierarchies: root, depth, path, descendants and rings of each node.

Components are found first, each component is brought to one task, and an
iterative depth-first walk colours its nodes. A component of more than
``max_component`` nodes never comes to one task: its nodes are solved by
doubling the ancestor pointers in Spark, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators.components import connected_components
from pagemill.session import cut

SCHEMA = "node string, root string, depth int, path array<string>, descendants bigint, ring string"
MAX_COMPONENT = 200_000


def walk(children: list[str], parents: list[str], paths: bool = True) -> Iterator[tuple]:
    """Depth-first walk over whole components given as parallel lists of edges, one parent a child.

    White nodes are untouched, grey ones on the current path, black ones done; an
    edge to a grey node is a back edge and closes a ring. Rows are as in SCHEMA and come as nodes
    turn black, so that only the current path is held; without ``paths``, paths and descendants are null.
    """
    parent = dict(zip(children, parents))
    below: dict[str, list[str]] = {}
    for c, p in parent.items():
        below.setdefault(p, []).append(c)
    reached: set[str] = set()
    for root in [p for p in below if p not in parent]:
        path: list[str] = []
        sizes: list[int] = []  # of the subtrees of the grey nodes, so far
        stack: list[tuple[str, bool]] = [(root, False)]
        while stack:
            node, leave = stack.pop()
            if leave:
                size = sizes.pop()
                yield node, root, len(path) - 1, list(path) if paths else None, size if paths else None, None
                path.pop()
                if sizes:
                    sizes[-1] += size + 1
                continue
            reached.add(node)
            path.append(node)
            sizes.append(0)
            stack.append((node, True))
            stack.extend((k, False) for k in below.get(node, ()))
    # what no root reaches hangs on a ring: follow parents until a colour is met
    colour: dict[str, int] = {}
    ring_of: dict[str, str | None] = {}
    for start in parent:
        if start in reached or start in colour:
            continue
        trail, node = [], start
        while node not in colour:
            colour[node] = 1
            trail.append(node)
            node = parent[node]
        if colour[node] == 1:
            ring = trail[trail.index(node) :]
            ring_of |= dict.fromkeys(ring, min(ring))
        for n in trail:
            colour[n] = 2
            ring_of.setdefault(n, None)
    for n, ring in ring_of.items():
        yield n, "", -1, None, None, ring


_ARROW = pa.schema([("node", pa.string()), ("root", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("descendants", pa.int64()), ("ring", pa.string())])
#: rows, or members of paths, that one batch holds at most
_BATCH = 50_000


def _walker(paths: bool):
    def solved(kids: list[str], tops: list[str]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for row in walk(kids, tops, paths):
            rows.append(row)
            size += 1 + len(row[3] or ())
            if size >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, child, parent) come sorted by component; whole components are walked together."""
        comps: list[str] = []
        kids: list[str] = []
        tops: list[str] = []
        for b in given:
            comps += b.column(0).to_pylist()
            kids += b.column(1).to_pylist()
            tops += b.column(2).to_pylist()
            end = len(comps)
            while end and comps[end - 1] == comps[-1]:
                end -= 1
            if end:
                yield from solved(kids[:end], tops[:end])
                comps, kids, tops = comps[end:], kids[end:], tops[end:]
        if comps:
            yield from solved(kids, tops)

    return batches


def _climb(edges: DataFrame, keep: bool) -> tuple[DataFrame, DataFrame]:
    """(node, root, depth, over) of the nodes that end at a root, and (node, up) of those that reach none.

    Pointers double each round. ``over`` holds the ancestors, root first, where ``keep``.
    """
    no_path = F.array().cast("array<string>")
    open_ = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).alias("depth"), (F.array("parent") if keep else no_path).alias("over")))
    tops = cut(open_.select(F.col("up").alias("node")).distinct().join(open_.select("node"), "node", "left_anti"))
    n, reach = open_.count(), 1
    done = tops.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), no_path.alias("over"))
    while True:
        at_top = open_.join(tops.select(F.col("node").alias("up")), "up", "left_semi")
        done = cut(done.unionByName(at_top.select("node", F.col("up").alias("root"), "depth", "over")))
        rest = cut(open_.join(at_top.select("node"), "node", "left_anti"))
        if reach > n or rest.isEmpty():
            return done, rest.select("node", "up")
        # a pointer to a solved node moves to that node's root, one to an open node doubles
        ahead = rest.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"), F.col("over").alias("over2")).unionByName(
            done.select(F.col("node").alias("up"), F.col("root").alias("up2"), F.col("depth").alias("more"), F.col("over").alias("over2"))
        )
        open_ = cut(rest.join(ahead, "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("over2", "over").alias("over")))
        reach *= 2


def _doubled(edges: DataFrame, paths: bool) -> DataFrame:
    """The rows of SCHEMA by pointer doubling, for components too large for one task."""
    done, lost = _climb(edges, keep=False)
    lost = cut(lost)
    if paths:
        done, _ = _climb(edges.join(lost.select(F.col("node").alias("child")), "child", "left_anti"), keep=True)
        full = cut(done.select("node", "root", F.size("over").alias("depth"), F.concat("over", F.array("node")).alias("path")))
        below = full.select(F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("node")).groupBy("node").agg(F.count("*").alias("descendants"))
        full = full.join(below, "node", "left").withColumn("descendants", F.coalesce("descendants", F.lit(0)).cast("long"))
    else:
        full = done.select("node", "root", "depth", F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("descendants"))
    # after at least as many steps as there are nodes, the pointers that are left stand on the rings and cover them
    members = lost.select(F.col("up").alias("child")).distinct()
    rings = connected_components(edges.join(members, "child", "left_semi"), "child", "parent").withColumnRenamed("component", "ring")
    off = lost.select("node").join(rings, "node", "left").select(
        "node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("descendants"), "ring"
    )
    return full.withColumn("ring", F.lit(None).cast("string")).unionByName(off)


def hierarchies(edges: DataFrame, child: str, parent: str, max_component: int = MAX_COMPONENT, paths: bool = True) -> DataFrame:
    """For every node of the parent-child rows: node, root, depth, path, descendants, ring.

    Paths of a deep tree are together far larger than the tree; without ``paths``, path and descendants are null.

    ``path`` runs from the root to the node and ``descendants`` counts what hangs
    below it. A node on a ring or below one has root '', depth -1 and null path and
    descendants; ``ring`` is the least node of the ring for the ring's own nodes.
    Rows with a null end are left out, repeated rows count once, other columns do
    not matter. A child with several parents keeps the least one. An empty input
    gives an empty result. A row whose child is its own parent is a ring of one.
    """
    e = (
        edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
        .where("child is not null and parent is not null")
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )
    e = cut(e)
    comp = connected_components(e, "child", "parent")
    placed = cut(e.join(comp.withColumnRenamed("node", "child"), "child"))
    # components above the bound number at most rows / max_component
    large = cut(placed.groupBy("component").count().where(F.col("count") > max_component).select("component"))
    if large.isEmpty():
        small, big = placed, None
    else:
        small = placed.join(large, "component", "left_anti")
        big = placed.join(large, "component", "left_semi").select("child", "parent")
    walked = (
        small.select("component", "child", "parent")
        .repartition("component")
        .sortWithinPartitions("component")
        .mapInArrow(_walker(paths), SCHEMA)
    )
    return walked if big is None else walked.unionByName(_doubled(cut(big), paths))


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node below another, from the paths of ``hierarchies``."""
    return (
        tree.where("path is not null")
        .select(F.col("node").alias("descendant"), "depth", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "ancestor"))
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )
