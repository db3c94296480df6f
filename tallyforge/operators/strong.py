"""Strong components of directed graphs of any size, without a closure, and the condensation.

Chains and trees go first: every cycle through a node with one in-edge passes the node before it, so such nodes are contracted
into the first node on the way back that has more, or none, by pointer doubling (about log2 of the length many joins); the same
for nodes with one out-edge, on the reverse graph. Then nodes without in- or out-edges are trimmed, and what is left is
coloured: the greatest node that reaches a node is its colour, no component has two colours, and in each colour the nodes that
reach the one it is named after are a component. Found components and edges between colours go, and it starts again.

All is joins and merging aggregates on the node, written to the shared folder each round. Rounds of the colouring grow with the
longest shortest path of what the contraction leaves, those of all else with the logarithm of the number of nodes or with the
depth of what is trimmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.loops import written

#: A contraction is worth its joins if it takes away this share of the nodes.
WORTH = 0.5


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _parents(edges: DataFrame) -> DataFrame:
    """(key, nxt): the source of a node's only in-edge, else the node itself."""
    only = edges.groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("nxt")).where("n = 1").select("key", "nxt")
    return written(_nodes(edges).withColumnRenamed("node", "key").join(only, "key", "left").select("key", F.coalesce("nxt", "key").alias("nxt")))


def _doubled(parents: DataFrame, nodes: int) -> tuple[list[DataFrame], DataFrame | None]:
    """(x, y) tables of one step to the parent, of two, four .. up to the roots; if steps go round on cycles, these cycles' least
    nodes (key) as well."""
    fixed = parents.select(F.col("key").alias("nxt"), (F.col("key") == F.col("nxt")).alias("top"))
    step = written(parents.join(fixed, "nxt").select(F.col("key").alias("x"), F.col("nxt").alias("y"), F.col("key").alias("low"), "top"))
    steps = [step.select("x", "y")]
    for _ in range(nodes.bit_length() + 1):
        if step.where("NOT top").isEmpty():
            return steps, None
        ahead = step.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("low").alias("far"), F.col("top").alias("ahead"))
        step = written(step.drop("top").join(ahead, "y").select("x", F.col("z").alias("y"), F.least("low", "far").alias("low"), F.col("ahead").alias("top")))
        steps.append(step.select("x", "y"))
    on_cycles = step.where("NOT top").select(F.col("y").alias("x")).distinct()
    return steps, step.join(on_cycles, "x").select(F.col("low").alias("key")).distinct()  # more steps than nodes: low is of the whole cycle


def _contracted(edges: DataFrame, nodes: int):
    """Edges between roots, and a function that takes their labels (node, label) to labels of all nodes. Of a cycle of nodes with
    one in-edge the least is a root."""
    parents = _parents(edges)
    steps, cycles = _doubled(parents, nodes)
    if cycles is not None:
        broken = cycles.withColumn("root", F.lit(True))
        parents = written(parents.join(broken, "key", "left").select("key", F.when(F.col("root"), F.col("key")).otherwise(F.col("nxt")).alias("nxt")))
        steps, _ = _doubled(parents, nodes)
    root = steps[-1].select(F.col("x").alias("src"), F.col("y").alias("root"))
    tree = parents.where("key <> nxt").select(F.col("nxt").alias("src"), F.col("key").alias("dst"))
    beside = written(edges.join(tree, ["src", "dst"], "left_anti").join(root, "src").select("src", "root", "dst"))  # all lead to roots
    inner = written(beside.where("root <> dst").select(F.col("root").alias("src"), "dst").distinct())

    def resolved(labels: DataFrame) -> DataFrame:
        named = beside.join(labels.select(F.col("node").alias("root"), F.col("label").alias("own")), "root", "left").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), "dst", "left")
        back = written(named.where(F.coalesce("own", "root") == F.coalesce("other", "dst")).select(F.col("src").alias("x")).distinct())
        for step in steps if not back.isEmpty() else []:  # nodes that lead to a marked one within their tree
            back = written(back.union(back.join(step, "x").select(F.col("y").alias("x"))).distinct())
        marked = back.join(root.withColumnRenamed("src", "x"), "x").join(labels.select(F.col("node").alias("root"), "label"), "root", "left")
        found = marked.select(F.col("x").alias("node"), F.coalesce("label", "root").alias("label"))
        return written(found.union(labels).distinct())

    return inner, resolved


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose source has an in-edge and whose end has an out-edge, over and over."""
    size = edges.count()
    while size:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = written(kept.select("src", "dst"))
        left = kept.count()
        if left == size:
            return kept
        edges, size = kept, left
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node from which a walk leads to the node, or itself."""
    colours = written(_nodes(edges).withColumn("colour", F.col("node")))
    while True:
        heard = edges.join(colours.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("near"))
        new = written(colours.join(heard, "node", "left").select("node", F.col("colour").alias("was"), F.greatest("colour", F.coalesce("near", "colour")).alias("colour")))
        if new.where("was <> colour").isEmpty():
            return new.select("node", "colour")
        colours = new.select("node", "colour")


def _labels(edges: DataFrame) -> DataFrame:
    """(node, label) of nodes in components of two nodes or more; equal labels within a component."""
    nodes = _nodes(edges).count()
    if not nodes:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    for turned in (False, True):
        way = _reversed(edges) if turned else edges
        single = way.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n = 1").count()
        if single >= WORTH * nodes:
            inner, resolved = _contracted(way, nodes)
            return resolved(_labels(inner))
    labels = None
    edges = _trimmed(edges)
    while not edges.isEmpty():
        colours = _coloured(edges)
        ends = {end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"of_{end}")) for end in ("src", "dst")}
        within = written(edges.join(ends["src"], "src").join(ends["dst"], "dst").where("of_src = of_dst").select("src", "dst"))
        member = frontier = written(colours.where("node = colour").select("node", F.col("colour").alias("label")))
        while not frontier.isEmpty():
            step = within.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "label").distinct()
            frontier = written(step.join(member, "node", "left_anti").select("node", "label"))
            member = written(member.union(frontier))
        gone = member.select("node")
        left = within.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        edges = _trimmed(written(left.select("src", "dst")))
        labels = member if labels is None else written(labels.union(member))
    return labels if labels is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("label"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other, by the least of them; a node on no cycle is alone. Edges with a null end
    are left out, loops and repeated edges count for nothing."""
    given = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    labels = _labels(written(given.where("src <> dst").distinct()))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return written(_nodes(given).join(labels.join(least, "label").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def condensation(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(component, size, in_edges, out_edges): the graph's components as nodes, with the numbers of other components that edges
    come from and lead to; 0 makes a source or a sink."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ends = {end: components.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("src", "dst")}
    between = written(edges.select("src", "dst").join(ends["src"], "src").join(ends["dst"], "dst").where("of_src <> of_dst").select("of_src", "of_dst").distinct())
    counted = {end: between.groupBy(F.col(f"of_{end}").alias("component")).agg(F.count(F.lit(1)).alias(name)) for end, name in (("dst", "in_edges"), ("src", "out_edges"))}
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sizes.join(counted["dst"], "component", "left").join(counted["src"], "component", "left").select("component", "size", zero("in_edges"), zero("out_edges"))
