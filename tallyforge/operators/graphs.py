"""Graph operators as joins: closure, components, simple paths, independent sets, tournaments, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import kernels as K
from tallyforge.operators.loops import cut, merged
from tallyforge.operators.strong import strong_components  # noqa: F401  a part of this module's interface


def closure(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(src, dst, dist): all pairs with a walk of at least one edge, by the shortest; layer by layer, each new pair once."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(edges.select("src", "dst", F.lit(1).cast("long").alias("dist")))
    dist = 1
    while longest is None or dist < longest:
        dist += 1
        step = frontier.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(step.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(dist).cast("long")))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen


def reachable_states(start: DataFrame, successors, columns: list[str]) -> DataFrame:
    """All states from ``start`` by successors(frontier), a DataFrame of the same columns; each state is expanded once."""
    seen = frontier = cut(start.select(*columns).distinct())
    while not frontier.isEmpty():
        frontier = cut(successors(frontier).select(*columns).distinct().join(seen, columns, "left_anti"))
        seen = cut(seen.union(frontier))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of each undirected component; labels spread to neighbours and jump to labels."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = cut(both.select(F.col("src").alias("node")).distinct().withColumn("low", F.col("node")))
    while True:
        heard = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("low").alias("near")).withColumnRenamed("src", "node")
        new = label.join(heard, "node").select("node", "low", F.least("low", "near").alias("now"))
        jumped = new.join(label.select(F.col("node").alias("now"), F.col("low").alias("far")), "now").select("node", "low", F.least("now", "far").alias("now"))
        jumped = cut(jumped)
        if not jumped.where("now <> low").limit(1).count():
            return jumped.select("node", F.col("now").alias("component"))
        label = jumped.select("node", F.col("now").alias("low"))


def _in_masks(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with a check that the nodes in these columns have a place in a mask: 0 to 62, else an error is raised."""
    return df.withColumns({c: K.place_in_mask(F.col(c)) for c in columns})


def girth(edges: DataFrame) -> DataFrame:
    """(girth, through): length of the shortest directed cycle and how many nodes lie on one of that length."""
    back = closure(edges).where("src = dst").groupBy("dist").agg(F.count(F.lit(1)).alias("through"))
    return back.orderBy("dist").limit(1).select(F.col("dist").alias("girth"), "through")


def simple_paths(edges: DataFrame, start: DataFrame, longest: int) -> DataFrame:
    """(length, paths, cyclic) of simple paths from ``start`` (node) by their number of edges; cyclic ones can close.

    Nodes are numbers from 0 to 62; others raise an error. Paths with the same head, first node and visited set are one state with a count, so
    rows grow with the number of sets, not of paths."""
    edges = cut(_in_masks(edges.select("src", "dst").distinct(), "src", "dst"))
    level = _in_masks(start.select("node"), "node").select(F.col("node").alias("first"), F.col("node").alias("head"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("node").cast("int")).alias("mask"), F.lit(1).cast("decimal(38,0)").alias("cnt"))
    out = None
    for length in range(1, longest + 1):
        moved = level.join(edges.withColumnRenamed("src", "head"), "head").where(K.bit(F.col("mask"), F.col("dst")) == 0)
        moved = moved.select("first", F.col("dst").alias("head"), F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("dst").cast("int"))).alias("mask"), "cnt")
        level = cut(merged(moved, ["first", "head", "mask"]))
        closing = level.join(edges.select(F.col("src").alias("head"), F.col("dst").alias("first"), F.lit(1).alias("closes")), ["head", "first"], "left")
        row = closing.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("paths"), F.coalesce(F.sum(F.when(F.col("closes") == 1, F.col("cnt"))), F.lit(0)).cast("long").alias("cyclic"))
        row = row.select(F.lit(length).cast("long").alias("length"), "paths", "cyclic")
        out = row if out is None else out.union(row)
    return out


def hamiltonian_cycles(edges: DataFrame, vertices: int) -> int:
    """Undirected Hamiltonian cycles of a symmetric graph on 0 .. vertices-1 (at least 3): closed paths from 0, halved."""
    start = edges.sparkSession.range(1).withColumnRenamed("id", "node")
    last = simple_paths(edges, start, vertices - 1).where(F.col("length") == vertices - 1).first()
    return last["cyclic"] // 2


def independent_sets(edges: DataFrame, nodes: DataFrame, largest: int) -> DataFrame:
    """(size, sets) of independent sets of nodes (0 to 62; others raise an error) up to a size. A set grows by greater nodes only."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).cast("int"))
    edges, nodes = _in_masks(edges.select("src", "dst"), "src", "dst"), _in_masks(nodes.select("node"), "node")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    shadow = both.groupBy(F.col("src").alias("node")).agg(F.bit_or(one("dst")).alias("shadow"))
    nodes = cut(nodes.select("node").distinct().join(shadow, "node", "left").select("node", F.coalesce("shadow", F.lit(0).cast("long")).alias("shadow")))
    level = nodes.select(F.col("node").alias("last"), F.col("shadow").alias("taken"))
    out = None
    for size in range(1, largest + 1):
        row = level.agg(F.count(F.lit(1)).alias("sets")).select(F.lit(size).cast("long").alias("size"), "sets")
        out = row if out is None else out.union(row)
        if size < largest:
            level = level.join(nodes, (F.col("node") > F.col("last")) & (K.bit(F.col("taken"), F.col("node")) == 0)).select(F.col("node").alias("last"), F.col("taken").bitwiseOR(F.col("shadow")).alias("taken"))
            # sets with the same last node and shadow behave alike, yet are counted one by one only at the end
            level = cut(level)
    return out


def tournament(scores: DataFrame, item: str, period: str, score: str) -> DataFrame:
    """(a, b, rel) for a < b: 1 if a has the greater score in more of the periods that both have, -1 if b, else 0.
    Items meet in the periods that they share, so pairs come from an equi join."""
    one = scores.select(F.col(item).alias("a"), F.col(period).alias("t"), F.col(score).alias("x"))
    two = scores.select(F.col(item).alias("b"), F.col(period).alias("t"), F.col(score).alias("y"))
    met = one.join(two, "t").where("a < b")
    return met.groupBy("a", "b").agg(F.signum(F.sum(F.signum(F.col("x") - F.col("y")))).cast("long").alias("rel"))


def invariants(relation: DataFrame) -> DataFrame:
    """(items, ties, max_out, at_max, cyc3, trans3) of a tournament's relation (a, b, rel); triads by joins of wins."""
    wins = cut(relation.where("rel = 1").select(F.col("a").alias("w"), F.col("b").alias("l")).union(relation.where("rel = -1").select(F.col("b").alias("w"), F.col("a").alias("l"))))
    items = relation.select(F.col("a").alias("i")).union(relation.select("b")).distinct().agg(F.count(F.lit(1)).alias("items"))
    ties = relation.agg(F.coalesce(F.sum((F.col("rel") == 0).cast("long")), F.lit(0)).alias("ties"))
    out = wins.groupBy("w").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    top = out.agg(F.max("n").alias("max_out"), F.max_by("m", "n").alias("at_max"))
    two = wins.select(F.col("w").alias("x"), F.col("l").alias("y")).join(wins.select(F.col("w").alias("y"), F.col("l").alias("z")), "y")
    cycles = two.join(wins.select(F.col("w").alias("z"), F.col("l").alias("x")), ["x", "z"]).agg((F.count(F.lit(1)) / 3).cast("long").alias("cyc3"))
    chains = two.join(wins.select(F.col("w").alias("x"), F.col("l").alias("z")), ["x", "z"]).agg(F.count(F.lit(1)).alias("trans3"))
    return items.crossJoin(ties).crossJoin(top).crossJoin(cycles).crossJoin(chains)  # one row each


def validated(edges: DataFrame, vertices: int) -> DataFrame:
    """(fault, src, dst): edges out of range, loops, repeats, and edges without their reverse."""
    mark = lambda df, name: df.select(F.lit(name).alias("fault"), "src", "dst")
    out = mark(edges.where((F.col("src") < 0) | (F.col("src") >= vertices) | (F.col("dst") < 0) | (F.col("dst") >= vertices)), "range")
    loops = mark(edges.where("src = dst"), "loop")
    twice = mark(edges.groupBy("src", "dst").count().where("count > 1"), "repeat")
    one_way = mark(edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti"), "one_way")
    return out.union(loops).union(twice).union(one_way)


def cut_width(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(width) of an order (node, pos): the most edges that span a gap. Ends are summed by place before the running sum,
    which has as many rows as there are nodes."""
    from pyspark.sql import Window

    ends = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    placed = ends.join(positions.toDF("src", "a"), "src").join(positions.toDF("dst", "b"), "dst")
    marks = placed.select(F.explode(F.array(F.struct(F.least("a", "b").alias("pos"), F.lit(1).alias("x")), F.struct(F.greatest("a", "b").alias("pos"), F.lit(-1).alias("x")))).alias("m")).select("m.*").groupBy("pos").agg(F.sum("x").alias("x"))
    return marks.select(F.sum("x").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("w")).agg(F.max("w").alias("width"))


def breadth_first(edges: DataFrame, root: int) -> DataFrame:
    """(node, pos): nodes that edges link to the root, by their distance, then number. Ranks are taken within a distance
    and moved by the number of nodes nearer."""
    from pyspark.sql import Window

    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = frontier = cut(edges.sparkSession.createDataFrame([(root, 0)], "node long, dist long"))
    dist = 0
    while not frontier.isEmpty():
        dist += 1
        step = frontier.select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(step.withColumn("dist", F.lit(dist).cast("long")))
        seen = cut(seen.union(frontier))
    sizes = seen.groupBy("dist").agg(F.count(F.lit(1)).alias("n"))
    nearer = sizes.select("dist", F.coalesce(F.sum("n").over(Window.orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("nearer"))
    ranked = seen.withColumn("r", F.row_number().over(Window.partitionBy("dist").orderBy("node")))
    return ranked.join(nearer, "dist").select("node", (F.col("nearer") + F.col("r") - 1).alias("pos"))


def degree_profile(edges: DataFrame) -> DataFrame:
    """(degree, nodes) of out-degrees."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def structure_report(relation: DataFrame) -> DataFrame:
    """One row for a tournament's relation (a, b, rel): items, least_wins, most_wins, regular, transitive (no two have as
    many wins), kings (who reach every other by one win or two) and blocks: prefixes of the ascending scores whose sum is
    no more than their games among themselves."""
    from pyspark.sql import Window

    wins = cut(relation.where("rel = 1").select(F.col("a").alias("w"), F.col("b").alias("l")).union(relation.where("rel = -1").select(F.col("b").alias("w"), F.col("a").alias("l"))))
    nodes = relation.select(F.col("a").alias("i")).union(relation.select("b")).distinct()
    scores = cut(nodes.join(wins.groupBy(F.col("w").alias("i")).agg(F.count(F.lit(1)).alias("n")), "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("d")))
    shape = scores.agg(F.count(F.lit(1)).alias("items"), F.min("d").alias("least_wins"), F.max("d").alias("most_wins"), (F.min("d") == F.max("d")).alias("regular"), (F.countDistinct("d") == F.count(F.lit(1))).alias("transitive"))
    two = wins.select(F.col("w").alias("x"), F.col("l").alias("y")).join(wins.select(F.col("w").alias("y"), F.col("l").alias("z")), "y").where("x <> z")
    reached = wins.union(two.select("x", "z")).distinct().groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    kings = reached.groupBy("n").agg(F.count(F.lit(1)).alias("kings"))
    # scores are few numbers: prefixes within one score are counted by formula, from sums of the scores below
    by = scores.groupBy("d").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    runs = by.select("d", "k", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("r"), F.coalesce(F.sum(F.col("d") * F.col("k")).over(before), F.lit(0)).alias("s"))
    place = runs.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("j"), "d", "r", "s").select((F.col("r") + F.col("j")).alias("r"), (F.col("s") + F.col("j") * F.col("d")).alias("s"))
    blocks = place.agg(F.count_if(2 * F.col("s") == F.col("r") * (F.col("r") - 1)).alias("blocks"))
    found = shape.join(kings, F.col("n") == F.col("items") - 1, "left")
    return found.crossJoin(blocks).select("items", "least_wins", "most_wins", "regular", "transitive", F.coalesce("kings", F.lit(0)).alias("kings"), "blocks")  # one row each


def girth_witness(edges: DataFrame) -> DataFrame:
    """(girth, witness): the shortest directed cycle's length and the first such cycle, as its nodes joined by dashes. For
    each pair of ends the least walk is kept; the first layer in which one closes is the last."""
    edges = cut(edges.select("src", "dst").distinct())
    level = cut(edges.select(F.col("src").alias("first"), F.col("dst").alias("head"), F.array("src", "dst").alias("path")))
    length, nodes = 1, edges.select("src").distinct().count()
    while length <= nodes and not level.isEmpty():
        closed = level.where("first = head")
        if not closed.isEmpty():
            return closed.agg(F.min("path").alias("path")).select(F.lit(length).cast("long").alias("girth"), F.array_join(F.col("path").cast("array<string>"), "-").alias("witness"))
        moved = level.join(edges.withColumnRenamed("src", "head"), "head")
        level = cut(moved.groupBy("first", F.col("dst").alias("head")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        length += 1
    return edges.sparkSession.createDataFrame([], "girth long, witness string")


def largest_independent_sets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(largest, sets): the size of the largest independent sets of nodes (0 to 62; others raise an error), and their number. Sets with
    the same last node and the same nodes barred are one state with a count."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).cast("int"))
    edges, nodes = _in_masks(edges.select("src", "dst"), "src", "dst"), _in_masks(nodes.select("node"), "node")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    shadow = both.groupBy(F.col("src").alias("node")).agg(F.bit_or(one("dst")).alias("shadow"))
    nodes = cut(nodes.select("node").distinct().join(shadow, "node", "left").select("node", F.coalesce("shadow", F.lit(0).cast("long")).alias("shadow")))
    level, size = nodes.select(F.col("node").alias("last"), F.col("shadow").alias("barred"), F.lit(1).cast("decimal(38,0)").alias("cnt")), 1
    level = cut(level)
    while True:
        free = F.filter(F.sequence(F.col("last") + 1, F.greatest(F.col("last") + 1, F.lit(62).cast("long"))), lambda x: K.bit(F.col("barred"), x) == 0)
        grown = level.select("barred", "cnt", F.explode(free).alias("node")).join(nodes, "node")
        grown = cut(merged(grown.select(F.col("node").alias("last"), F.col("barred").bitwiseOR(F.col("shadow")).alias("barred"), "cnt"), ["last", "barred"]))
        if grown.isEmpty():
            return level.agg(F.sum("cnt").cast("long").alias("sets")).where("sets IS NOT NULL").select(F.lit(size).cast("long").alias("largest"), "sets")
        level, size = grown, size + 1


def dive_estimate(edges: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """(length, alive, weight, squares) of random dives from ``starts`` (id, head) along unvisited neighbours: weight sums
    the products of the choices that dives had, so weight / dives estimates the simple paths from a start. A choice comes
    from the MD5 of id and length: the same in each run. Nodes are numbers from 0 to 62; others raise an error."""
    ways = _in_masks(edges.select("src", "dst"), "src", "dst").groupBy(F.col("src").alias("head")).agg(F.array_sort(F.collect_set("dst")).alias("ways"))  # 62 at most
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).cast("int"))
    ways = cut(ways)
    level = _in_masks(starts.select("id", "head"), "head").select("id", "head", one("head").alias("mask"), F.lit(1).cast("long").alias("weight"))
    out = None
    for length in range(longest):
        open_ways = F.filter("ways", lambda x: K.bit(F.col("mask"), x) == 0)
        drawn = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{length}")).cast("binary")), 1, 6), 16, 10).cast("long")
        moved = level.join(ways, "head").select("id", "mask", "weight", open_ways.alias("open")).where(F.size("open") > 0)
        moved = moved.select("id", "mask", (F.col("weight") * F.size("open")).alias("weight"), F.get("open", (drawn % F.size("open")).cast("int")).alias("head"))
        level = cut(moved.select("id", "head", F.col("mask").bitwiseOR(one("head")).alias("mask"), "weight"))
        row = level.agg(F.count(F.lit(1)).alias("alive"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("squares")).where("alive > 0")
        row = row.select(F.lit(length + 1).cast("long").alias("length"), "alive", "weight", "squares")
        out = row if out is None else out.union(row)
    return out


def bitset_triads(wins: DataFrame) -> DataFrame:
    """(cyc3, trans3) of wins (w, l) among nodes numbered from 0: for each win the nodes that both ends beat, and those
    the loser beats and the winner loses to, by common bits of masks. A mask holds 62 nodes, further nodes further masks."""
    wins = cut(wins.select("w", "l").distinct())
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(c) % 62).cast("int"))
    masks = lambda node, other, name: wins.groupBy(F.col(node).alias("node"), F.floor(F.col(other) / 62).alias("part")).agg(F.bit_or(one(other)).alias(name))
    beats, loses = cut(masks("w", "l", "beats")), masks("l", "w", "loses")
    of_loser = wins.join(beats.select(F.col("node").alias("l"), "part", F.col("beats").alias("theirs")), "l")
    of_winner = beats.join(loses, ["node", "part"], "full").withColumnRenamed("node", "w")
    common = lambda c: F.coalesce(F.sum(F.bit_count(F.col("theirs").bitwiseAND(F.coalesce(c, F.lit(0).cast("long")))).cast("long")), F.lit(0))
    return of_loser.join(of_winner, ["w", "part"]).agg((common("loses") / 3).cast("long").alias("cyc3"), common("beats").alias("trans3"))


def neighbour_masks(edges: DataFrame) -> DataFrame:
    """(node, adj): the nodes (0 to 62; others raise an error) that a node's edges lead to, as a mask."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("dst").cast("int"))
    return _in_masks(edges.select("src", "dst"), "src", "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or(one).alias("adj"))


def prefixes(edges: DataFrame, length: int) -> DataFrame:
    """(path, mask): simple paths with so many edges, as arrays of nodes (0 to 62; others raise an error)."""
    edges = cut(_in_masks(edges.select("src", "dst").distinct().where("src <> dst"), "src", "dst"))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).cast("int"))
    level = edges.select(F.array("src", "dst").alias("path"), one("src").bitwiseOR(one("dst")).alias("mask"))
    for _ in range(length - 1):
        level = level.withColumn("src", F.element_at("path", -1)).join(edges, "src").where(K.bit(F.col("mask"), F.col("dst")) == 0)
        level = level.select(F.concat("path", F.array("dst")).alias("path"), F.col("mask").bitwiseOR(one("dst")).alias("mask"))
    return level


def prefix_jobs(edges: DataFrame, length: int) -> DataFrame:
    """(first, jobs, paths, ahead) of a symmetric graph's simple paths with so many edges: a job is a path that is not
    greater than its reverse, standing for both; ahead counts the paths with one more edge, which are not built: their
    ends are bits of the last node's mask outside the path."""
    adjacent = cut(neighbour_masks(edges))
    jobs = prefixes(edges, length).where(F.col("path") <= F.reverse("path"))
    ends = {"tail": F.element_at("path", 1), "head": F.element_at("path", -1)}
    for name, end in ends.items():
        jobs = jobs.withColumn("node", end).join(adjacent, "node", "left").withColumn(name, F.bit_count(F.coalesce("adj", F.lit(0).cast("long")).bitwiseAND(F.bitwise_not("mask"))).cast("long")).drop("node", "adj")
    own = F.col("path") == F.reverse("path")
    return jobs.groupBy(F.element_at("path", 1).alias("first")).agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.when(own, 1).otherwise(2)).alias("paths"), F.sum(F.when(own, F.col("head")).otherwise(F.col("head") + F.col("tail"))).alias("ahead"))


def viable_prefixes(edges: DataFrame, nodes: DataFrame, length: int) -> DataFrame:
    """(first, prefixes, by_degree, connected, viable) of a symmetric graph's simple paths with so many edges that a
    Hamiltonian cycle may begin with: each node off the path needs two neighbours off it or at its ends, and these nodes
    with the ends must be connected. Nodes are numbers from 0 to 62, so that all masks are an array of 63
    numbers; others raise an error."""
    full = _in_masks(nodes.select("node").distinct(), "node").join(neighbour_masks(edges), "node", "left").select("node", F.coalesce("adj", F.lit(0).cast("long")).alias("adj"))
    listed = {r["node"]: r["adj"] for r in full.collect()}  # 63 at most
    if not listed:
        return edges.sparkSession.createDataFrame([], "first long, prefixes long, by_degree long, connected long, viable long")
    known = F.array(*[F.lit(v).cast("long") for v in sorted(listed)])
    masks = F.array(*[F.lit(listed.get(i, 0)).cast("long") for i in range(max(listed) + 1)])
    whole = sum(1 << v for v in listed)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))
    adj = lambda v: F.element_at("masks", (v + 1).cast("int"))
    found = prefixes(edges, length).select("path", "mask", F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("head"), masks.alias("masks"), known.alias("known"))
    found = found.withColumn("off", F.bitwise_not("mask").bitwiseAND(F.lit(whole).cast("long")))
    found = found.withColumn("open", F.col("off").bitwiseOR(one(F.col("first"))).bitwiseOR(one(F.col("head"))))
    degree = F.forall("known", lambda v: (K.bit(F.col("off"), v) == 0) | (F.bit_count(adj(v).bitwiseAND(F.col("open"))) >= 2))
    near = lambda seen: F.aggregate(F.col("known"), seen, lambda a, v: F.when(K.bit(seen, v) == 1, a.bitwiseOR(adj(v))).otherwise(a)).bitwiseAND(F.col("open"))
    spread = F.aggregate(F.col("known"), one(F.col("head")), lambda seen, _: near(seen))
    judged = found.select("first", degree.alias("degree"), (spread == F.col("open")).alias("joined"))
    return judged.groupBy("first").agg(F.count(F.lit(1)).alias("prefixes"), F.count_if("degree").alias("by_degree"), F.count_if("joined").alias("connected"), F.count_if(F.col("degree") & F.col("joined")).alias("viable"))
