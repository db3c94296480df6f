"""Statistics of functional graphs: every key has one next key.

All walks advance together: f composed with itself doubles the step, so a graph of N keys takes about log2(N) joins of
N rows, each on the key, whatever its shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.loops import written


def jumps(graph: DataFrame) -> list[DataFrame]:
    """(x, y) tables of f, f**2, f**4 .. up to the first whose image shrinks no further: it has the periodic keys only."""
    out = [written(graph.select(F.col("key").alias("x"), F.col("nxt").alias("y")))]
    image = out[0].select("y").distinct().count()
    while True:
        f = out[-1]
        out.append(written(f.join(f.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))))
        smaller = out[-1].select("y").distinct().count()
        if smaller == image:
            return out
        image = smaller


def analyze(graph: DataFrame) -> DataFrame:
    """(key, periodic, tail, entry, cycle, cycle_len) for a graph (key, nxt), closed under nxt.

    tail counts the steps to the first periodic key, entry; cycle is its cycle's least key. Keys may be any type that
    can be ordered; rows with a null key or next key are left out, repeated rows count once."""
    graph = written(graph.where("key IS NOT NULL AND nxt IS NOT NULL").distinct())
    table = jumps(graph)
    periodic = written(table[-1].select(F.col("y").alias("p")).distinct())
    # keys before the first periodic one, and that one: both add up along a walk, so they double with it
    walk = table[0].join(periodic.select(F.col("p").alias("x"), F.lit(True).alias("in")), "x", "left")
    walk = walk.select("x", F.when(F.col("in"), 0).otherwise(1).cast("long").alias("tail"), F.when(F.col("in"), F.col("x")).alias("entry"))
    for f in table:
        ahead = walk.select(F.col("x").alias("y"), F.col("tail").alias("more"), F.col("entry").alias("later"))
        walk = written(walk.join(f.join(ahead, "y").select("x", "more", "later"), "x").select("x", (F.col("tail") + F.col("more")).alias("tail"), F.coalesce("entry", "later").alias("entry")))
    # least key of each cycle, by doubling among periodic keys
    label = written(table[0].join(periodic.withColumnRenamed("p", "x"), "x").select("x", "y", F.col("x").alias("low")))
    while True:
        ahead = label.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("low").alias("far"))
        moved = written(label.join(ahead, "y").select("x", F.col("z").alias("y"), "low", F.least("low", "far").alias("now")))
        changed = moved.where("now <> low").limit(1).count()
        label = moved.select("x", "y", F.col("now").alias("low"))
        if not changed:
            break
    lengths = label.groupBy("low").agg(F.count(F.lit(1)).alias("cycle_len"))
    cycles = label.join(lengths, "low").select(F.col("x").alias("entry"), F.col("low").alias("cycle"), "cycle_len")
    return walk.join(cycles, "entry").select(F.col("x").alias("key"), (F.col("tail") == 0).alias("periodic"), "tail", "entry", "cycle", "cycle_len")


def report(stats: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group: nodes, periodic keys, cycles, longest cycle, fixed points, greatest tail and how many keys
    have it, and the sum of tails."""
    sums = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(F.col("periodic").cast("long")).alias("periodic"), F.countDistinct("cycle").alias("cycles"), F.max("cycle_len").alias("longest"),
        F.sum((F.col("periodic") & (F.col("cycle_len") == 1)).cast("long")).alias("fixed"), F.max("tail").alias("max_tail"), F.sum("tail").alias("sum_tail"),
    )
    worst = stats.groupBy(*by, "tail").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max_by("n", "tail").alias("at_max_tail"))
    return sums.join(worst, by)


def orbit(stats: DataFrame, key) -> DataFrame:
    """Tail, entry and cycle length of one key's walk."""
    return stats.where(F.col("key") == key).select("key", "tail", "entry", "cycle_len")


def parameter_sums(times: DataFrame) -> DataFrame:
    """For maps x * x + c modulo n with (n, c, times), a row for each n: graphs, lines (the sum of times), cycles, sum_rho
    and weighted_rho (tails and cycle lengths of all walks, the latter by times), fixed points, and graphs that have one.
    n, c and x are below 2**20, or an error is raised; all graphs are analyzed as one, whose keys hold the three numbers."""
    small = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < 2**20), F.col(c)).otherwise(F.raise_error(F.lit("parameters must be below 2**20")).cast("long")).alias(c)
    times = written(times.select(small("n"), small("c"), "times"))
    place = lambda x: F.col("n") * 2**40 + F.col("c") * 2**20 + x
    keys = times.select("n", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"))
    stats = analyze(keys.select(place(F.col("x")).alias("key"), place((F.col("x") * F.col("x") + F.col("c")) % F.col("n")).alias("nxt")))
    own = stats.withColumns({"n": F.shiftright("key", 40), "c": F.shiftright("key", 20) % 2**20})
    graphs = own.groupBy("n", "c").agg(F.countDistinct("cycle").alias("cycles"), F.sum(F.col("tail") + F.col("cycle_len")).alias("rho"), F.count_if(F.col("periodic") & (F.col("cycle_len") == 1)).alias("fixed"))
    return graphs.join(times, ["n", "c"]).groupBy("n").agg(
        F.count(F.lit(1)).alias("graphs"), F.sum("times").alias("lines"), F.sum("cycles").alias("cycles"), F.sum("rho").alias("sum_rho"), F.sum(F.col("rho") * F.col("times")).alias("weighted_rho"),
        F.sum("fixed").alias("fixed"), F.count_if(F.col("fixed") > 0).alias("with_fixed"),
    )
