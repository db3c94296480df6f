"""Transfer and dynamic-programming operators: state tables times transition tables, summed by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import generators, kernels as K
from tallyforge.operators.loops import cut, merged


def multiply(a: DataFrame, b: DataFrame, modulus: int | None = None) -> DataFrame:
    """(i, j, v) of a sparse matrix product, exactly or modulo a number below 2**31."""
    pairs = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    if modulus:
        return pairs.groupBy("i", "j").agg((F.sum((F.pmod(F.col("x"), F.lit(modulus)) * F.pmod(F.col("y"), F.lit(modulus))) % modulus) % modulus).alias("v"))
    return pairs.groupBy("i", "j").agg(F.sum((F.col("x").cast("decimal(19,0)") * F.col("y").cast("decimal(19,0)")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("v"))


def iterate(start: DataFrame, transitions: DataFrame, steps: int, modulus: int | None = None) -> DataFrame:
    """(state, cnt) after so many steps of a weighted automaton: start (state, cnt), transitions (src, dst, w)."""
    now = start.select("state", F.col("cnt").cast("decimal(38,0)").alias("cnt"))
    edges = cut(transitions.select("src", "dst", "w"))
    for _ in range(steps):
        moved = now.join(edges, now["state"] == edges["src"]).select(F.col("dst").alias("state"), (F.col("cnt") * F.col("w").cast("decimal(19,0)")).cast("decimal(38,0)").alias("cnt"))
        now = merged(moved, ["state"])
        if modulus:
            now = now.select("state", (F.col("cnt") % modulus).cast("decimal(38,0)").alias("cnt"))
        now = cut(now)
    return now


def orphans(spark: SparkSession, rule: int, n: int) -> DataFrame:
    """(orphans): configurations of a ring of n cells that no configuration leads to."""
    image = generators.masks(spark, n).select(K.automaton_step(rule, n, F.col("mask")).alias("y")).distinct()
    return image.agg((F.lit(1 << n) - F.count(F.lit(1))).cast("long").alias("orphans"))


def predecessors(spark: SparkSession, rule: int, n: int, wanted: DataFrame) -> DataFrame:
    """(y, witness): the least predecessor of each wanted configuration (y), null for an orphan."""
    image = generators.masks(spark, n).select("mask", K.automaton_step(rule, n, F.col("mask")).alias("y")).groupBy("y").agg(F.min("mask").alias("witness"))
    return wanted.select("y").join(image, "y", "left")


def symbol_matrices(spark: SparkSession, rule: int) -> DataFrame:
    """(symbol, src, dst): pairs of cells that follow each other while a rule writes a symbol."""
    triple = spark.range(8)
    return triple.select(F.call_function("shiftright", F.lit(rule), F.col("id").cast("int")).bitwiseAND(F.lit(1)).alias("symbol"), F.floor(F.col("id") / 2).cast("int").alias("src"), (F.col("id") % 4).cast("int").alias("dst"))


def domino_tilings(spark: SparkSession, rows: int, cols: int) -> int:
    """Tilings of a board by dominoes, cell by cell: a state is the set of cells ahead that are covered already."""
    now = spark.range(1).select(F.col("id").alias("state"), F.lit(1).alias("cnt"))
    full = (1 << rows) - 1
    for at in range(rows * cols):
        r, last_col = at % rows, at // rows == cols - 1
        # bit 0 is this cell, bit 1 the one below, bit `rows` the one to the right
        free = F.col("state").bitwiseAND(F.lit(1)) == 0
        below_free = F.col("state").bitwiseAND(F.lit(2)) == 0
        options = [F.when(~free, F.col("state"))]
        if not last_col:
            options.append(F.when(free, F.col("state").bitwiseOR(F.lit(1 << rows))))
        if r < rows - 1:
            options.append(F.when(free & below_free, F.col("state").bitwiseOR(F.lit(2))))
        moved = now.select(F.explode(F.filter(F.array(*options), lambda s: s.isNotNull())).alias("s"), "cnt").select(F.shiftright("s", 1).alias("state"), "cnt")
        now = merged(moved, ["state"])
        if r == rows - 1:
            now = cut(now)
    row = now.where(F.col("state").bitwiseAND(F.lit(full)) == 0).agg(F.sum("cnt").alias("n")).first()
    return int(row["n"] or 0)


def tiling_counts(spark: SparkSession, rows: int, most: int) -> list[int]:
    """Domino tilings of boards of so many rows and 0, 1 .. most columns, in one sweep: a column that reaches nowhere
    ahead ends a board."""
    now = spark.range(1).select(F.col("id").alias("state"), F.lit(1).alias("cnt"))
    out = [1]
    for at in range(rows * most):
        free, below_free = F.col("state").bitwiseAND(F.lit(1)) == 0, F.col("state").bitwiseAND(F.lit(2)) == 0
        options = [F.when(~free, F.col("state")), F.when(free, F.col("state").bitwiseOR(F.lit(1 << rows)))]
        if at % rows < rows - 1:
            options.append(F.when(free & below_free, F.col("state").bitwiseOR(F.lit(2))))
        moved = now.select(F.explode(F.filter(F.array(*options), lambda s: s.isNotNull())).alias("s"), "cnt").select(F.shiftright("s", 1).alias("state"), "cnt")
        now = merged(moved, ["state"])
        if at % rows == rows - 1:
            now = cut(now)
            out.append(int(now.where("state = 0").agg(F.sum("cnt").alias("n")).first()["n"] or 0))
    return out


def fault_free_tilings(spark: SparkSession, rows: int, cols: int) -> int:
    """Domino tilings that no straight line across the board leaves whole, by inclusion and exclusion.

    A partition of the rows stands for its orders of strips; strips are tiled apart, boards without a vertical line are
    found column by column, and partitions are summed with signs."""
    counts = [(h, k, n) for h in range(1, rows + 1) for k, n in enumerate(tiling_counts(spark, h, cols)) if k]
    strips = spark.createDataFrame(counts, "h long, k int, n long")
    parts = generators.partitions(spark, rows).select("p", F.monotonically_increasing_id().alias("id"))
    parts = cut(parts)
    tiled = parts.select("id", F.explode("p").alias("h")).join(strips, "h").groupBy("id", "k").agg(F.collect_list("n").alias("ns")).select("id", "k", K.product_of(F.col("ns")).alias("v"))
    lined = tiled.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("whole")).join(parts, "id")

    def unbroken(done, k):
        """G(k) = P(k) minus boards whose first vertical line is after j < k columns."""
        crossed = F.aggregate(F.sequence(F.lit(1), k), F.lit(0).cast("long"), lambda a, j: a + F.when(j < k, F.get(done, j - 1) * F.get("whole", k - j - 1)).otherwise(F.lit(0)))
        return F.concat(done, F.array(F.get("whole", k - 1) - crossed))

    last = F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(cols)), F.array().cast("array<long>"), unbroken), -1)
    signed = lined.select(F.when(F.size("p") % 2 == 1, 1).otherwise(-1).alias("sign"), K.composition_count(F.col("p")).alias("orders"), last.alias("g"))
    return int(signed.agg(F.sum(F.col("sign") * F.col("orders") * F.col("g")).alias("n")).first()["n"])


def subset_sums(counts: DataFrame, bits: int, modulus: int | None = None) -> DataFrame:
    """(mask, cnt) for masks of so many bits (62 at most): the sum of the counts (mask, cnt) of all subsets of a mask. Masks
    without a subset among the counts have no row; there can be 2**bits rows. A round takes four bits: a mask counts for the
    16 sets at most that have more of these bits, partial sums come before the shuffle, and no two masks meet."""
    if not 0 <= bits <= 62:
        raise ValueError("masks have 62 bits at most")
    now = merged(counts, ["mask"])
    for low in range(0, bits, 4):
        width = min(4, bits - low)
        own = F.shiftright("mask", low).bitwiseAND(F.lit((1 << width) - 1))
        rest = F.col("mask").bitwiseAND(F.lit(~(((1 << width) - 1) << low)))
        more = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << width) - 1).cast("long")), lambda j: j.bitwiseAND(F.col("own")) == F.col("own"))
        now = now.select(own.alias("own"), rest.alias("rest"), "cnt").select("rest", F.explode(more).alias("set"), "cnt")
        now = merged(now.select(F.col("rest").bitwiseOR(F.shiftleft("set", low)).alias("mask"), "cnt"), ["mask"])
        if modulus:
            now = now.select("mask", (F.col("cnt") % modulus).cast("decimal(38,0)").alias("cnt"))
    return now


def king_placements(spark: SparkSession, n: int, cyclic: bool, modulus: int | None = None) -> int:
    """Sets of cells of an n by n board (a cylinder if cyclic) of which no two touch. A line may follow those that stay within
    the cells it doesn't touch, so a step is the sums over subsets, read at these cells; pairs of lines aren't joined."""
    states = generators.line_states(spark, n, cyclic)
    touched = F.col("mask").bitwiseOR(F.shiftleft("mask", 1)).bitwiseOR(F.shiftright("mask", 1))
    if cyclic and n > 1:
        around = F.when(F.col("mask").bitwiseAND(F.lit(1)) == 1, F.lit(1 << (n - 1))).otherwise(F.lit(0)).bitwiseOR(F.shiftright("mask", n - 1))
        touched = touched.bitwiseOR(around)
    free = F.lit((1 << n) - 1).bitwiseAND(F.bitwise_not(touched))
    states = cut(states.select(F.col("mask").alias("line"), free.alias("mask")))
    now = states.select(F.col("line").alias("mask"), F.lit(1).cast("decimal(38,0)").alias("cnt"))
    for _ in range(n - 1):
        now = cut(states.join(subset_sums(now, n, modulus), "mask").select(F.col("line").alias("mask"), "cnt"))
    found = int(now.agg(F.sum("cnt").alias("n")).first()["n"])
    return found % modulus if modulus else found


def chip_states(spark: SparkSession, n: int) -> DataFrame:
    """(chips): places of n labelled chips, all at 0 at first, that firing reaches: two chips of one place part, the
    lesser one step down, the greater one up."""
    from tallyforge.operators.graphs import reachable_states

    start = spark.range(1).select(F.array_repeat(F.lit(0), n).alias("chips"))
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)], "i int, j int")

    def fired(states: DataFrame) -> DataFrame:
        met = states.join(pairs, F.get("chips", F.col("i")) == F.get("chips", F.col("j")))
        return met.select(F.transform("chips", lambda x, k: F.when(k == F.col("i"), x - 1).when(k == F.col("j"), x + 1).otherwise(x)).alias("chips"))

    return reachable_states(start, fired, ["chips"])


def terminal(states: DataFrame) -> DataFrame:
    """States in which no two chips share a place."""
    return states.where(F.size(F.array_distinct("chips")) == F.size("chips"))
