"""Queries of exact arithmetic and of graphs of any size over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import races, residues, sampling, strong
from tallyforge.operators.loops import cut
from tallyforge.plans.queries import _WORDS, _corr_sql, cents, event_words, query, table

# Fractions -------------------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS HUGEINT) AS c, CAST(l_quantity AS HUGEINT) AS q FROM lineitem),
    m AS (SELECT l_returnflag, list_reduce(list(DISTINCT q), lambda a, b: lcm(a, b)) AS l FROM r GROUP BY 1),
    s AS (SELECT l_returnflag, count(*) AS n, sum(CAST(c * (l // q) AS HUGEINT)) AS top, any_value(l) * count(*) AS bottom FROM r JOIN m USING (l_returnflag) GROUP BY 1)
    SELECT l_returnflag, n, CAST(top // gcd(top, bottom) AS VARCHAR) AS num, CAST(bottom // gcd(top, bottom) AS VARCHAR) AS den
    FROM (SELECT l_returnflag, n, CAST(top AS HUGEINT) AS top, CAST(bottom AS HUGEINT) AS bottom FROM s)"""
)
def unit_price_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact mean price of a unit, in cents, by return flag: prices over quantities, of which the common multiple alone
    is beyond 64 bits."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", cents("l_extendedprice").alias("c"), F.col("l_quantity").cast("long").alias("q"))
    return residues.fraction_means(lines, ["l_returnflag"], "c", "q")


# Races -----------------------------------------------------------------------------------------------------------------


def _word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) with a < b of all event words, which are few, whatever the table's size."""
    words = cut(event_words(spark, sf_dir))
    return words.select(F.col("w").alias("a")).join(words.select(F.col("w").alias("b")), F.col("a") < F.col("b"))


@query(
    "WITH "
    + _WORDS
    + f""", p AS (SELECT a.w AS a, b.w AS b, CAST({_corr_sql("b.w", "b.w")} - {_corr_sql("b.w", "a.w")} AS BIGINT) AS x, CAST({_corr_sql("a.w", "a.w")} - {_corr_sql("a.w", "b.w")} AS BIGINT) AS y FROM w a JOIN w b ON a.w < b.w)
    SELECT a, b, CAST(x // gcd(x, x + y) AS VARCHAR) AS num, CAST((x + y) // gcd(x, x + y) AS VARCHAR) AS den FROM p"""
)
def races_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of all races of two event words on a die of five sides, by linear equations; the SQL has the closed form."""
    types = table(spark, sf_dir, "events").select(F.left("event_type", F.lit(1)).alias("l")).distinct()
    present = [r["l"] for r in types.orderBy("l").limit(1000).collect()]  # letters of types
    others = [letter for letter in "abcde" if letter not in present]
    return races.race(_word_pairs(spark, sf_dir), dict.fromkeys([*present, *others[: max(0, 5 - len(present))]], 1))


def _weighted_sql(x: str, y: str) -> str:
    """The sum over the j for which the last j letters of x are the first j of y of n**j over the product of these letters'
    counts, times the product of the counts of the letters of a and b."""
    count = lambda w, i: f"element_at(m, {w}[{i}])[1]"
    other = "b" if y == "a" else "a"
    terms = []
    for j in (1, 2, 3):
        factors = ["n"] * j + [count(y, i) for i in range(j + 1, 4)] + [count(other, i) for i in (1, 2, 3)]
        terms.append(f"CASE WHEN right({x}, {j}) = left({y}, {j}) THEN {' * '.join(factors)} ELSE 0 END")
    return "(" + " + ".join(terms) + ")"


@query(
    "WITH "
    + _WORDS
    + f""", c AS (SELECT left(event_type, 1) AS l, CAST(count(*) AS HUGEINT) AS c FROM events GROUP BY 1), t AS (SELECT map(list(l), list(c)) AS m, CAST(sum(c) AS HUGEINT) AS n FROM c),
    p AS (SELECT a.w AS a, b.w AS b, m, n FROM w a JOIN w b ON a.w < b.w, t),
    v AS (SELECT a, b, CAST({_weighted_sql("b", "b")} - {_weighted_sql("b", "a")} AS HUGEINT) AS x, CAST({_weighted_sql("a", "a")} - {_weighted_sql("a", "b")} AS HUGEINT) AS y FROM p)
    SELECT a, b, CAST(x // gcd(x, x + y) AS VARCHAR) AS num, CAST((x + y) // gcd(x, x + y) AS VARCHAR) AS den FROM v"""
)
def weighted_races_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As races_solved, for letters that come up as often as the events' types do."""
    counts = table(spark, sf_dir, "events").groupBy(F.left("event_type", F.lit(1)).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    weights = {r["l"]: r["n"] for r in counts.orderBy("l").limit(1000).collect()}  # letters of types
    return races.race(_word_pairs(spark, sf_dir), weights)


# Directed graphs -------------------------------------------------------------------------------------------------------

_SUCCESSION = """
    ln AS (SELECT l_orderkey AS o, l_linenumber AS i, CAST(l_partkey AS BIGINT) AS p, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
    m AS (SELECT a.p AS p, b.p AS q, a.c AS c, b.c AS d, a.o AS o, a.i AS i FROM ln a JOIN ln b ON a.o = b.o AND b.i = a.i + 1),
    e AS (SELECT p AS src, q AS dst FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY c DESC, o DESC, i DESC, q DESC) AS r FROM m) WHERE r = 1
          UNION SELECT q, p FROM (SELECT p, q, row_number() OVER (PARTITION BY q ORDER BY d, o, i, p) AS r FROM m) WHERE r = 1)
"""


def part_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): from each part to the one on the next line where it costs most, and to the one on the line before where it
    costs least (ties: by order, line, then part). Lines of one order and number are aggregated before they meet, so no pairs
    are made within an order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("p"), cents("l_extendedprice").alias("c"))
    after = lines.groupBy("o", (F.col("i") - 1).alias("i")).agg(F.max("p").alias("q"))
    before = lines.groupBy("o", (F.col("i") + 1).alias("i")).agg(F.min("p").alias("q"))
    dearest = lines.join(after, ["o", "i"]).groupBy(F.col("p").alias("src")).agg(F.max_by("q", F.struct("c", "o", "i", "q")).alias("dst"))
    cheapest = lines.join(before, ["o", "i"]).groupBy(F.col("p").alias("src")).agg(F.min_by("q", F.struct("c", "o", "i", "q")).alias("dst"))
    return cut(dearest.union(cheapest).distinct())


@query(
    "WITH RECURSIVE "
    + _SUCCESSION
    + """, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
    v AS (SELECT src AS n FROM e UNION SELECT dst FROM e),
    k AS (SELECT a.src AS n, min(a.dst) AS c FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
    l AS (SELECT v.n, least(v.n, coalesce(k.c, v.n)) AS c FROM v LEFT JOIN k USING (n)),
    b AS (SELECT DISTINCT x.c AS s, y.c AS d FROM e JOIN l x ON x.n = src JOIN l y ON y.n = dst WHERE x.c <> y.c),
    z AS (SELECT c, count(*) AS size FROM l GROUP BY 1)
    SELECT size, count(*) AS components, count(*) FILTER (WHERE c NOT IN (SELECT d FROM b)) AS sources, count(*) FILTER (WHERE c NOT IN (SELECT s FROM b)) AS sinks FROM z GROUP BY 1"""
)
def part_succession_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the parts' successions by size, and how many have no edge in or none out."""
    edges = part_succession(spark, sf_dir)
    found = strong.condensation(edges, strong.strong_components(edges))
    return found.groupBy("size").agg(F.count(F.lit(1)).alias("components"), F.count_if(F.col("in_edges") == 0).alias("sources"), F.count_if(F.col("out_edges") == 0).alias("sinks"))


# Intervals -------------------------------------------------------------------------------------------------------------

_KEY = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)"
_WEIGHT = " + ".join(f"CAST(d >= {bound} AS BIGINT)" for bound in sampling._AT_MOST)


@query(
    f"""WITH r AS (SELECT l_returnflag, {_KEY} AS k, CAST(l_quantity AS BIGINT) AS v FROM lineitem),
    h AS (SELECT l_returnflag, v, b, CAST('0x' || substr(md5(k || '/' || CAST(b // 8 AS VARCHAR)), CAST(4 * (b % 8) + 1 AS INTEGER), 4) AS BIGINT) AS d FROM r, range(40) x(b)),
    m AS (SELECT l_returnflag, b, CAST(floor(sum(w * v) * 1000 / sum(w)) AS BIGINT) AS m FROM (SELECT *, {_WEIGHT} AS w FROM h) GROUP BY 1, 2),
    o AS (SELECT l_returnflag, list_sort(list(m)) AS l FROM m GROUP BY 1),
    p AS (SELECT l_returnflag, CAST('0x' || left(md5(k || '/part'), 1) AS BIGINT) AS p, CAST(floor(sum(v) * 1000 / count(*)) AS BIGINT) AS m FROM r GROUP BY 1, 2),
    q AS (SELECT l_returnflag, list_sort(list(m)) AS l FROM p GROUP BY 1),
    n AS (SELECT l_returnflag, count(*) AS n, CAST(floor(sum(v) * 1000 / count(*)) AS BIGINT) AS mean FROM r GROUP BY 1)
    SELECT l_returnflag, n, mean, o.l[2] AS low, o.l[39] AS high, q.l[(len(q.l) + 1) // 2] AS middle FROM n JOIN o USING (l_returnflag) JOIN q USING (l_returnflag)"""
)
def quantity_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity by return flag with a bootstrap interval of 40 replicates and the median of the means of 16 parts."""
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", key.alias("key"), F.col("l_quantity").cast("long").alias("v"))
    return sampling.poisson_bootstrap(lines, ["l_returnflag"], "key", "v")
