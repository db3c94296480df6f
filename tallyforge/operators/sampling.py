"""Sampling estimates: dives down a tree of choices, weighted by the choices they had."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def estimate(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(n, hits, mean, se) of independent estimates; se is the standard error of the mean."""
    v = F.col(value).cast("double")
    return values.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum((v > 0).cast("long")).alias("hits"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def hash_share(key: Column, per_16: int) -> Column:
    """Whether a key falls in so many of 16 equal parts, by the first hex digit of its MD5: the same rows each time."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 1), 16, 10).cast("int") < per_16


#: Of 65536 equal chances, those of at most 0, 1, 2, .. events at a mean of one (Poisson), rounded down: from exp(-1) / k!.
_AT_MOST = [int(65536 * exp(-1) * sum(1 / factorial(j) for j in range(k + 1))) for k in range(8)]
#: Replicates that one MD5 gives weights for: 16 bits each.
_A_HASH = 8


def poisson_bootstrap(df: DataFrame, by: list[str], key: str, value: str, replicates: int = 40, tail: float = 0.025, buckets: int = 16) -> DataFrame:
    """(by.., n, mean, low, high, middle) in thousandths, rounded down: the mean of whole numbers ``value``, the interval of its
    bootstrap replicates without a share ``tail`` on either side, and the median of the means of 16 or fewer equal parts.

    A row's weight in a replicate is a Poisson number of mean one, from the MD5 of its key: the same in each run, wherever the row
    is; rows of one key have the same weights. So all replicates are sums of one pass, aggregated before the shuffle. Replicates
    and parts without a row are left out; null values and keys as well; of an even number of parts the lower median is taken."""
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(key).cast("string").alias("__key"), F.col(value).cast("long").alias("__v"))
    digest = lambda name: F.md5(F.concat("__key", F.lit(f"/{name}")).cast("binary"))
    hashes = [digest(h) for h in range(-(-replicates // _A_HASH))]
    rows = rows.withColumns({f"__h{i}": h for i, h in enumerate(hashes)}).withColumn("__part", (F.conv(F.substring(digest("part"), 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("__v").alias("__s")]
    for b in range(replicates):
        drawn = F.conv(F.substring(F.col(f"__h{b // _A_HASH}"), 4 * (b % _A_HASH) + 1, 4), 16, 10).cast("int")
        weight = sum((F.when(drawn >= bound, 1).otherwise(0) for bound in _AT_MOST), F.lit(0)).cast("long")
        sums += [F.sum(weight).alias(f"__w{b}"), F.sum(weight * F.col("__v")).alias(f"__s{b}")]
    for b in range(buckets):
        sums += [F.count_if(F.col("__part") == b).alias(f"__pw{b}"), F.sum(F.when(F.col("__part") == b, F.col("__v"))).alias(f"__ps{b}")]
    whole = rows.groupBy(*by).agg(*sums)
    thousandths = lambda s, n: F.floor(F.col(s) * 1000 / F.col(n)).cast("long")
    means = lambda s, w, k: F.array_sort(F.filter(F.array(*[F.when(F.col(f"{w}{b}") > 0, thousandths(f"{s}{b}", f"{w}{b}")) for b in range(k)]), lambda x: x.isNotNull()))
    found = whole.select(*by, "n", thousandths("__s", "n").alias("mean"), means("__s", "__w", replicates).alias("__all"), means("__ps", "__pw", buckets).alias("__parts"))
    skipped = F.floor(F.size("__all") * F.lit(tail)).cast("int")
    return found.select(*by, "n", "mean", F.get("__all", skipped).alias("low"), F.get("__all", F.size("__all") - 1 - skipped).alias("high"), F.get("__parts", F.floor((F.size("__parts") - 1) / 2).cast("int")).alias("middle"))


def hamiltonian_dives(spark: SparkSession, neighbours: list[list[int]], dives: int, seed: int = 1, biased: bool = False) -> DataFrame:
    """(weight) of random walks over unvisited neighbours from 0: the product of the numbers of choices if the walk
    closes to a Hamiltonian cycle, halved, else 0; its mean is the number of cycles. Biased walks prefer the neighbour
    with the fewest ways on, twice as likely as each other, and are weighted back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(neighbours)
        for pdf in batches:
            weights = []
            for dive in pdf["id"]:
                rng = np.random.default_rng([seed, int(dive)])
                seen, head, weight = {0}, 0, 0.5
                for _ in range(n - 1):
                    ways = [w for w in neighbours[head] if w not in seen]
                    if not ways:
                        weight = 0.0
                        break
                    p = np.ones(len(ways))
                    if biased:
                        p[int(np.argmin([sum(x not in seen for x in neighbours[w]) for w in ways]))] = 2.0
                    p /= p.sum()
                    k = int(rng.choice(len(ways), p=p))
                    weight /= p[k]
                    head = ways[k]
                    seen.add(head)
                weights.append(weight if weight and 0 in neighbours[head] else 0.0)
            yield pd.DataFrame({"weight": weights})

    return spark.range(dives).mapInPandas(run, "weight double")


def race_dives(spark: SparkSession, a: str, b: str, q: int, dives: int, seed: int = 1) -> DataFrame:
    """(weight): 1 if word a comes before word b in a random run of digits below q, else 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            won = []
            for dive in pdf["id"]:
                rng, tail = np.random.default_rng([seed, int(dive)]), ""
                while not tail.endswith((a, b)):
                    tail = tail[-len(a) - len(b) :] + "0123456789abcdefghijklmnopqrstuvwxyz"[rng.integers(q)]
                won.append(float(tail.endswith(a)))
            yield pd.DataFrame({"weight": won})

    return spark.range(dives).mapInPandas(run, "weight double")
