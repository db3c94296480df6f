"""Scalar kernels as Column expressions: they stay in the JVM and need no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


# Permutations (arrays of 1..n) -----------------------------------------------------------------------------------------


def permutation_rank(p: Column) -> Column:
    """Lexicographic rank of a permutation of at most 20 items."""
    n = F.size(p)
    smaller = lambda i: F.size(F.filter(F.slice(p, i + 1, n), lambda v: v < F.element_at(p, i))).cast("long")
    return F.aggregate(F.sequence(F.lit(1), n), _long(0), lambda a, i: a * (n - i + 1) + smaller(i))


def permutation_of_rank(rank: Column, n: int) -> Column:
    """The permutation of 1..n with a lexicographic rank."""
    weights = [reduce(lambda a, b: a * b, range(1, n - i), 1) for i in range(n)]
    state = F.struct(rank.cast("long").alias("left"), F.sequence(F.lit(1), F.lit(n)).alias("free"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, w: Column) -> Column:
        at = (F.floor(a["left"] / w) + 1).cast("int")
        taken = F.element_at(a["free"], at)
        return F.struct((a["left"] % w).alias("left"), F.filter(a["free"], lambda v: v != taken).alias("free"), F.concat(a["out"], F.array(taken)).alias("out"))

    return F.aggregate(F.array(*[_long(w) for w in weights]), state, step, lambda a: a["out"])


def flip(p: Column) -> Column:
    """The first p[0] items reversed."""
    head = F.element_at(p, 1)
    return F.concat(F.reverse(F.slice(p, F.lit(1), head)), F.slice(p, head + 1, F.size(p)))


def flips_to_top(p: Column, bound: int) -> Column:
    """Flips until the first item is 1; ``bound`` must be no less than the greatest number for the size."""
    step = lambda a, _: F.when(F.element_at(a["p"], 1) == 1, a).otherwise(F.struct(flip(a["p"]).alias("p"), (a["k"] + 1).alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(bound)), F.struct(p.alias("p"), _long(0).alias("k")), step, lambda a: a["k"])


def no_fixed_point_after_first(p: Column) -> Column:
    """Whether no item beyond the first is in its place: such decks have no predecessor under flip()."""
    return ~F.exists(F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2))), lambda i: F.coalesce(F.get(p, i - 1) == i, F.lit(False)))


# Partitions ------------------------------------------------------------------------------------------------------------


def solitaire(piles: Column, s: int = 1) -> Column:
    """min(pile, s) from every pile to a new one; empty piles go; descending."""
    moved = F.aggregate(piles, _long(0), lambda a, x: a + F.least(x, _long(s)))
    rest = F.transform(piles, lambda x: x - F.least(x, _long(s)))
    return F.sort_array(F.filter(F.concat(rest, F.array(moved)), lambda x: x > 0), asc=False)


def composition_count(parts: Column) -> Column:
    """Orders of the parts of a partition of at most 20 parts: a multinomial coefficient."""
    return F.aggregate(
        F.array_distinct(parts),
        F.factorial(F.size(parts)),
        lambda a, x: F.floor(a / F.factorial(F.size(F.filter(parts, lambda y: y == x)))).cast("long"),
    )


# Numbers ---------------------------------------------------------------------------------------------------------------


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps: 90 are enough for any two 64-bit numbers."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.expr("0L") + F.when((a == 0) | (b == 0), _long(0)).otherwise((a.cast("long") / gcd(a, b)).cast("long") * b.cast("long"))


def lcm_of(values: Column) -> Column:
    """The least common multiple of an array; ANSI mode raises beyond 64 bits."""
    return F.aggregate(F.array_distinct(values), _long(1), lcm)


def product_of(values: Column, modulus: int | None = None) -> Column:
    """The exact product of an array, or its remainder."""
    if modulus:
        return F.aggregate(values, _long(1), lambda a, x: (a * x.cast("long")) % modulus)
    return F.aggregate(values, _long(1), lambda a, x: a * x.cast("long"))


def quadratic(x: Column, c: int, modulus: Column) -> Column:
    """x * x + c modulo the modulus, never negative."""
    return F.pmod(x * x + c, modulus)


def power_mod(base: Column, exponent: Column, modulus: Column) -> Column:
    """Square and multiply; the modulus must be below 2**31."""
    start = F.struct(_long(1).alias("r"), F.pmod(base.cast("long"), modulus).alias("b"), exponent.cast("long").alias("e"))

    def step(s: Column, _: Column) -> Column:
        return F.struct(F.when(s["e"] % 2 == 1, s["r"] * s["b"] % modulus).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % modulus).alias("b"), F.shiftright(s["e"], 1).alias("e"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step, lambda s: s["r"] % modulus)


def is_prime(n: Column) -> Column:
    """By trial division with 2 and the odd numbers up to the root."""
    odd = F.sequence(F.lit(3).cast("long"), F.greatest(F.ceil(F.sqrt(n)), F.lit(3)).cast("long"), F.lit(2).cast("long"))
    return (n == 2) | (n == 3) | ((n > 3) & (n % 2 != 0) & ~F.exists(odd, lambda d: (d * d <= n) & (n % d == 0)))


def totient(n: Column) -> Column:
    """Numbers up to n that share no factor with it, for small n."""
    return F.size(F.filter(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda k: gcd(k, n) == 1)).cast("long")


# Bits ------------------------------------------------------------------------------------------------------------------


def bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i.cast("int")).bitwiseAND(_long(1))


def place_in_mask(i: Column) -> Column:
    """``i`` itself if a mask of 64 bits has this place besides its sign, 0 to 62; others raise an error, null stays null."""
    fits = i.isNull() | ((i >= 0) & (i <= 62))
    return F.when(fits, i.cast("long")).otherwise(F.raise_error(F.concat(F.lit("masks have the places 0 to 62, not "), i.cast("string"))).cast("long"))


def reverse_bits(mask: Column, n: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(mask), n, "0")), 2, 10).cast("long")


def automaton_step(rule: int, n: int, cells: Column) -> Column:
    """One step of an elementary cellular automaton on a ring of n cells, as a bit mask."""

    def new(i: Column) -> Column:
        around = 4 * bit(cells, (i + 1) % n) + 2 * bit(cells, i) + bit(cells, F.pmod(i - 1, F.lit(n)))
        return F.call_function("shiftleft", F.call_function("shiftright", _long(rule), around.cast("int")).bitwiseAND(_long(1)), i)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), _long(0), lambda a, i: a.bitwiseOR(new(i)))


def mex(values: Column) -> Column:
    """The least number from 0 on that an array of numbers hasn't."""
    return F.array_min(F.array_except(F.sequence(_long(0), F.size(values).cast("long")), F.transform(values, lambda x: x.cast("long"))))


# Words -----------------------------------------------------------------------------------------------------------------


def leading_number(a: Column, b: Column, k: int, q: int) -> Column:
    """Sum of q**(j-1) over the j for which the last j letters of a are the first j of b."""
    return reduce(lambda x, y: x + y, [F.when(F.right(a, F.lit(j)) == F.left(b, F.lit(j)), _long(q ** (j - 1))).otherwise(_long(0)) for j in range(1, k + 1)])


def odds(a: Column, b: Column, k: int, q: int) -> Column:
    """(num, den) of the chance that word a comes up before word b; den is positive, not reduced."""
    for_a = leading_number(b, b, k, q) - leading_number(b, a, k, q)
    for_b = leading_number(a, a, k, q) - leading_number(a, b, k, q)
    return F.struct(for_a.alias("num"), (for_a + for_b).alias("den"))


# Boards ----------------------------------------------------------------------------------------------------------------

#: How the left-right and the top-bottom edges of a board are glued: 0 not, 1 straight, -1 with a flip. Fixed values.
SURFACES = {"plane": (0, 0), "cylinder": (1, 0), "torus": (1, 1), "mobius": (-1, 0), "klein": (-1, 1), "klein_rows": (1, -1), "projective": (-1, -1)}


def fold(surface: str, r: Column, c: Column, rows: Column, cols: Column) -> Column:
    """The cell (r, c) reached by a unit move, as a struct; null if it leaves the board."""
    across, along = SURFACES[surface]
    over_c, over_r = (c < 0) | (c >= cols), (r < 0) | (r >= rows)
    c1 = F.when(over_c, F.pmod(c, cols)).otherwise(c)
    r1 = F.when(over_c, rows - 1 - r).otherwise(r) if across == -1 else r
    r2 = F.when(over_r, F.pmod(r1, rows)).otherwise(r1)
    c2 = F.when(over_r, cols - 1 - c1).otherwise(c1) if along == -1 else c1
    off = (over_c if across == 0 else F.lit(False)) | (over_r if along == 0 else F.lit(False))
    return F.when(~off, F.struct(r2.alias("r"), c2.alias("c")))


def lucas_lehmer(p: Column) -> Column:
    """Whether 2**p - 1 is prime, for an odd prime p up to 61; a greater one raises an error."""
    number = "decimal(19,0)"
    p = F.when(p.isNull() | (p <= 61), p.cast("long")).otherwise(F.raise_error(F.lit("exponents go up to 61")).cast("long"))
    modulus = (F.call_function("shiftleft", _long(1), p.cast("int")) - 1).cast(number)
    step = lambda s, _: ((s * s + modulus - 2) % modulus).cast(number)
    return F.aggregate(F.sequence(F.lit(1).cast("long"), p.cast("long") - 2), F.lit(4).cast(number), step) == 0
