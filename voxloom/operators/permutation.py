"""A keyed shuffle that is a formula: the place of a number from the number, and the number at a place.

A Feistel network over two digits (``number = left + a * right``) adds a keyed function of one digit to the
other, modulo its base; every round can be taken back, so it is a bijection whatever the function. The two
bases multiply to a little more than ``n``; a number that leaves the range goes through again until it is
back in it. Nothing is sorted and no row needs another, so a shuffled epoch costs no exchange, any place of
any epoch can be asked for by itself, and a reader can go on where it stopped.

All arithmetic is on integers below 2^62, so it is the same in Spark, in any SQL engine and in Python.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a prime below 2^31 whose predecessor is not divisible by five, so that fifth powers are a
# bijection modulo it.
PRIME = 2_147_483_629
ROUNDS = 6
#: Times a number may go through. Fewer than sqrt(n) + 1 numbers lie outside the range, so ranges of up to
#: 4,000 numbers always end; in larger ones each time goes on with a chance below 1 in 60. A number that is
#: not back by then raises.
WALKS = 64
_STEP = 40_503


def bases(n: int) -> tuple[int, int]:
    """Two bases whose product is at least ``n``, and less than ``n`` plus the first."""
    a = isqrt(max(0, n - 1)) + 1
    return a, max(1, -(-n // a))


def fifth(x):
    """The fifth power modulo the prime, for an integer or a column."""
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _of_seed(seed: int) -> tuple[int, int]:
    """Slope and offset by which epochs become keys, so that no seed is another one some epochs later."""
    return 1 + fifth((seed + 2) % PRIME) % (PRIME - 1), fifth((seed + 1) % PRIME)


def round_key(seed: int, epoch, number: int):
    """The key of a round; ``epoch`` is an integer (below 2^30) or a column of them."""
    slope, offset = _of_seed(seed)
    return fifth((fifth(((epoch + 1) * slope + offset) % PRIME) + (number + 1) * _STEP) % PRIME)


def _order(back: bool) -> range:
    return range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)


def _walked(number: int, n: int, epoch: int, seed: int, back: bool) -> int:
    (a, b), sign = bases(n), -1 if back else 1
    keys = [round_key(seed, epoch, r) for r in range(ROUNDS)]
    while True:
        right, left = divmod(number, a)
        for r in _order(back):
            if r % 2:
                right = (right + sign * (fifth((left + keys[r]) % PRIME) % b)) % b
            else:
                left = (left + sign * (fifth((right + keys[r]) % PRIME) % a)) % a
        number = left + right * a
        if number < n:
            return number


def place_of(number: int, n: int, epoch: int, seed: int) -> int:
    """Place of a number below ``n`` in the shuffled order of an epoch."""
    return _walked(number, n, epoch, seed, False)


def number_at(place: int, n: int, epoch: int, seed: int) -> int:
    """The number at a place: the inverse of ``place_of``."""
    return _walked(place, n, epoch, seed, True)


def _turned(digit: Column, mixed: Column, base: int, back: bool) -> Column:
    """A digit moved by a keyed number, or moved back."""
    return (digit - mixed % base + base) % base if back else (digit + mixed % base) % base


def _again(number: Column, keys: Column, n: int, back: bool) -> Column:
    """The network as one fold over the keys: slower than columns, and rarely needed."""
    a, b = bases(n)

    def step(s: Column, k: Column) -> Column:
        left, right, odd = s["left"], s["right"], k["round"] % 2 == 1
        own = _turned(left, fifth((right + k["key"]) % PRIME), a, back)
        other = _turned(right, fifth((left + k["key"]) % PRIME), b, back)
        return F.struct(F.when(odd, left).otherwise(own).alias("left"), F.when(odd, other).otherwise(right).alias("right"))

    start = F.struct((number % a).alias("left"), F.floor(number / a).alias("right"))
    return F.aggregate(keys, start, step, lambda s: s["left"] + s["right"] * a)


def permuted(rows: DataFrame, number: str, n: int, seed: int, out: str, epoch: str = "epoch", back: bool = False) -> DataFrame:
    """Add ``out``: the place of ``number`` (below ``n``) in the order of ``epoch``, or with ``back`` the inverse.

    Narrow: columns in one code-generated stage. Numbers that leave the range go through again by a fold.
    """
    a, b = bases(n)
    columns = [c for c in rows.columns if c != out]
    x, e = F.col(number).cast("bigint"), F.col(epoch).cast("bigint")
    # Every step uses the one before several times, so the optimiser must not copy steps into later ones, into
    # constraints, filters or join keys: copies would grow with a power of the rounds. Adding a zero that may
    # not be moved keeps steps apart, and a result that comes out of an array has no formula to be traced.
    apart = F.spark_partition_id() * 0
    found = rows.withColumns({f"__k{r}": round_key(seed, e, r) + apart for r in range(ROUNDS)})
    found = found.withColumns({"__left": x % a + apart, "__right": F.call_function("div", x, F.lit(a)) + apart})
    for r in _order(back):
        source, target, base = ("__left", "__right", b) if r % 2 else ("__right", "__left", a)
        found = found.withColumn("__m", (F.col(source) + F.col(f"__k{r}")) % PRIME + apart)
        found = found.withColumn("__s", F.col("__m") * F.col("__m") % PRIME + apart)
        mixed = F.col("__s") * F.col("__s") % PRIME * F.col("__m") % PRIME
        found = found.withColumn(target, _turned(F.col(target), mixed, base, back) + apart)
    found = found.withColumn("__once", F.col("__left") + F.col("__right") * a + apart)
    keys = F.array(*[F.struct(F.lit(r).alias("round"), F.col(f"__k{r}").alias("key")) for r in _order(back)])
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), F.col("__once"), lambda v, _: F.when(v >= n, _again(v, keys, n, back)).otherwise(v)
    )
    found = found.withColumn("__once", F.when(F.col("__once") < n, F.col("__once")).otherwise(walked) + apart)
    lost = F.raise_error(F.concat(F.lit("no place found for "), x.cast("string"))).cast("bigint")
    kept = F.when(F.col("__once") < n, F.col("__once")).otherwise(lost) + apart
    return found.withColumn("__once", kept).select(*columns, F.explode(F.array("__once")).alias(out))


def sql_twin(numbers: str, n: str, seed: int) -> str:
    """CTEs in SQL that place the rows of ``numbers`` (``epoch, number``): ``placed`` has ``epoch, number, place``."""

    def power(v: str) -> str:
        return f"(({v}) * ({v}) % {PRIME} * (({v}) * ({v}) % {PRIME}) % {PRIME} * ({v}) % {PRIME})"

    slope, offset = _of_seed(seed)
    base = power(f"(((epoch + 1) * {slope} + {offset}) % {PRIME})")
    keys = ", ".join(power(f"(({base} + {(r + 1) * _STEP}) % {PRIME})") + f" as k{r}" for r in range(ROUNDS))
    inner = "select *, x % a as l, x // a as r from walk where x >= n or not gone"
    for i in range(ROUNDS):
        mixed = power(f"(({'l' if i % 2 else 'r'} + k{i}) % {PRIME})")
        inner = f"select * replace ({f'(r + {mixed} % b) % b as r' if i % 2 else f'(l + {mixed} % a) % a as l'}) from ({inner})"
    return f"""sized as (select n, greatest(1, floor(sqrt(greatest(n - 1, 0)))::bigint + 1) as a from (select ({n})::bigint as n)),
  keyed as materialized (
    select epoch::bigint as epoch, number::bigint as number, n, a, greatest(1, (n + a - 1) // a) as b, {keys}
    from (select epoch::bigint as epoch, number::bigint as number from {numbers}), sized),
  walked as (
    with recursive walk as (
      select *, number as x, false as gone from keyed
      union all
      select * exclude (l, r) replace (l + r * a as x, true as gone) from ({inner}))
    select * from walk where gone and x < n),
  placed as (select epoch::int as epoch, number, x as place from walked)"""
