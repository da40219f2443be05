"""Other ways to deal events into subsets than by their numbers: by the angle of their lines, or at random but the same each time."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the half circle that angles are counted by.
STEPS = 1800
#: Rounds of the permutation, each of two steps, and how often a number outside is sent on.
ROUNDS, WALKS = 4, 12


def by_angle(lines: DataFrame, subsets: int, ranges: int) -> DataFrame:
    """lines with angle_range, of about equal counts, and subset_id, which goes round the ranges: each subset sees all directions.

    The angles' histogram of STEPS rows, exact and whatever the number of lines, gives the ranges; the events of a step stay together.
    """
    step = f"CAST(floor(pmod(atan2(dy, dx), pi()) * {STEPS} / pi() + 0.37e0) AS INT) % {STEPS}"
    rows = lines.withColumn("_step", F.expr(f"coalesce({step}, 0)"))
    counts = sorted((r["_step"], r["count"]) for r in rows.groupBy("_step").count().collect())  # STEPS rows at most
    total, before, of = sum(n for _, n in counts), 0, []
    for at, n in counts:
        of.append((at, before * ranges // total))
        before += n
    table = lines.sparkSession.createDataFrame(of, "_step int, angle_range int")
    return rows.join(F.broadcast(table), "_step").drop("_step", "subset_id").withColumn("subset_id", (F.col("angle_range") % subsets).cast("int"))


def _mixed(x: str, seed: int) -> str:
    """A whole number below 2^31 - 1 from x and the seed, with no product beyond 2^47 for x below 2^31."""
    return f"((({x} * 48271 + {seed}) % 2147483647) * 16807 + {seed % 7919} + (({x} + {seed}) % 8191) * 7907) % 2147483647"


def permutation(number: str, count: int, seed: int = 1) -> str:
    """An SQL expression of the place of a number among `count` (0 to count - 1) in a random order that the seed fixes: a bijection, computed for each number by itself.

    A number is taken as a place in a rectangle little larger than the count; turns of its rows and columns by hashes of each other permute the rectangle, and what falls outside
    the count is sent on until it is inside, which it soon is, as fewer places than one row of the rectangle are outside.
    """
    high = isqrt(max(count - 1, 0)) + 1
    wide = -(-count // high) if count else 1
    keys = [(seed * 1_000_003 + k * 7_919 + 12_345) % 2147483647 for k in range(2 * ROUNDS)]
    x = f"transform(array(CAST({{0}} AS BIGINT)), x -> named_struct('a', x div {wide}, 'b', x % {wide}))"
    for k in range(ROUNDS):
        x = f"transform({x}, x -> named_struct('a', (x.a + {_mixed('x.b', keys[2 * k])}) % {high}, 'b', x.b))"
        x = f"transform({x}, x -> named_struct('a', x.a, 'b', (x.b + {_mixed('x.a', keys[2 * k + 1])}) % {wide}))"
    once = f"get(transform({x}, x -> x.a * {wide} + x.b), 0)"
    walk = f"CASE WHEN v >= {count} THEN {once.format('v')} ELSE v END"
    walked = f"aggregate(sequence(1, {WALKS}), {once.format(number)}, (v, i) -> {walk})"
    return f"get(transform(array({walked}), v -> CASE WHEN v < {count} THEN v ELSE raise_error('a number is still outside') END), 0)"


def permuted(events: DataFrame, subsets: int, seed: int = 1) -> DataFrame:
    """events, numbered from 0, with place, their place in a random order, subset_id = place % subsets and pos = place div subsets: no sort and no shuffle."""
    n = events.count()
    rows = events.withColumn("place", F.expr(permutation("event_id", n, seed)))
    kept = [f"`{c}`" for c in rows.columns if c not in ("subset_id", "pos")]
    return rows.selectExpr(*kept, f"CAST(place % {subsets} AS INT) AS subset_id", f"place div {subsets} AS pos")
