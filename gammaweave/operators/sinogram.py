"""Events counted into the bins of a sinogram, and bins as events again, so that all projections and reconstructions take them.

A bin is a pair of crystals at an angle, for two rings. Which bin an event falls to follows from its unordered pair of crystals, by an inverse index that is joined on both; its rings
are turned along with the pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scanner import Scanner
from .geometry import small

PLACE = ("angle", "bin", "ring_1", "ring_2")


def index(pairs: DataFrame) -> DataFrame:
    """low and high (crystals), angle, bin, and whether the pair's first crystal is the higher one. A pair that several bins share goes to the first."""
    rows = pairs.selectExpr("least(xtal_1, xtal_2) AS low", "greatest(xtal_1, xtal_2) AS high", "angle", "bin", "xtal_1 > xtal_2 AS turned")
    return rows.groupBy("low", "high").agg(F.min(F.struct("angle", "bin", "turned")).alias("b")).select("low", "high", "b.*")


def placed(events: DataFrame, pairs: DataFrame, s: Scanner) -> DataFrame:
    """event_id, angle, bin, ring_1 and ring_2 of the events that fall to a bin."""
    rows = events.selectExpr(
        "event_id", "least(xtal_id_1, xtal_id_2) AS low", "greatest(xtal_id_1, xtal_id_2) AS high",
        "CASE WHEN xtal_id_1 <= xtal_id_2 THEN ring_id_1 ELSE ring_id_2 END AS at_low", "CASE WHEN xtal_id_1 <= xtal_id_2 THEN ring_id_2 ELSE ring_id_1 END AS at_high",
    )
    found = rows.join(small(index(pairs), s.per_ring * s.per_ring // 2), ["low", "high"])
    return found.selectExpr("event_id", "angle", "bin", "CASE WHEN turned THEN at_high ELSE at_low END AS ring_1", "CASE WHEN turned THEN at_low ELSE at_high END AS ring_2")


def histogram(events: DataFrame, pairs: DataFrame, s: Scanner) -> DataFrame:
    """angle, bin, ring_1, ring_2 and n, the number of events, of the bins that have any."""
    return placed(events, pairs, s).groupBy(*PLACE).agg(F.count("*").alias("n"))


def outside(events: DataFrame, pairs: DataFrame, s: Scanner) -> int:
    """How many events fall to no bin."""
    return events.count() - placed(events, pairs, s).count()


def as_events(counts: DataFrame, pairs: DataFrame, s: Scanner) -> DataFrame:
    """A row like an event's for each bin: its number as event_id, both crystals and rings, no time bin, and n as mul_fac: the counts stand where events count once each."""
    bins = pairs.agg(F.max("bin") + 1).first()[0]
    number = f"((CAST(ring_1 AS BIGINT) * {s.rings} + ring_2) * {s.per_ring // 2} + angle) * {bins} + bin"
    rows = counts.join(small(pairs, s.per_ring * s.per_ring // 2), ["angle", "bin"])
    return rows.selectExpr(
        f"{number} AS event_id", "xtal_1 AS xtal_id_1", "CAST(ring_1 AS INT) AS ring_id_1", "xtal_2 AS xtal_id_2", "CAST(ring_2 AS INT) AS ring_id_2", "0 AS tbin_id", "0e0 AS add_fac", "CAST(n AS DOUBLE) AS mul_fac",
    )
