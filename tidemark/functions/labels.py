"""Bucket and period labels. Two price scales exist on purpose: twelve half-open
buckets for screens, eight inclusive ones for suites; they are never mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price edges of the screens, and the suites' inclusive ranges.
SCREEN_EDGES = (1, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99)
SUITE_RANGES = ((1, 5), (6, 10), (11, 20), (21, 50), (51, 80), (81, 90), (91, 95), (96, 99))
COARSE = ((1, 10), (10, 30), (30, 50), (50, 70), (70, 90), (90, 99))


def _chain(pairs) -> Column:
    out = None
    for condition, label in pairs:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out


def screen_bucket(p: Column, edges=SCREEN_EDGES) -> Column:
    """``[lo, hi)`` labels such as 05-10; the last bucket holds its upper edge; null outside."""
    last = len(edges) - 2
    return _chain(((p >= lo) & ((p <= hi) if i == last else (p < hi)), f"{lo:02d}-{hi if i else hi}") for i, (lo, hi) in enumerate(zip(edges, edges[1:])))


def suite_bucket(p: Column, ranges=SUITE_RANGES) -> Column:
    """Inclusive labels such as 06-10; ``out`` outside."""
    return _chain((p.between(lo, hi), f"{lo:02d}-{hi:02d}") for lo, hi in ranges).otherwise("out")


def fixed_bin(value: Column, bins, other: str = "out") -> Column:
    """``lo:hi`` for half-open ``[lo, hi)`` bins; gaps between bins stay ``other``."""
    return _chain(((value >= lo) & (value < hi), f"{lo:g}:{hi:g}") for lo, hi in bins).otherwise(other)


def right_closed(value: Column, breaks, labels) -> Column:
    """``(a, b]`` bands: one more label than breaks; null stays null."""
    return _chain([(value <= b, label) for b, label in zip(breaks, labels)] + [(value > breaks[-1], labels[-1])])


def period(t: Column, bounds) -> Column:
    """``bounds``: (label, exclusive end) in order, the last label with end None."""
    first = _chain((t < F.lit(end).cast("timestamp_ntz"), label) for label, end in bounds[:-1])
    return F.when(t.isNull(), None).otherwise(first.otherwise(bounds[-1][0]))


def horizon_band(days: Column) -> Column:
    """Letters a to e by days to the end."""
    return _chain([(days < 7, "a 1-7d"), (days < 30, "b 7-30d"), (days < 90, "c 30-90d"), (days < 180, "d 90-180d"), (days >= 180, "e 180d+")])


def nearest_horizon(days: Column) -> Column:
    """The horizon of 7, 30, 90 or 180 days nearest on a log scale."""
    return _chain([(days < 18, F.lit(7)), (days < 60, F.lit(30)), (days < 135, F.lit(90))]).otherwise(F.lit(180))


def flow_bucket(p: Column) -> Column:
    return _chain([(p < 5, "01-5"), (p < 10, "05-10")]).otherwise("10-20")


def coarse_bucket(label: Column, known: dict[str, str], strict: bool) -> Column:
    """Maps labels; an unknown one turns null (strict) or stays."""
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), label)
    return found if strict else F.coalesce(found, label)


def cell_key(*parts: Column) -> Column:
    """Dimensions joined by a pipe; null as soon as one is null."""
    joined: list[Column] = []
    for p in parts:
        joined += [F.lit("|"), p.cast("string")] if joined else [p.cast("string")]
    return F.concat(*joined)
