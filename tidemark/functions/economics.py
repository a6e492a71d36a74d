"""Row economics of binary contracts as Column expressions.

Prices are whole cents from 1 to 99; ``y`` is 1 when the contract settled yes.
Fees round up to the next cent, in integer arithmetic so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Carry and hurdle (yearly rates), and the two fee schedules' names.
CARRY, HURDLE = 0.0325, 0.07
MAKER_FEES = "quadratic_with_maker_fees"
YEAR_SECONDS = 365 * 86400


def div(a: Column, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def taker_fee(p: Column) -> Column:
    return div(7 * p * (100 - p) + 9999, 10000)


def maker_fee(p: Column, fee_type: Column) -> Column:
    return F.when(fee_type == MAKER_FEES, div(7 * p * (100 - p) + 39999, 40000)).otherwise(F.lit(0).cast("long"))


def yes_return(p: Column, y: Column, fee: Column) -> Column:
    """Return on the stake of a YES position bought at ``p``."""
    return (100.0 * y - p - fee) / p


def no_return(p: Column, y: Column, fee: Column) -> Column:
    """Return on the stake of a NO position opposite a YES price of ``p``."""
    return (100.0 * (1 - y) - (100 - p) - fee) / (100 - p)


def annualised(hold: Column, days: Column, carry: float = CARRY) -> Column:
    """A holding return plus carry on the stake, scaled to a year of 365 days."""
    return (hold + carry * days / 365.0) * 365.0 / days


def annualised_seconds(hold: Column, seconds: Column, carry: float = CARRY) -> Column:
    return hold * F.lit(float(YEAR_SECONDS)) / seconds + carry


def hold_seconds(settled: Column, decision: Column, resolution: Column, trustworthy: Column, scheduled: Column) -> Column:
    """Seconds held: to settlement if it follows, else to a trustworthy resolution, else to the scheduled end."""

    def between(a, b):
        return F.timestamp_diff("SECOND", a, b)

    return F.when(settled > decision, between(decision, settled)).when(trustworthy & (resolution > decision), between(decision, resolution)).otherwise(between(decision, scheduled))


def side_rows() -> Column:
    """Array to explode: a row for each side."""
    return F.array(F.lit("no"), F.lit("yes"))


def side_price(side: Column, p: Column) -> Column:
    return F.when(side == "yes", p).otherwise(100 - p)


def side_win(side: Column, y: Column) -> Column:
    return F.when(side == "yes", y).otherwise(1 - y)


def strategy_entry(side: Column, p: Column, reserve: int) -> Column:
    """Entry price of the side with a spread reserve, within 1 to 99."""
    return F.least(F.lit(99), F.greatest(F.lit(1), side_price(side, p) + reserve))


def health_light(mean: Column, se: Column, n: Column, least: int = 30, carry: float = CARRY, hurdle: float = HURDLE) -> Column:
    low = mean - se
    return F.when((n < least) | mean.isNull(), "THIN").when(low < carry, "RED").when(low < hurdle, "AMBER").otherwise("GREEN")


def tail_gap_score(gap: Column, decisions: Column, cap: float = 0.05, least: int = 100, floor: float = 0.3) -> Column:
    """Positive tail overpricing up to a cap; thin evidence takes the floor."""
    return F.when((decisions < least) | gap.isNull(), F.lit(floor)).otherwise(F.greatest(F.lit(0.0), F.least(gap, F.lit(cap))) / cap)


def geometric_mean(scores: Column) -> Column:
    """Of an array; zero as soon as one score is not positive."""
    logs = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.ln(F.greatest(s, F.lit(1e-300))))
    return F.when(F.exists(scores, lambda s: s <= 0), F.lit(0.0)).otherwise(F.exp(logs / F.size(scores)))
