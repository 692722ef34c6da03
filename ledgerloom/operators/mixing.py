"""Detectors of mixing transactions: predicates over transactions.features()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Amounts that the second protocol of its kind pays out.
STANDARD = (
    5000, 6561, 8192, 10000, 13122, 16384, 19683, 20000, 32768, 39366, 50000, 59049, 65536, 100000, 118098, 131072, 177147, 200000,
    262144, 354294, 500000, 524288, 531441, 1000000, 1048576, 1062882, 1594323, 2000000, 2097152, 3188646, 4194304, 4782969, 5000000,
    8388608, 9565938, 10000000, 14348907, 16777216, 20000000, 28697814, 33554432, 43046721, 50000000, 67108864, 86093442, 100000000,
    129140163, 134217728, 200000000, 258280326, 268435456, 387420489, 500000000, 536870912, 774840978, 1000000000, 1073741824,
    1162261467, 2000000000, 2147483648, 2324522934, 3486784401, 4294967296, 5000000000, 6973568802, 8589934592, 10000000000,
    10460353203, 17179869184, 20000000000, 20920706406, 31381059609, 34359738368, 50000000000, 62762119218, 68719476736, 94143178827,
    100000000000, 137438953472,
)
#: Pool sizes and the fee of each.
POOLS = {100_000: 5_000, 1_000_000: 50_000, 5_000_000: 175_000, 50_000_000: 1_750_000}
TARGET = 10_000_000


def _c(name: str) -> Column:
    return F.col(name)


def _total(where: Callable[[Column], Column]) -> Column:
    """Outputs whose value meets a condition."""
    return F.aggregate(F.filter("output_values", lambda x: where(x["value"])), F.lit(0).cast("long"), lambda n, x: n + x["count"])


def joinmarket(least: int = 3) -> Column:
    m = _c("mode_count")
    return (m >= least) & (m >= _c("num_outputs") / 2) & (m <= _c("num_input_ids")) & (_c("num_output_ids") >= _c("num_outputs"))


def _wasabi(epsilon: int, per_participant: int, least: int) -> Column:
    m = _c("mode_count")
    near = F.exists("output_values", lambda x: (x["count"] == m) & x["value"].between(TARGET - epsilon, TARGET + epsilon))
    return (m >= least) & (m <= _c("num_input_ids")) & (_c("num_inputs") <= per_participant * m) & (_c("num_output_ids") >= _c("num_outputs")) & near


def wasabi_1_0(epsilon: int = 1_000_000, per_participant: int = 7, least: int = 5) -> Column:
    return _wasabi(epsilon, per_participant, least) & (_c("mode_count") >= (_c("num_outputs") - 1) / 2)


def wasabi_1_1(epsilon: int = 1_000_000, per_participant: int = 7, least: int = 5, levels: int = 12) -> Column:
    """Besides the equal outputs, those near the target's doublings count as mixed, once for each band they are in."""
    mixed = _c("mode_count")
    for level in range(1, levels):
        mixed = mixed + _total(lambda v, k=2**level: v.between(k * (TARGET - epsilon), k * (TARGET + epsilon)))
    return _wasabi(epsilon, per_participant, least) & (mixed >= _c("num_outputs") - _c("mode_count") - 1)


def wasabi_2(per_participant: int = 10, least_inputs: int = 50, least_value: int = 5000) -> Column:
    mixed = _total(lambda v: v.isin(*STANDARD))
    return (
        (_c("num_inputs") >= least_inputs) & (_c("input_min") >= least_value) & (_c("num_output_ids") >= _c("num_outputs"))
        & (mixed >= (_c("num_outputs") - 1) / 2) & (mixed >= _c("num_inputs") / per_participant)
    )


def whirlpool_tx0(low: int = 1, high: int = 11_000, most: int = 75, fee_low: float = 0.5, fee_high: float = 3.0) -> Column:
    """The outputs just over a pool's size that occur most often (of several, the greatest) are what is to be mixed."""
    pool = lambda v: F.coalesce(*(F.when(v.between(d + low, d + high), d) for d in POOLS))
    found = F.array_max(F.transform(F.filter("output_values", lambda x: pool(x["value"]).isNotNull()), lambda x: F.struct(x["count"].alias("count"), x["value"].alias("value"))))
    fee = F.coalesce(*(F.when(pool(found["value"]) == d, f) for d, f in POOLS.items()))
    paid = F.exists("output_values", lambda x: x["value"].between(fee_low * fee, fee_high * fee))
    return ~_c("output_zero") & found.isNotNull() & (found["count"] >= _c("num_outputs") - 2) & (found["count"] <= most) & paid


def whirlpool(high: int = 20_000, size: int = 5) -> Column:
    pool = _c("mode_value")
    fives = [_c(n) == size for n in ("num_inputs", "num_input_ids", "num_outputs", "num_output_ids")]
    some = lambda test: F.exists("input_values", lambda x: test(x["value"]))
    return (
        fives[0] & fives[1] & fives[2] & fives[3] & (_c("num_output_values") == 1) & pool.isin(*POOLS)
        & (_c("input_min") >= pool) & (_c("input_max") <= pool + high) & some(lambda v: v == pool) & some(lambda v: v > pool)
    )


def big(most_edges: int = 50) -> Column:
    i, o = _c("num_input_ids"), _c("num_output_ids")
    return (i != 1) & (o != 1) & (i * o >= most_edges)


DETECTORS: dict[str, Callable[..., Column]] = {"joinmarket": joinmarket, "wasabi1": wasabi_1_0, "wasabi11": wasabi_1_1, "wasabi2": wasabi_2, "whirlpool": whirlpool, "whirlpool_tx0": whirlpool_tx0}


def flags(features: DataFrame, **rules: Column) -> DataFrame:
    """(block, position, a 0/1 column for each detector) of transactions that any of them flags. rules replace detectors by
    name, or add some."""
    made = {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in ({n: f() for n, f in DETECTORS.items()} | rules).items()}
    out = features.select(F.col("block_num").alias("block"), "position", *(c.alias(n) for n, c in made.items()))
    return out.where(F.greatest(*(F.col(n) for n in made)) > 0 if len(made) > 1 else F.col(next(iter(made))) > 0)
