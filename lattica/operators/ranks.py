"""Quantiles of groups as one of the group's own values, exact although no state holds a large group.

The quantile q of n values is the one of rank ceil(q * n) in ascending order, NaN last; it is -1 where that is NaN. A
sketch, within 1 / ACCURACY of the rank, gives groups of over ACCURACY rows two bounds, MARGIN to either side of q. A
second pass over the rows counts the values up to the bounds and collects those strictly between, about a thousandth of
a group however often a value repeats; smaller groups are collected whole. Bounds are broadcast: there is at most one
group in ACCURACY rows. As the counts are exact, a bound that missed its side is an error, never another value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 4 / ACCURACY
_NAME = "__rank_"

#: Where a value lies; all of a small group are between.
_BELOW, _LOW, _BETWEEN, _HIGH, _ABOVE, _NAN = range(6)


def _place(q: float, n: Column) -> Column:
    """The rank of the quantile, from 1; by the decimal digits of q, as 0.07 * 100 is over 7 in DOUBLE."""
    at = Decimal(repr(q))
    product = F.lit(at) * n.cast("decimal(19,0)") if -at.as_tuple().exponent <= 17 else F.lit(q) * n
    return F.greatest(F.ceil(product).cast("bigint"), F.lit(1).cast("bigint"))


def _number(x: Column) -> Column:
    """The value as a sketch orders it, which has no NaN: with the greatest."""
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)


class Ranks:
    """The quantiles that a statement asks for."""

    def __init__(self):
        self.asked: list[tuple[str, Column, float]] = []

    def find(self, key: str, x: Column, q: float) -> Column:
        """The aggregate over the rows of ``bounded`` that gives a quantile of a value, named by its key."""
        side, between, low, high = (F.col(f"{_NAME}{c}{len(self.asked)}") for c in ("side", "between", "low", "high"))
        self.asked.append((key, x, float(q)))
        low, high, n, to = F.max(low), F.max(high), F.count(side), lambda last: F.count_if(side <= last)
        r = _place(float(q), n)
        missed = F.raise_error(F.lit("the bounds of a quantile do not hold it")).cast("double")
        return (
            F.when(r > to(_ABOVE), F.lit(-1.0))
            .when(low.isNotNull() & ((r <= to(_BELOW)) | (r > to(_HIGH))), missed)
            .when(r <= to(_LOW), low)
            .when(r > to(_BETWEEN), high)
            .otherwise(F.get(F.sort_array(F.collect_list(between)), (r - to(_LOW) - 1).cast("int")))
        )

    def bounded(self, df: DataFrame, keys: list[Column]) -> DataFrame:
        """The rows with where their values lie by the bounds of their group."""
        if not self.asked:
            return df
        names, sketches, bounds = [f"{_NAME}key{i}" for i in range(len(keys))], [], {}
        for s, key in enumerate(dict.fromkeys(key for key, _, _ in self.asked)):
            of = [i for i, a in enumerate(self.asked) if a[0] == key]
            ends = [min(max(self.asked[i][2] + side, 0.0), 1.0) for i in of for side in (-MARGIN, MARGIN)]
            sketches.append(F.percentile_approx(_number(self.asked[of[0]][1]), ends, ACCURACY).alias(f"{_NAME}ends{s}"))
            for j, i in enumerate(of):
                bounds |= {f"{_NAME}{c}{i}": F.get(F.col(f"{_NAME}ends{s}"), F.lit(2 * j + k)) for k, c in enumerate(("low", "high"))}
        large = df.groupBy(*[k.alias(name) for k, name in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias(f"{_NAME}n"), *sketches)
        large = large.where(F.col(f"{_NAME}n") > ACCURACY).select(*names, *[c.alias(name) for name, c in bounds.items()])
        df = df.join(F.broadcast(large), [k.eqNullSafe(F.col(name)) for k, name in zip(keys, names, strict=True)], "left")
        # projected below the aggregate, where the values of a list would be evaluated without generated code
        sides = {}
        for i, (_, x, _) in enumerate(self.asked):
            x, low, high = x.cast("double"), F.col(f"{_NAME}low{i}"), F.col(f"{_NAME}high{i}")
            side = F.when(x.isNull(), F.lit(None)).when(F.isnan(x), _NAN).when(low.isNull(), _BETWEEN).when(x < low, _BELOW).when(x == low, _LOW)
            sides[f"{_NAME}side{i}"] = side.when(x < high, _BETWEEN).when(x == high, _HIGH).otherwise(_ABOVE)
        df = df.withColumns(sides)
        return df.withColumns({f"{_NAME}between{i}": F.when(F.col(f"{_NAME}side{i}") == _BETWEEN, x.cast("double")) for i, (_, x, _) in enumerate(self.asked)})
