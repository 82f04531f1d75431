"""Sums, averages and correlations that do not depend on the order in which tasks add them up.

A double sum changes in its last digits with the order of the partial sums, so
two runs over the same trips can differ. An amount with at most four digits
behind the point, as almost all are, is therefore added as a whole number of
ten-thousandths, cut into limbs whose sums stay within 64 bits for a million
million rows. Any other amount is added as a decimal with 18 places. Both sums
are exact, and only the finished total becomes a double. An amount of 1e20 or
more does not fit; a group that has such an amount has no total.

An average is kept as parts (counts and sums) until the last step. Parts can be
grouped once by a key of the fact and again by an attribute of a dimension, so a
join carries one row per key and not one per trip.

Correlations come from moments, which merge in the same way: sums of the amounts
and of their products, as limbs for amounts of moderate size, and as decimals with
eight places for the rest.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = "decimal(38,18)"
_WHOLE = "decimal(38,0)"
#: Ten-thousandths are whole numbers; below this many, a sum's limbs have `_SUM_BITS` bits.
_PLACES = 4
_SCALE = 10**_PLACES
_MOST = 1 << 46
_SUM_BITS = 23
#: The same for moments: ten-thousandths below 2^31, whose products have three limbs.
_MOST_MOMENT = 1 << 31
_MOMENT_BITS = 16
_PRODUCT_BITS = 21
#: Moments keep eight places, all that products of ten-thousandths have.
_MOMENT = "decimal(38,8)"
_FACTOR = "decimal(21,8)"


def _scaled(amount: Column, most: int) -> Column:
    """The amount in ten-thousandths as a whole number; NULL if it has more places or is too large."""
    amount = amount.cast("double")
    whole = F.rint(amount * _SCALE)
    return F.when((whole / _SCALE == amount) & (F.abs(whole) < most), whole.cast("long"))


def _limbs(whole: Column, bits: int, many: int) -> list[Column]:
    """A whole number as limbs, the highest first and with the sign."""
    mask = F.lit((1 << bits) - 1)
    low = [F.shiftright(whole, bits * place).bitwiseAND(mask) for place in range(many - 2, 0, -1)]
    return [F.shiftright(whole, bits * (many - 1)), *low, whole.bitwiseAND(mask)]


def _whole(limbs: list[Column], bits: int) -> Column:
    """The number that sums of limbs stand for."""
    parts = [limb.cast(_WHOLE) * F.lit(1 << bits * place).cast("decimal(20,0)") for place, limb in enumerate(reversed(limbs))]
    out = parts[0].cast(_WHOLE)
    for part in parts[1:]:
        out = F.try_add(out, part.cast(_WHOLE)).cast(_WHOLE)
    return out


def _scaled_down(whole: Column, places: int, kind: str) -> Column:
    """A whole number of small units as a decimal with all its places; NULL where it is too large for one."""
    unit = Decimal(1).scaleb(-places)
    exact = F.try_multiply(whole.try_cast("decimal(29,0)"), F.lit(unit)).try_cast(kind)
    # Beyond 29 digits Spark keeps six places.
    return F.coalesce(exact, F.try_divide(whole, F.lit(10**places).cast("decimal(9,0)")).try_cast(kind))


def _parts(name: str) -> list[str]:
    return [f"{name}_{part}" for part in ("count", "high", "low", "others", "other", "unfit")]


def _part_sums(name: str) -> list[Column]:
    amount = F.col(name)
    whole = _scaled(amount, _MOST)
    other = F.when(whole.isNull(), amount.try_cast(_EXACT))
    high, low = _limbs(whole, _SUM_BITS, 2)
    unfit = F.count_if(amount.isNotNull() & whole.isNull() & other.isNull())
    found = [F.count(amount), F.sum(high), F.sum(low), F.count(other), F.try_sum(other), unfit]
    return [part.alias(alias) for part, alias in zip(found, _parts(name), strict=True)]


def _summed_parts(name: str) -> list[Column]:
    *_, others, other, unfit = _parts(name)
    sums = [F.try_sum(part).alias(part) for part in _parts(name)[:-1]]
    # A group whose other amounts were too large for one decimal has no total, and no larger group has.
    lost = F.count_if((F.col(others) > 0) & F.col(other).isNull())
    return [*sums, (F.coalesce(F.sum(unfit), F.lit(0)) + lost).alias(unfit)]


def group_parts(trips: DataFrame, by: list[Column | str], amounts: list[str]) -> DataFrame:
    """Trip count and the parts of each amount, per group."""
    sums = [part for name in amounts for part in _part_sums(name)]
    return trips.groupBy(*by).agg(F.count(F.lit(1)).alias("trips"), *sums)


def regroup_parts(parts: DataFrame, by: list[Column | str], amounts: list[str]) -> DataFrame:
    """Parts of coarser groups from parts of finer ones."""
    sums = [part for name in amounts for part in _summed_parts(name)]
    return parts.groupBy(*by).agg(F.coalesce(F.sum("trips"), F.lit(0)).alias("trips"), *sums)


def parts_by(source: DataFrame, by: list[Column | str], amounts: list[str]) -> DataFrame:
    """Parts per group of a source that is either trips or parts of finer groups."""
    group = regroup_parts if "trips" in source.columns else group_parts
    return group(source, by, amounts)


def total(name: str) -> Column:
    """Sum of the amount; NULL where no trip has one, or where one does not fit."""
    count, high, low, others, other, unfit = map(F.col, _parts(name))
    none = F.lit(0).cast(_EXACT)
    whole = F.when(high.isNull(), none).otherwise(_scaled_down(_whole([high, low], _SUM_BITS), _PLACES, _EXACT))
    rest = F.when(F.coalesce(others, F.lit(0)) == 0, none).otherwise(other)
    return F.when((count > 0) & (unfit == 0), F.try_add(whole, rest).cast("double"))


def average(name: str) -> Column:
    """Mean of the amount; NULL where there is no total."""
    return total(name) / F.nullif(F.col(_parts(name)[0]), F.lit(0))


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    """Every amount with itself and with those after it."""
    return list(combinations_with_replacement(names, 2))


def group_moments(trips: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """Parts and moments of the amounts, by group and by which amounts a trip has.

    Columns are those of `by`, has_x, trips, the parts, low_x and high_x (least and
    largest), s_x and s_x_y (sums of amounts and of products as decimals) and
    lost (trips with an amount that is too large for a product). Trips with an
    amount that is large or has many places are grouped by their amounts first,
    and their products are then made as decimals; of all others, only sums of
    limbs leave a task.
    """
    given, rare_ = [f"has_{name}" for name in amounts], [f"rare_{name}" for name in amounts]
    whole = {name: _scaled(F.col(name), _MOST_MOMENT) for name in amounts}
    fits = F.lit(True)
    for name in amounts:
        fits &= F.col(name).isNull() | whole[name].isNotNull()
    rows = trips.select(
        *by,
        *amounts,
        *(F.col(name).isNotNull().alias(alias) for name, alias in zip(amounts, given, strict=True)),
        *(F.when(~fits, F.col(name).cast("double")).alias(alias) for name, alias in zip(amounts, rare_, strict=True)),
        *(F.when(fits, whole[name]).alias(f"w_{name}") for name in amounts),
        fits.alias("fits"),
    )
    limbs = {f"s_{name}": _limbs(F.col(f"w_{name}"), _MOMENT_BITS, 2) for name in amounts}
    limbs |= {f"s_{x}_{y}": _limbs(F.col(f"w_{x}") * F.col(f"w_{y}"), _PRODUCT_BITS, 3) for x, y in _pairs(amounts)}
    sums = [F.sum(limb).alias(f"{name}_{place}") for name, parts in limbs.items() for place, limb in enumerate(parts)]
    ends = [end(name).alias(f"{side}_{name}") for name in amounts for side, end in (("low", F.min), ("high", F.max))]
    parts = [part for name in amounts for part in _part_sums(name)]
    grouped = rows.groupBy(*by, *given, *rare_, "fits").agg(F.count(F.lit(1)).alias("trips"), *parts, *ends, *sums)

    def usual(name: str, bits: int, places: int) -> Column:
        return _scaled_down(_whole([F.col(f"{name}_{place}") for place in range(len(limbs[name]))], bits), places, _MOMENT)

    def times_trips(value: Column, kind: str, many: str) -> Column:
        return F.try_multiply(value.try_cast(kind), F.col("trips").try_cast(many)).try_cast(_MOMENT)

    def rare_product(x: str, y: str) -> Column:
        """Exact for all but huge amounts."""
        a, b = F.col(f"rare_{x}"), F.col(f"rare_{y}")
        exact = F.try_multiply(a.try_cast(_FACTOR), b.try_cast(_FACTOR)).try_cast(_MOMENT)
        return F.coalesce(exact, (a * b).try_cast(_MOMENT))

    # A sum keeps all places, as it is multiplied by a mean later on; the places of a sum of products are only added up.
    found = {f"s_{x}": (usual(f"s_{x}", _MOMENT_BITS, _PLACES), times_trips(F.col(f"rare_{x}"), "decimal(25,8)", "decimal(12,0)")) for x in amounts}
    found |= {
        f"s_{x}_{y}": (usual(f"s_{x}_{y}", _PRODUCT_BITS, 2 * _PLACES), times_trips(rare_product(x, y), _MOMENT, "decimal(18,0)"))
        for x, y in _pairs(amounts)
    }
    as_decimals = {name: F.when(F.col("fits"), often).otherwise(rare) for name, (often, rare) in found.items()}
    one_kind = grouped.withColumns(as_decimals).withColumn("lost", F.lit(0).cast("long"))
    return regroup_moments(one_kind, [*by, *given], amounts)


def regroup_moments(parts: DataFrame, by: list[Column | str], amounts: list[str]) -> DataFrame:
    """Parts and moments of coarser groups from those of finer ones."""
    ends = [end(f"{side}_{name}").alias(f"{side}_{name}") for name in amounts for side, end in (("low", F.min), ("high", F.max))]
    names = [f"s_{name}" for name in amounts] + [f"s_{x}_{y}" for x, y in _pairs(amounts)]
    # A sum that has become too large for a decimal is missing; its trips are lost for all larger groups.
    given = F.lit(False)
    for name in amounts:
        given |= F.col(f"has_{name}") & F.col(f"s_{name}").isNull()
    for x, y in _pairs(amounts):
        given |= F.col(f"has_{x}") & F.col(f"has_{y}") & F.col(f"s_{x}_{y}").isNull()
    lost = F.sum(F.when(given & (F.col("lost") == 0), F.col("trips")).otherwise(F.col("lost")))
    sums = [F.try_sum(name).alias(name) for name in names]
    parts_ = [part for name in amounts for part in _summed_parts(name)]
    return parts.groupBy(*by).agg(F.sum("trips").alias("trips"), *parts_, *ends, *sums, lost.alias("lost"))


def summed_moments(moments: DataFrame, by: str, amounts: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """The sums that averages and correlations need, by group and over all trips; `is_all_trips` tells the latter."""
    aggregates = [F.sum("trips").alias("trips"), *(part for name in amounts for part in _summed_parts(name))]
    for name, (x, y) in pairs.items():
        both = F.col(f"has_{x}") & F.col(f"has_{y}")
        sums = {"x": f"s_{x}", "y": f"s_{y}", "xx": f"s_{x}_{x}", "yy": f"s_{y}_{y}", "xy": f"s_{x}_{y}"}
        aggregates += [F.try_sum(F.when(both, F.col(source))).alias(f"{name}_{kind}") for kind, source in sums.items()]
        aggregates += [
            F.sum(F.when(both, F.col("trips"))).alias(f"{name}_n"),
            F.sum(F.when(both, F.col("lost"))).alias(f"{name}_lost"),
            (F.min(F.when(both, F.col(f"low_{x}"))) < F.max(F.when(both, F.col(f"high_{x}")))).alias(f"{name}_x_varies"),
            (F.min(F.when(both, F.col(f"low_{y}"))) < F.max(F.when(both, F.col(f"high_{y}")))).alias(f"{name}_y_varies"),
        ]
    return moments.rollup(by).agg(F.grouping(by).cast("boolean").alias("is_all_trips"), *aggregates)


def with_correlations(sums: DataFrame, names: list[str]) -> DataFrame:
    """Adds the correlation of each pair to its summed moments, over the trips with both amounts.

    NULL where one of them does not vary, or where an amount is too large. The
    sums are centred near the means before they leave exact arithmetic, so
    large means take no digits. Each step has a select of its own, as its
    columns are used several times in the next.
    """

    def times(*factors: Column) -> Column:
        out = factors[0]
        for factor in factors[1:]:
            out = F.try_multiply(out, factor).try_cast(_MOMENT)
        return out

    def of(name: str, part: str) -> Column:
        return F.col(f"{name}_{part}")

    shifts, rests, covariances, found = {}, {}, {}, {}
    for name in names:
        n = of(name, "n").try_cast("decimal(18,0)")
        for side in "xy":
            mean = of(name, side).cast("double") / of(name, "n")
            shifts[f"{name}_shift_{side}"] = F.floor(mean).try_cast("decimal(18,0)")
            # How far the mean is from the shift.
            rest = F.try_subtract(of(name, side), times(of(name, f"shift_{side}").cast(_MOMENT), n))
            rests[f"{name}_rest_{side}"] = rest.cast("double") / of(name, "n")
        for a, b in ("xx", "yy", "xy"):
            whole = F.try_subtract(of(name, a + b), times(of(name, b), of(name, f"shift_{a}"))).try_cast(_MOMENT)
            whole = F.try_subtract(whole, times(of(name, a), of(name, f"shift_{b}"))).try_cast(_MOMENT)
            square = times(of(name, f"shift_{a}").cast(_MOMENT), of(name, f"shift_{b}"), n)
            centred = F.try_add(whole, square).cast("double") / of(name, "n")
            covariances[f"{name}_c_{a}{b}"] = centred - of(name, f"rest_{a}") * of(name, f"rest_{b}")
        variances = of(name, "c_xx") * of(name, "c_yy")
        varies = of(name, "x_varies") & of(name, "y_varies") & (of(name, "lost") == 0) & (variances > 0)
        found[name] = F.when(varies, F.try_divide(of(name, "c_xy"), F.sqrt(variances)))
    return sums.withColumns(shifts).withColumns(rests).withColumns(covariances).withColumns(found)
