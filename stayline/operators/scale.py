"""Building blocks that keep one large group from landing in one task.

* ``running_total``   prefix sums inside a group, in bounded levels
* ``hash_positions``  a global, reproducible order without a global sort
* ``exact_quantiles`` exact interpolated quantiles without holding a group's values
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window, WindowSpec

from stayline.session import cut_lineage

_HASH_DIGITS = 4  # 65,536 position buckets: a table of fixed size
_DIGITS = 4  # of 16 bits


def computed_once(df: DataFrame) -> DataFrame:
    """Keep the optimizer from copying computed columns into every later use.

    Merged projections and pushed-down filters would otherwise repeat costly expressions
    (parsing, status rules) many times per row.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """``scan`` dealt out by ``key`` if it has fewer partitions than the session has cores.

    Costly work on a table of few row groups would leave cores idle; a large table has more
    partitions than cores and is left as it is, so it is never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, key)


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    buckets: Sequence[str],
    totals: dict[str, str],
    *,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums ``totals = {new column: source column}`` per group.

    ``df`` holds one row per (group, order).  ``buckets`` are ever finer, order-preserving
    values of ``order``, such as its day and its second.  Sums per bucket come first
    (partial aggregation), their running total is the offset of the next bucket, and the
    same is done inside a bucket with the next finer one.  No window ever holds more than
    the buckets of one level or the rows of one finest bucket.
    """

    def running(level: str, last: int) -> WindowSpec:
        arrow = F.col(level).desc() if descending else F.col(level).asc()
        return Window.partitionBy(*group).orderBy(arrow).rowsBetween(Window.unboundedPreceding, last)

    if not buckets:
        window = running(order, Window.currentRow if inclusive else -1)
        return df.withColumns(
            {name: F.coalesce(F.sum(source).over(window), F.lit(0)) for name, source in totals.items()}
        )
    bucket, *finer = buckets
    keys = [*group, bucket]
    inside = running_total(
        df, keys, order, finer, totals, descending=descending, inclusive=inclusive
    )
    if finer:
        sums = df.groupBy(*keys).agg(*[F.sum(source).alias(f"_sum_{n}") for n, source in totals.items()])
    else:
        # the last row of a bucket has its sum: no second aggregation of the rows
        arrow = F.col(order).desc() if descending else F.col(order).asc()
        last = F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(arrow)).isNull()
        inside = inside.withColumn("_last", last)
        sums = inside.where("_last").select(
            *keys, *[(F.col(n) if inclusive else F.col(n) + F.col(source)).alias(f"_sum_{n}") for n, source in totals.items()]
        )
        inside = inside.drop("_last")
    earlier = running(bucket, -1)
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in totals],
    )
    # the rows lie by these keys already; they compress so well that Spark would take them for
    # the small side, broadcast them all and join them in the few tasks of the offsets
    return (
        inside.hint("merge").join(offsets, keys)
        .withColumns({n: F.col(f"_offset_{n}") + F.col(n) for n in totals})
        .drop(*[f"_offset_{n}" for n in totals])
    )


def hash_positions(df: DataFrame, key: str, seed: str, position: str) -> DataFrame:
    """Number all rows from 0 in the order of ``md5(seed-key)``.

    Rows are spread over 65,536 hash buckets; the bucket counts are a table of at most
    that many rows, so its running total and its broadcast do not grow with the data.
    ``key`` must be unique.
    """
    hashed = df.withColumn(
        "_hash", F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")))
    ).withColumn("_bucket", F.substring("_hash", 1, _HASH_DIGITS))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(position, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_hash", "_bucket", "_offset")
    )


def ordered_bits(c: Column) -> Column:
    """A double as a 64-bit integer of the same order: its binary form, mirrored below zero.

    Equal values have equal integers (0.0 and -0.0 too); infinities and then NaN lie outside.
    """
    whole = F.abs(c)
    least, endless = F.lit(2.0**-1022), F.lit(float("inf"))
    size = F.when((whole >= least) & (whole < endless), whole).otherwise(1.0)  # others have no exponent of their own
    # the logarithm may be off by one next to a power of two
    guess = F.floor(F.log2(size)).cast("int")
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(size < power, guess - 1).when(size >= 2 * power, guess + 1).otherwise(guess)
    mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * F.lit(float(1 << 52))).cast("bigint")
    bits = (
        F.when(F.isnan(c), F.lit((2047 << 52) + 1))
        .when(whole == endless, F.lit(2047 << 52))
        .when(whole < least, (whole * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise((exponent + 1023).cast("bigint") * F.lit(1 << 52) + mantissa)
    )
    return F.when(c < 0, -bits).otherwise(bits)


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation: (group..., probability, quantile).

    A descent over the digits of the values' ordered bits, four of 16 bits, the same at every
    size and for every spread of the values.  In each step rows are counted by their next
    digit, in the tasks first; the running counts tell which digits hold a wanted rank, and
    only rows below those are counted again.  A window never holds more than the 65,536
    digits of one prefix.  The digits that are held (at most two a probability and group) are
    written once a step, so Spark sees how few they are and broadcasts them.
    """
    probabilities = [float(p) for p in probabilities]
    keys = list(group) or ["_all"]
    source = df if group else df.withColumn("_all", F.lit(0))
    number = F.col(value).cast("double")
    rows = cut_lineage(
        source.where(F.col(value).isNotNull()).select(*keys, number.alias("_value")).withColumn("_bits", ordered_bits(F.col("_value")))
    )
    ranks = []  # of both neighbours of every wanted spot
    for p in probabilities:
        at = (F.col("_rows") - 1) * F.lit(p)
        ranks += [F.floor(at), F.ceil(at)]
    wanted = reduce(
        lambda a, b: a | b, [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_count")) for r in ranks]
    )
    held = None
    for step in range(_DIGITS):
        cells = rows.withColumn("_cell", F.shiftright("_bits", 16 * (_DIGITS - 1 - step)))
        if held is None:
            counted = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_count"))
            whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_cell")
            counted = counted.withColumns({"_rows": F.sum("_count").over(whole), "_start": F.lit(0).cast("bigint")})
        else:
            upper = held.withColumnRenamed("_cell", "_upper")
            under = cells.withColumn("_upper", F.shiftright("_cell", 16)).join(upper, [*keys, "_upper"])
            counted = under.groupBy(*keys, "_upper", "_rows", "_start", "_cell").agg(F.count(F.lit(1)).alias("_count"), F.min("_value").alias("_value"))
            earlier = Window.partitionBy(*keys, "_upper").orderBy("_cell")
        before = F.col("_start") + F.coalesce(F.sum("_count").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("_before", before).where(wanted)
        if step == _DIGITS - 1:
            break
        held = cut_lineage(found.select(*keys, "_rows", "_cell", F.col("_before").alias("_start")))
    picks = [
        F.min(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_count")), F.col("_value"))).alias(f"_r{i}")
        for i, r in enumerate(ranks)
    ]
    picked = found.groupBy(*keys, "_rows").agg(*picks)
    out = []
    for i, p in enumerate(probabilities):
        at = (F.col("_rows") - 1) * F.lit(p)
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        out.append(F.struct(F.lit(p).alias("probability"), (low + (high - low) * (at - F.floor(at))).alias("quantile")))
    return picked.select(*group, F.inline(F.array(*out)))


def quantile_columns(
    df: DataFrame, group: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """``exact_quantiles`` as one row per group with the named columns."""
    long = exact_quantiles(df, group, value, list(wanted.values()))
    picks = [
        F.max(F.when(F.col("probability") == F.lit(p), F.col("quantile"))).alias(name)
        for name, p in wanted.items()
    ]
    return long.groupBy(*group).agg(*picks)
