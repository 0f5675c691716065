"""Covariates known before time zero: latest values, lookback flags, prior history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from stayline.operators.scale import running_total
from stayline.session import cut_lineage

_PIECES = 256


def key_table(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``rows``, written once: their real size is then known when a
    join with them is planned."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return cut_lineage(rows.select(*keys).where(known).distinct())


def reduce_to_keys(events: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events of the analysed subjects, episodes or stays only, before they are shuffled.

    ``rows`` are best a ``key_table``.  The range of the keys reaches the scan, where it skips
    row groups of files sorted by key.  The rest is a semi join: Spark broadcasts few keys,
    and for many it builds a Bloom filter of them that drops events below their shuffle
    (thresholds in ``stayline.session``).
    """
    wanted = rows.select(*keys)
    ends = wanted.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends is None or ends["low0"] is None:
        return events.where(F.lit(False))
    inside = reduce(
        lambda a, b: a & b, [F.col(k).between(F.lit(ends[f"low{i}"]), F.lit(ends[f"high{i}"])) for i, k in enumerate(keys)]
    )
    return events.where(inside).join(wanted.where(inside), list(keys), "left_semi")


def hot_slices(events: DataFrame, keys: Sequence[str], time: str, slice_rows: int) -> DataFrame | None:
    """Time ranges of keys with more rows than a task should hold: (keys, _cuts), or None.

    A task should hold the mean of all tasks, or ``slice_rows`` if that is more, so there are
    fewer such keys than tasks.  Their cuts are quantiles of their times, found in one pass
    with a sketch, at most 255 a key.  The cuts decide where rows are worked on, never the
    result; being collected (a bounded list), they are the same for every task and retry.
    """
    spark = events.sparkSession
    tasks, seen = int(spark.conf.get("spark.sql.shuffle.partitions")), Observation()
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).observe(seen, F.sum("_rows").alias("all"))
    top = counts.orderBy(F.desc("_rows")).limit(tasks).collect()
    most = max(slice_rows, (seen.get["all"] or 0) // tasks) if top else 0
    pieces = {tuple(r[k] for k in keys): min(-(-r["_rows"] // most), _PIECES) for r in top if r["_rows"] > most}
    if not pieces:
        return None
    kinds = dict(events.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    hot = F.broadcast(spark.createDataFrame(list(pieces), schema))  # fewer than tasks
    grid = [F.lit(i / _PIECES) for i in range(1, _PIECES)]
    cuts = events.join(hot, list(keys), "left_semi").groupBy(*keys).agg(F.percentile_approx(time, F.array(*grid), 10_000).alias("_cuts"))
    rows = []
    for r in cuts.collect():
        key = tuple(r[k] for k in keys)
        at = [i * _PIECES // pieces[key] - 1 for i in range(1, pieces[key])]
        rows.append((*key, sorted({r["_cuts"][i] for i in at})))
    return spark.createDataFrame(rows, f"{schema}, _cuts array<{kinds[time]}>")


def latest_before(
    rows: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    zero: str = "time_zero",
    start: str | None = "study_window_start",
    order: Sequence[str] = (),
    values: dict[str, tuple[Column, Column]] | None = None,
    flags: dict[str, Column] | None = None,
    slice_rows: int = 200_000,
) -> DataFrame:
    """As-of join: per (keys, start, zero) the latest value of several measures.

    An event counts when ``start <= time < zero`` (no lower bound when ``start`` is
    None).  ``values`` maps an output to (predicate, value); among qualifying events the
    latest ``time`` wins, then the ``order`` columns descending with NULLs last, then the
    larger value, so the result never depends on row order.  ``flags`` maps an output to
    a predicate that any event in the lookback may satisfy.

    Probes are reduced to distinct (keys, start, zero) first: label sources that agree on
    time zero share one lookup.  Probes and events of a key then stand in one line of time,
    and each measure is filled forward along it (the running maximum of its position): linear
    in both, where a join on the key alone would pair every probe with every event.  Only the
    latest event before time zero can count, so ``start`` is a check on its time.

    A key with more than ``slice_rows`` events, or more than the mean of all tasks, is cut
    into ranges of time that different tasks fill.  What a range starts with comes from a
    small table of the ranges' last positions, carried forward over the ranges of the key.
    """
    values, flags = values or {}, flags or {}
    probe_columns = [*keys, *([start] if start else []), zero]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    kind = dict(events.dtypes)[time]
    probes = rows.where(F.col(zero).isNotNull() & known).select(*probe_columns).distinct()
    wanted = {**{n: p for n, (p, _) in values.items()}, **flags}
    # the bare predicates, so that plain comparisons reach the Parquet scan
    used = events.where(reduce(lambda a, b: a | b, wanted.values())).where(known & F.col(time).isNotNull())
    places = {f"_at_{n}": F.struct(F.col(time).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], v.alias("v"))
              for n, (_, v) in values.items()}
    places |= {f"_at_{n}": F.struct(F.col(time).alias("t")) for n in flags}
    marks = used.select(
        *keys, F.col(time).alias("_time"), F.lit(False).alias("_asked"),
        *[F.when(wanted[n[4:]], place).alias(n) for n, place in places.items()],
    )
    asked = probes.select("*", F.col(zero).cast(kind).alias("_time"), F.lit(True).alias("_asked"))
    cuts = hot_slices(used.select(*keys, time), keys, time, slice_rows)
    line = [*keys]
    if cuts is not None:
        line.append("_slice")  # NULL for all other keys
        own = F.size(F.filter("_cuts", lambda c: c <= F.col("_time")))
        marks, asked = (
            df.join(F.broadcast(cuts), list(keys), "left").withColumn("_slice", F.when(F.col("_cuts").isNotNull(), own)).drop("_cuts")
            for df in (marks, asked)
        )
    # a probe stands before the events of its own moment
    ordered = Window.partitionBy(*line).orderBy("_time", F.col("_asked").desc())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = marks.unionByName(asked, allowMissingColumns=True).withColumns({n: F.max(n).over(so_far) for n in places})
    found = filled.where("_asked").select(*probe_columns, *line[len(keys):], *places)
    if cuts is not None:
        tails = marks.where("_slice IS NOT NULL").groupBy(*line).agg(*[F.max(n).alias(n) for n in places])
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ranges = cuts.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slice"))
        carried = ranges.join(tails, line, "left").select(*line, *[F.max(n).over(before).alias(f"{n}_before") for n in places])
        found = found.join(F.broadcast(carried), line, "left")  # at most 256 rows a cut key
        found = found.withColumns({n: F.coalesce(n, f"{n}_before") for n in places})
    if start:
        found = found.withColumns({n: F.when(F.col(n)["t"] >= F.col(start), F.col(n)) for n in places})
    return found.where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in places])).select(
        *probe_columns,
        *[F.col(f"_at_{n}")["v"].alias(n) for n in values],
        *[F.col(f"_at_{n}").isNotNull().alias(n) for n in flags],
    )


def attach_latest(
    rows: DataFrame,
    found: DataFrame,
    keys: Sequence[str],
    *,
    zero: str = "time_zero",
    start: str | None = "study_window_start",
    flags: Sequence[str] = (),
) -> DataFrame:
    """Join looked-up covariates back to the rows; absent flags become false."""
    on = [*keys, *([start] if start else []), zero]
    joined = rows.join(found, on, "left")
    return joined.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in flags})


def first_seen(facts: DataFrame, subject: str, item: str, time: str) -> DataFrame:
    """First time each distinct item of a subject is seen."""
    return (
        facts.where(F.col(item).isNotNull() & F.col(time).isNotNull())
        .groupBy(subject, item)
        .agg(F.min(time).alias(time))
    )


def prior_distinct_counts(
    rows: DataFrame,
    facts: dict[str, tuple[DataFrame, str, str]],
    subject: str,
    row_time: str,
) -> DataFrame:
    """Distinct items of the same subject with a time strictly before the row's time.

    ``facts`` maps an output name to (frame, item column, time column).  Result: one row
    per distinct (subject, row time) of ``rows`` with one count per name.

    The self-history inequality join pairs every row with all earlier ones.  A distinct
    item counts from the first time it is seen, so the count is a running total over
    first-seen times: linear in the history, and in two bounded levels (day, time) for a
    subject with a huge one.  All counts share one pass.
    """
    zero = F.lit(0).cast("bigint")
    probes = rows.where(F.col(row_time).isNotNull()).select(
        subject, F.col(row_time).alias("_at"), F.lit(True).alias("_asked"), *[zero.alias(n) for n in facts]
    )
    marks = [
        first_seen(frame, subject, item, time).select(
            subject,
            F.col(time).alias("_at"),
            F.lit(False).alias("_asked"),
            *[(F.lit(1).cast("bigint") if n == name else zero).alias(n) for n in facts],
        )
        for name, (frame, item, time) in facts.items()
    ]
    line = (
        reduce(DataFrame.unionByName, marks, probes)
        .groupBy(subject, "_at")
        .agg(F.bool_or("_asked").alias("_asked"), *[F.sum(n).alias(f"_new_{n}") for n in facts])
        .withColumn("_day", F.to_date("_at"))
    )
    # far fewer rows than the facts, and read twice below: the joins behind it run once
    line = cut_lineage(line)
    counted = running_total(
        line, [subject], "_at", ["_day"], {n: f"_new_{n}" for n in facts}, inclusive=False
    )
    return counted.where("_asked").select(
        subject, F.col("_at").alias(row_time), *[F.col(n).cast("bigint").alias(n) for n in facts]
    )


def attach_counts(
    rows: DataFrame, counts: DataFrame, subject: str, row_time: str, names: Sequence[str]
) -> DataFrame:
    """Join history counts back to the rows; rows without a time count nothing."""
    joined = rows.join(counts, [subject, row_time], "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names})
