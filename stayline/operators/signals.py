"""Windowed event signals per stay."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BOUNDS = ("study_window_start", "study_window_end")


def dictionary_items(dictionary: DataFrame, predicate: Column, item: str = "itemid") -> DataFrame:
    """Distinct item ids whose dictionary entry satisfies ``predicate``."""
    return dictionary.where(predicate).select(item).distinct()


def of_items(events: DataFrame, items: DataFrame, item: str = "itemid") -> DataFrame:
    """Events of the given item ids."""
    return events.join(items, item, "left_semi")


def in_window(
    cohort: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    *,
    stay: str = "stay_id",
    bounds: tuple[str, str] = BOUNDS,
) -> DataFrame:
    """Events inside their stay's closed window, with the stay id.

    The join hashes the equality keys and keeps the range test as a residual; only the
    columns needed for matching are taken from the cohort side.
    """
    start, end = bounds
    wanted = [*keys, *[c for c in (stay,) if c not in keys]]
    windows = cohort.select(*wanted, F.col(start).alias("_start"), F.col(end).alias("_end"))
    return (
        events.where(F.col(time).isNotNull())
        .join(windows, list(keys))
        .where(F.col(time).between(F.col("_start"), F.col("_end")))
        .drop("_start", "_end")
    )


@dataclass(frozen=True)
class FirstMatch:
    """What to keep of the first event that satisfies a predicate.

    ``order`` ranks events after their time, NULLs last; ``payload`` maps output names to
    event columns; ``time_name`` and ``count_name`` name MIN(time) and COUNT.
    """

    predicate: Column
    order: Sequence[str]
    payload: dict[str, str]
    time_name: str
    count_name: str


def _rank(columns: Sequence[str], payload: Sequence[str]) -> Column:
    """Ordering struct: NULLs last, closed by the payload so ties have one fixed winner."""
    parts = []
    for column in columns:
        parts += [F.col(column).isNull(), F.col(column)]
    parts += [F.col(column) for column in payload]
    return F.struct(*[part.alias(f"k{i}") for i, part in enumerate(parts)])


def _payload(payload: dict[str, str]) -> Column:
    return F.struct(*[F.col(c).alias(name) for name, c in payload.items()])


def windowed_signals(
    cohort: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    signals: dict[str, Column],
    firsts: Sequence[FirstMatch] = (),
    *,
    stay: str = "stay_id",
    bounds: tuple[str, str] = BOUNDS,
) -> DataFrame:
    """First time and count of several signals from one pass over an event table.

    ``signals`` maps a name to a predicate over event columns.  Result per stay:
    ``first_<name>_time`` and ``<name>_event_count``, both NULL for a stay without that
    signal; ``firsts`` adds attributes of first matching events.  Events that match no
    predicate are dropped before the join, and all aggregates combine on the map side, so
    a hot stay shuffles only its partial results.
    """
    carried = sorted({c for f in firsts for c in (*f.order, *f.payload.values())})
    tests = {**signals, **{f.count_name: f.predicate for f in firsts}}
    # the bare predicates, so that plain comparisons reach the Parquet scan
    flagged = events.where(reduce(lambda a, b: a | b, tests.values())).select(
        *keys,
        F.col(time).alias("_time"),
        *carried,
        *[F.coalesce(p, F.lit(False)).alias(f"_is_{name}") for name, p in tests.items()],
    )
    matched = in_window(cohort, flagged, keys, "_time", stay=stay, bounds=bounds)

    def seen(name: str, time_name: str, count_name: str) -> list[Column]:
        hit = F.col(f"_is_{name}")
        return [
            F.min(F.when(hit, F.col("_time"))).alias(time_name),
            F.nullif(F.count_if(hit), F.lit(0)).alias(count_name),
        ]

    aggregates = []
    for name in signals:
        aggregates += seen(name, f"first_{name}_time", f"{name}_event_count")
    for i, first in enumerate(firsts):
        aggregates += seen(first.count_name, first.time_name, first.count_name)
        rank = _rank(["_time", *first.order], list(first.payload.values()))
        aggregates.append(
            F.min_by(_payload(first.payload), F.when(F.col(f"_is_{first.count_name}"), rank)).alias(f"_first{i}")
        )
    # a stay has one set of keys: grouped by both, rows stay where the join has put them
    found = matched.groupBy(stay, *[k for k in keys if k != stay]).agg(*aggregates)
    for i, first in enumerate(firsts):
        found = found.withColumns({name: F.col(f"_first{i}.{name}") for name in first.payload}).drop(f"_first{i}")
    return found.drop(*[k for k in keys if k != stay])


def first_match(
    matched: DataFrame,
    order: Sequence[str],
    payload: dict[str, str],
    *,
    count_name: str,
    stay: str = "stay_id",
) -> DataFrame:
    """Attributes of the first row per stay, by ``order`` with NULLs last, and COUNT.

    For rows without a time, such as coded diagnoses.  The row is chosen by an aggregate
    over an ordering struct, which combines on the map side where a ranking window would
    move every row.
    """
    first = F.min_by(_payload(payload), _rank(order, list(payload.values())))
    found = matched.groupBy(stay).agg(first.alias("_first"), F.count(F.lit(1)).alias(count_name))
    return found.select(stay, *[F.col(f"_first.{name}").alias(name) for name in payload], count_name)
