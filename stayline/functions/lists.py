"""Ordered lists built from conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def listed(items: Sequence[tuple[Column, str | Sequence[str]]]) -> Column:
    """Array of the texts whose condition holds, in the given order, first seen kept once."""
    parts = []
    for condition, texts in items:
        texts = [texts] if isinstance(texts, str) else list(texts)
        parts.append(
            F.when(condition, F.array(*[F.lit(t) for t in texts])).otherwise(
                F.array().cast("array<string>")
            )
        )
    return F.array_distinct(F.concat(*parts))


def joined(array: Column, separator: str = "|") -> Column:
    """List as one text, NULL when it is empty."""
    return F.nullif(F.array_join(array, separator), F.lit(""))
