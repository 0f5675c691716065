"""Graded quality by ordinal cumulative-link regression over hashed text.

Texts have graded ratings 0, 1, ... K.  One weight vector over hashed text features is
shared by all grades; ordered thresholds cut its score: P(grade <= k) = logistic(t_k - s).
The expected grade and the probability of the upper tail select documents.

Features are a text's distinct words without edge punctuation, their first four letters, the
shapes of its words (runs of letters and digits shortened, other characters as they are) and the tenth in which
its share of distinct words lies.  They are hashed to 40 bits and only those that enough
rated texts hold get a weight, so the model is a short sorted list and strangers do not
collide with it.

The fit uses at most ``sample_rows`` rated texts, those of the smallest id hashes; this
documented bound is the only one.  All documents are scored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import Memo, arrow_schema, batches, once, record_batch, require_free

_EDGES = ".,;:!?\"'()[]{}«»„“”…"
_LOWER, _UPPER, _DIGIT, _RUN = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def _hashed(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") >> 24


def word_features(word: str) -> tuple[int, int, int]:
    core = word.strip(_EDGES).lower()
    if word.isalpha() and word.islower():
        shape = "a"
    else:
        shape = _RUN.sub(r"\1", _DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", word))))[:16]
    return _hashed("word", core), _hashed("stem", core[:4]), _hashed("shape", shape)


def text_features(text: str | None, of_word=word_features) -> set[int]:
    """The hashed features of a whole text; a null or empty one only has its share."""
    words = (text or "").split()
    distinct = set(words)
    spread = _hashed("distinct", str(10 * len(distinct) // max(1, len(words))))
    return {spread}.union(*map(of_word, distinct))


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature hashes with their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))

    def scorer(self):
        """A function from text to score that remembers words."""
        weight = dict(zip(self.features.tolist(), self.weights.tolist()))
        known = Memo(lambda word: tuple(f for f in word_features(word) if f in weight), 600_000).__getitem__

        def score(text: str | None) -> float:
            return math.fsum(weight.get(f, 0.0) for f in text_features(text, known))

        return score


def _telling(features: list[np.ndarray], grades: np.ndarray, least: float, deviations: float) -> np.ndarray:
    ids, at, holders = np.unique(np.concatenate(features), return_inverse=True, return_counts=True)
    of = np.repeat(grades, [len(f) for f in features])
    far = np.zeros(len(ids))
    for k in range(int(grades.max())):
        share = (grades > k).mean()
        above = np.bincount(at, weights=of > k, minlength=len(ids))
        far = np.maximum(far, np.abs(above - holders * share) / np.sqrt(np.maximum(1e-9, holders * share * (1 - share))))
    return ids[(holders >= least) & (far >= deviations)]


def fitted(
    features: list[np.ndarray], grades: np.ndarray, *, least_share: float = 0.002, deviations: float = 4.0, prior: float = 1.0, steps: int = 200
) -> OrdinalModel:
    """The most likely model under a normal prior (``prior``: its precision), by full-batch
    Adam with falling steps.

    Only features that at least ``least_share`` of the texts (and five) hold are used, and of
    them those whose holders' grades lie ``deviations`` from all texts' at some threshold.
    Thresholds stay ordered, as a first value and positive gaps.
    """
    n, top = len(features), int(grades.max())
    penalty = prior / n
    used = _telling(features, grades, max(5, least_share * n), deviations)
    at = [np.searchsorted(used, f[np.isin(f, used, assume_unique=True)]) for f in features]
    columns, rows = np.concatenate(at), np.repeat(np.arange(n), [len(x) for x in at])
    share = np.array([np.clip((grades <= k).mean(), 0.01, 0.99) for k in range(top)])
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    index = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = p[: len(used)], np.exp(p[len(used) + 1 :])
        cuts = np.concatenate([[-np.inf], p[len(used)] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(rows, weights=w[columns], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -50, 50)))
        slope = below * (1 - below)
        slope[:, 0] = slope[:, -1] = 0
        chance = np.maximum(below[index, grades + 1] - below[index, grades], 1e-12)
        pull = (slope[index, grades] - slope[index, grades + 1]) / chance  # d log chance / d score
        by_cut = np.zeros((n, top + 2))
        by_cut[index, grades + 1] += slope[index, grades + 1] / chance
        by_cut[index, grades] -= slope[index, grades] / chance
        cut_pull = by_cut[:, 1:-1].mean(axis=0)
        g = np.concatenate([
            np.bincount(columns, weights=pull[rows], minlength=len(used)) / n - penalty * w,
            [cut_pull.sum()], [cut_pull[k + 1 :].sum() * gaps[k] for k in range(top - 1)],
        ])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.2 / (1 + 4 * step / steps)
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = p[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(p[len(used) + 1 :]))])
    return OrdinalModel(used, p[: len(used)], cuts)


def fit(
    docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    sample_rows: int = 10_000, **how,
) -> OrdinalModel | None:
    """A model from rated documents; None when fewer than two grades are rated.

    ``ratings`` has ``id_col`` and whole grades from 0; null ids and grades are left out, of
    several grades for one document the lowest counts.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(id_col).agg(F.min(grade_col).cast("int").alias("grade_"))
    sample = rated.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).withColumnRenamed(id_col, "rated_id")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("rated_id"))
    source = source.select("id", "grade_", "text")

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            sets = [np.sort(np.fromiter(text_features(t), dtype="<u8")) for t in batch.column(2).to_pylist()]
            yield {"id": batch.column(0), "grade": batch.column(1), "features": [s.tobytes() for s in sets]}

    kind = dict(docs.dtypes)[id_col]
    found = batches(source, f"id {kind}, grade int, features binary", work).toArrow().to_pylist()
    found.sort(key=lambda r: (str(r["id"]), r["features"]))
    grades = np.array([r["grade"] for r in found], dtype=np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    return fitted([np.frombuffer(r["features"], "<u8") for r in found], grades, **how)


def scored(
    docs: DataFrame, model: OrdinalModel | None, *, text_col: str = "text", above: int = 1, least: float = 0.5,
    expected: str = "expected_grade", tail: str = "tail_probability", kept: str = "kept",
) -> DataFrame:
    """``docs`` with the expected grade, P(grade > ``above``) and whether that is ``least``.

    All columns stay; the three new ones get the names given, which must be free.  Null and
    empty texts are scored like any text without words.  Without a model nothing is known:
    the two numbers are null and every row is kept.
    """
    require_free(docs, expected, tail, kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features of many texts
    name = uuid.uuid4().hex
    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    schema = f"{kinds}, `{expected}` double, `{tail}` double, `{kept}` boolean"
    arrow, at, names = arrow_schema(schema), docs.columns.index(text_col), docs.columns

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        score = once(("ordinal", name), known.scorer) if known is not None else None
        for batch in it:
            columns = {c: batch.column(i) for i, c in enumerate(names)}
            if score is None:
                columns |= {expected: [None] * batch.num_rows, tail: [None] * batch.num_rows, kept: [True] * batch.num_rows}
            else:
                tails = known.tail(np.array([score(t) for t in batch.column(at).to_pylist()]).reshape(-1))
                high = tails[:, min(above, tails.shape[1] - 1)]
                columns |= {expected: tails.sum(axis=1).tolist(), tail: high.tolist(), kept: (high >= least).tolist()}
            yield record_batch(columns, arrow)

    return docs.mapInArrow(work, schema)
