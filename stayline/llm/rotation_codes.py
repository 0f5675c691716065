"""Near-duplicate vectors by randomised-rotation binary codes.

Vectors meet only under equal labels.  A unit vector is turned by a fixed random rotation
and coded once, by its signs (one bit a component) and, for its part as a query, by its
components in four bits.  The stored correction factor is the inner product of the code with
the vector.  Code times query over factor, added up from bit counts, is an unbiased estimate
of the cosine, with an error bound that the factor and the query's step give; the bound
decides which pairs can reach the threshold.  Vectors are fetched only for rows with such a
pair, and only such pairs are computed exactly, in double precision.

Pairs come from cells.  A label with n distinct vectors uses tables of b random
hyperplanes each, so that a pair at the threshold shares a cell in some table but for a
chance of 1e-9; b minimises the expected work, and is 0 (one cell, blocks against blocks)
for small labels.  Large cells are cut into blocks, every pair of blocks is a group of its
own, and a pair of vectors counts in the first table it shares.  Pairs never leave their
group: it gives, per vector, the number of links and the smallest vector of its local
component.  Copies for tables and blocks hold codes and factors, no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from stayline.llm.common import arrow_schema, batches, written
from stayline.llm.components import components

_BLOCK = 8192
_EXACT = 200_000
_MISS = 1e-9
_DEVIATIONS = 6.0
_MOST_BITS = 48
_PLANES = 4
#: Estimated pairs that cost as much as one more copy of a row.
_COPY = 1500


def tables_needed(bits: int, cosine: float) -> int:
    """Tables of ``bits`` hyperplanes that miss a pair at the threshold with chance 1e-9."""
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if share >= 1 else math.ceil(math.log(_MISS) / math.log1p(-share))


def plan(cosine: float) -> list[tuple[int, int, float]]:
    """(bits, tables, from how many vectors on); expected pairs and copied rows decide."""

    def cost(bits: int, n: float) -> float:
        cell = n / 2.0**bits
        return tables_needed(bits, cosine) * n * (cell / 2 + _COPY * (1 + math.ceil(cell / _BLOCK)))

    out = [(0, 1, 0.0)]
    for exponent in range(20, 320):
        n = 2.0 ** (exponent / 4)
        best = min(range(_MOST_BITS + 1), key=lambda b: cost(b, n))
        if best > out[-1][0]:
            out.append((best, tables_needed(best, cosine), n))
    return out


def _chosen(n: Column, steps: list[tuple[int, int, float]], which: int) -> Column:
    out = F.lit(steps[0][which])
    for step in steps[1:]:
        out = F.when(n >= step[2], F.lit(step[which])).otherwise(out)
    return out


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The fixed random rotation of a dimension."""
    q, r = np.linalg.qr(np.random.default_rng(20240 + dim).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def signatures(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One cell number per vector and table."""
    out = np.zeros((len(units), tables), dtype=np.int64)
    for t in range(tables if bits else 0):
        planes = np.random.default_rng(7919 * t + units.shape[1]).standard_normal((_MOST_BITS, units.shape[1]))[:bits]
        out[:, t] = (units @ planes.T > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return out


def coded(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, sign codes (+1 and -1) and correction factors."""
    turned = units.astype(np.float32) @ turn.T
    signs = np.where(turned >= 0, np.float32(1), np.float32(-1))
    return turned, signs, np.abs(turned).sum(axis=1) / np.float32(math.sqrt(units.shape[1]))


@dataclass(frozen=True)
class Codes:
    """Stored form of vectors: sign bits and query planes in 64-bit words, and per vector the
    correction factor, the smallest component and the step of its query form."""

    code: np.ndarray
    planes: np.ndarray
    numbers: np.ndarray
    dim: int

    @classmethod
    def of(cls, units: np.ndarray) -> Codes:
        n, dim = units.shape
        turned, signs, factors = coded(units, rotation(dim))
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / (2**_PLANES - 1), np.float32(1e-12))
        # rounding up by a fixed random part has no bias
        up = np.random.default_rng(31 + dim).random(dim, dtype=np.float32)
        levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + up), 0, 2**_PLANES - 1).astype(np.uint8)
        bits = np.zeros((n, 1 + _PLANES, -(-dim // 64) * 64), dtype=np.uint8)
        bits[:, 0, :dim] = signs > 0
        for at in range(_PLANES):
            bits[:, 1 + at, :dim] = levels >> at & 1
        words = np.packbits(bits, axis=2, bitorder="little").view("<u8")
        return cls(words[:, 0], words[:, 1:], np.column_stack([factors, low, step]).astype("<f4"), dim)

    def rows(self) -> list[bytes]:
        """One value per vector: words, then numbers."""
        words = np.concatenate([self.code[:, None], self.planes], axis=1)
        return [w.tobytes() + x.tobytes() for w, x in zip(words, self.numbers)]

    @classmethod
    def read(cls, rows: list[bytes], dim: int) -> Codes:
        wide = -(-dim // 64)
        raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
        words = raw[:, :-12].copy().view("<u8").reshape(len(rows), 1 + _PLANES, wide)
        return cls(words[:, 0], words[:, 1:], raw[:, -12:].copy().view("<f4"), dim)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.code[at], self.planes[at], self.numbers[at], self.dim)

    def estimates(self, queries: Codes) -> np.ndarray:
        """Unbiased estimates of all cosines (coded vector, query)."""
        shape = (len(self.code), len(queries.code))
        dots = np.zeros(shape, dtype=np.uint16 if self.dim < 4096 else np.uint32)
        shared, counts = np.empty(shape, dtype=np.uint64), np.empty(shape, dtype=np.uint8)
        for at in reversed(range(_PLANES)):
            dots <<= 1
            for word in range(self.code.shape[1]):
                np.bitwise_and(self.code[:, word, None], queries.planes[None, :, at, word], out=shared)
                dots += np.bitwise_count(shared, out=counts)
        ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.float32)
        levels = np.bitwise_count(queries.planes).sum(axis=2) @ (2.0 ** np.arange(_PLANES))
        low, step = queries.numbers[:, 1], queries.numbers[:, 2]
        inner = dots * (2 * step) - (self.dim * low + step * levels.astype(np.float32))
        inner += (2 * ones)[:, None] * low
        inner /= np.float32(math.sqrt(self.dim)) * self._factors()[:, None]
        return inner

    def possible(self, queries: Codes, cosine: float) -> np.ndarray:
        """Which pairs (coded vector, query) the confidence bound cannot rule out.

        At the threshold a query leaves the coded vector's direction by the threshold's
        sine; only that part, and the rounding of the query, errs.
        """
        factors = self._factors()
        turned = np.maximum(0, 1 - factors**2) * np.float32((1 - cosine**2) / max(1, self.dim - 1))
        bound = turned[:, None] + (queries.numbers[:, 2] / 2) ** 2
        np.sqrt(bound, out=bound)
        bound *= np.float32(_DEVIATIONS) / factors[:, None]
        return self.estimates(queries) + bound >= np.float32(cosine - 1e-4)

    def _factors(self) -> np.ndarray:
        return np.maximum(self.numbers[:, 0], np.float32(1e-6))


def _forest(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """The smallest position reachable from each of n positions over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[cols])
        new = root.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, cols, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors in double precision from stored vectors of one kind."""
    raw = b"".join(column.to_pylist())
    wide = len(raw) > 4 * dim * len(column)
    raw = np.frombuffer(raw, dtype="<f8" if wide else "<f4").astype(np.float64).reshape(-1, dim)
    if wide:  # squares of doubles may leave their range
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def usable(vector, kind: str = "<f4") -> bytes | None:
    """The bytes of a vector; None if it is null, empty, zero, or has a null or non-finite
    component."""
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return None
    values = np.asarray(vector, dtype=kind)
    return values.tobytes() if np.isfinite(values).all() and values.any() else None


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """Per row: ``id_col``, n_links (other vectors linked directly), component_id (smallest
    id reachable, itself included) and kept (the id is the component's).

    Vectors are compared only under equal, non-null labels and equal length.  Unusable
    vectors (see ``usable``), rows without a label and rows without an id link with nothing;
    a row without an id has no component and is kept.  Equal vectors are linked with each
    other, repeated rows included.  An empty table gives an empty result.
    """

    double = isinstance(vectors.schema[vector_col].dataType.elementType, DoubleType)
    kind, size = ("<f8", 8) if double else ("<f4", 4)

    def read(it: Iterator[pa.RecordBatch]):
        for batch in it:
            raw = [usable(v, kind) if i is not None and g is not None else None for i, v, g in zip(*(c.to_pylist() for c in batch.columns))]
            yield {
                "id": batch.column(0), "label": batch.column(2), "vector": raw,
                "dim": [None if v is None else len(v) // size for v in raw],
                "same": [None if v is None else xxhash.xxh3_128_digest(v) for v in raw],
            }

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col), F.col(label_col).cast("string").alias("label"))
    rows = written(batches(source, "id long, label string, vector binary, dim int, same binary", read), "vectors")
    key = ["label", "dim", "same"]
    classes = rows.where("same IS NOT NULL").groupBy(*key).agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("vector").alias("vector")
    )
    steps = plan(cosine)

    def code(it: Iterator[pa.RecordBatch]):
        for batch in it:
            found = [b""] * batch.num_rows
            for dim, at in _by(batch.column(1)):
                for i, row in zip(at, Codes.of(_matrix(batch.column(5).take(pa.array(at)), dim)).rows()):
                    found[i] = row
            yield {**dict(zip((*key, "rep", "copies", "vector"), batch.columns)), "code": found}

    classes = written(
        batches(classes.select(*key, "rep", "copies", "vector"), "label string, dim int, same binary, rep long, copies long, vector binary, code binary", code),
        "classes",
    )
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = sizes.select("label", "dim", _chosen(F.col("n"), steps, 0).alias("bits"), _chosen(F.col("n"), steps, 1).alias("tables"))

    def cells(it: Iterator[pa.RecordBatch]):
        for batch in it:
            label, same, stored = (batch.column(c) for c in (0, 2, 3))
            for (dim, bits, tables), at in _by(*(batch.column(c) for c in (1, 5, 6))):
                at = pa.array(at)
                marks = signatures(_matrix(batch.column(4).take(at), dim), bits, tables)
                for t in range(tables):
                    yield {
                        "label": label.take(at), "dim": [dim] * len(at), "place": [t] * len(at),
                        "cell": pa.array(marks[:, t]), "same": same.take(at), "code": stored.take(at),
                    }

    dealt = classes.join(sizes, ["label", "dim"]).select(*key, "code", "vector", "bits", "tables")
    spread = written(batches(dealt, "label string, dim int, place int, cell long, same binary, code binary", cells), "cells")
    cell = ["label", "dim", "place", "cell"]
    counts = spread.groupBy(*cell).agg(F.ceil(F.count("*") * F.greatest(F.lit(1.0), F.col("dim") / 128) / _BLOCK).alias("blocks")).where("blocks > 0")
    block = F.pmod(F.xxhash64("same"), F.col("blocks"))
    blocks = (
        spread.join(counts, cell).withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
    )
    pair = [*cell, "left", "right"]
    open_schema = "label string, dim int, place int, cell long, left long, right long, own long, same binary"
    open_arrow = arrow_schema(open_schema)

    def sides(group: pa.Table) -> tuple[Codes, np.ndarray, np.ndarray, bool]:
        dim, left, right = (group[c][0].as_py() for c in ("dim", "left", "right"))
        codes, own = Codes.read(group["code"].to_pylist(), dim), group["own"].to_numpy()
        return codes, np.flatnonzero(own == left), np.flatnonzero(own == right), left == right

    def near(codes: Codes, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        queries = codes.take(right)
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(codes.take(some).possible(queries, cosine))
            i, j = some[i], right[j]
            yield (i[i < j], j[i < j]) if same else (i, j)

    def opened(group: pa.Table) -> pa.Table:
        codes, left, right, same = sides(group)
        held = np.zeros(group.num_rows, dtype=bool)
        for i, j in near(codes, left, right, same):
            held[i] = held[j] = True
        return group.filter(pa.array(held)).select(open_arrow.names).cast(open_arrow)

    open_rows = written(blocks.groupBy(*pair).applyInArrow(opened, open_schema), "open")
    fetched = open_rows.join(classes, key).join(sizes, ["label", "dim"])
    schema = "label string, dim int, same binary, rep long, links long, low long"
    arrow = arrow_schema(schema)

    def compare(group: pa.Table) -> pa.Table:
        # one order whatever the rows' arrival, so that a group's pairs are found alike again
        group = group.sort_by([("rep", "ascending"), ("same", "ascending")])
        dim, place, bits, tables = (group[c][0].as_py() for c in ("dim", "place", "bits", "tables"))
        reps, copies = (group[c].to_numpy() for c in ("rep", "copies"))
        units = _matrix(group["vector"], dim)
        marks = signatures(units, bits, min(place, tables))
        codes, left, right, same = sides(group)
        links, rows, cols = np.zeros(len(reps), dtype=np.int64), [], []
        for i, j in near(codes, left, right, same):
            for a in range(0, len(i), _EXACT):
                x, y = i[a : a + _EXACT], j[a : a + _EXACT]
                linked = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
                linked &= ~(marks[x] == marks[y]).any(axis=1)  # counted in an earlier table
                x, y = x[linked], y[linked]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                # a chain is all that a run of pairs needs to stay connected
                rows.append(x)
                cols.append(y)
            if sum(map(len, rows)) > 4 * _EXACT:
                rows, cols = _thinned(rows, cols, len(reps))
        rows, cols = _thinned(rows, cols, len(reps))
        root = _forest(rows[0], cols[0], len(reps))
        group = group.append_column("links", pa.array(links)).append_column("low", pa.array(reps[root]))
        return group.filter(pa.array(links > 0)).select(arrow.names).cast(arrow)

    found = written(fetched.groupBy(*pair).applyInArrow(compare, schema), "links")
    links = found.groupBy(*key).agg(F.sum("links").alias("links"))
    linked = components(found.select("rep", "low"))
    named = (
        classes.select(*key, "rep", "copies").join(links, key, "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("shared"))
    )
    joined = rows.select("id", *key).join(named, key, "left")
    component = F.coalesce("shared", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _by(*columns) -> list[tuple]:
    """Row numbers of a batch by the values of one or several columns."""
    found: dict = {}
    for at, values in enumerate(zip(*(c.to_pylist() for c in columns))):
        found.setdefault(values[0] if len(columns) == 1 else values, []).append(at)
    return list(found.items())


def _thinned(rows: list[np.ndarray], cols: list[np.ndarray], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """At most n pairs with the same components."""
    none = np.zeros(0, dtype=np.int64)
    root = _forest(np.concatenate([*rows, none]), np.concatenate([*cols, none]), n)
    at = np.flatnonzero(root != np.arange(n))
    return [at], [root[at]]
