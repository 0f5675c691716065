"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct word shingles, each a 64-bit hash.  Its sketch is the k
smallest hashes.  Documents with equal sets are one class from the start.

Candidates: inverted lists of retained values.  A list belongs to a run of four neighbouring
retained values: neighbours in the union of two sets that are in both are neighbours in both
sketches, so similar sets share many runs, while one passage that a third of all documents
hold makes few long lists.  The chance that two sets of similarity 0.85 share no run of four
among 64 values is about 5e-9 (2e-6 for 0.8); for sets that fit into the sketch, none of 0.8
or more is lost (sets of up to 16 shingles also use runs of two and three).

A list of at most ``short`` classes gives its pairs; the union of two sketches estimates
their similarity, and pairs more than five deviations too low go.  A longer list is not
expanded: its most connected member becomes its pivot, and only pivot and member are
compared.  Members that two links don't connect with the pivot are then compared, in blocks,
with the members of all its lists whose distance from the pivot allows a link at all
(Jaccard distance is a metric) and that are not known to be connected with them.  Every link is confirmed on
full sets.  No partner or candidate is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from stayline.llm.common import arrow_schema, batches, record_batch, written
from stayline.llm.components import components

_WIDE = 256
_BLOCK = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int = 3) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a whole text.

    Words are runs without ASCII blanks, A-Z in lower case; fewer than ``size`` words make
    one shingle, none make an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            rolled = rolled * _MIX[0] + _finished(hashes[i : i + len(rolled)])
        return np.unique(_finished(rolled))


def run_keys(sketch: np.ndarray) -> np.ndarray:
    """One hash per run of four neighbouring values; short sketches add runs of two and three."""
    parts = []
    with np.errstate(over="ignore"):
        for width in (2, 3, 4) if len(sketch) <= 16 else (4,):
            if (n := len(sketch) - width + 1) > 0:
                rolled = np.full(n, width, dtype=np.uint64)
                for i in range(width):
                    rolled = rolled * _MIX[1] + sketch[i : i + n]
                parts.append(_finished(rolled))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity from the k smallest values of the union of two sketches; exact
    when both sketches hold their whole sets."""
    union = np.union1d(a, b)
    whole = len(a) < k and len(b) < k
    top = union if whole else union[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= top[-1])) / len(top) if len(top) else 0.0


def _least(percent: int, k: int) -> float:
    t = percent / 100
    return t - 5 * math.sqrt(t * (1 - t) / k)


def may_link(a: np.ndarray, b: np.ndarray, k: int, percent: int) -> bool:
    """Whether two sketches leave a link open; decided where they hold their whole sets."""
    if len(a) < k and len(b) < k:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)
    return estimate(a, b, k) >= _least(percent, k)


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose union sketch does not speak against ``percent``."""
    a, b = (sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")).hint("merge") for c in "ab")

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            near = [may_link(x, y, k, percent) for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)))]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield {"a": kept.column(0), "b": kept.column(1)}

    return batches(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), "a long, b long", work)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, star) with linked and distance, on full sets."""
    a, b = (sets.select(F.col("id").alias(c), F.col("values").alias(f"v{c}")).hint("merge") for c in "ab")

    def work(it: Iterator[pa.RecordBatch]):
        for batch in it:
            linked, distance = [], []
            for x, y in zip(_arrays(batch.column(3)), _arrays(batch.column(4))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                linked.append(100 * both >= percent * union)
                distance.append(1 - both / union)
            yield {"a": batch.column(0), "b": batch.column(1), "star": batch.column(2), "linked": linked, "distance": distance}

    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "star", "va", "vb")
    return batches(joined, "a long, b long, star boolean, linked boolean, distance double", work)


def _labels(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node within two links.  Equal labels mean connected."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    far = both.join(near.select(F.col("a").alias("b"), "low"), "b")
    return far.groupBy(F.col("a").alias("node")).agg(F.least(F.min("low"), F.min("b"), F.col("node")).alias("label"))


def _within_pivots(star: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one pivot that may link and are not known to be connected.

    Members are banded by their distance from the pivot, one band as wide as the largest
    distance of a link, so only equal and neighbouring bands meet.  At least one of a pair
    has another label than the pivot.
    """
    width = 1 - percent / 100
    node = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_c"))
    rows = star.join(node("b"), "b", "left").join(node("a"), "a", "left").select(
        F.col("a").alias("pivot"), F.col("b").alias("id"), F.floor(F.col("distance") / width).cast("int").alias("band"),
        F.coalesce("b_c", "b").alias("comp"), F.coalesce("a_c", "a").alias("pivot_comp"),
    ).withColumn("probe", F.col("comp") != F.col("pivot_comp"))
    sizes = rows.groupBy("pivot", "band").agg(F.count("*").alias("n"), F.count_if("probe").alias("n_probe"))
    sizes = sizes.withColumns({"blocks": F.ceil(F.col("n") / _BLOCK), "probe_blocks": F.ceil(F.col("n_probe") / _BLOCK)}).drop("n", "n_probe")
    tops = sets.select("id", F.substring("values", 1, 8 * _WIDE).alias("sketch"))
    rows = written(rows.join(tops, "id"), "members")
    block = F.pmod(F.xxhash64("id"), F.greatest(F.col("own"), F.lit(1)))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    own = sizes.withColumnsRenamed({"blocks": "own"}).drop("probe_blocks")
    others = sizes.select("pivot", F.col("band").alias("probe_band"), F.col("probe_blocks").alias("others")).where("others > 0")
    members = (
        rows.join(own, ["pivot", "band"]).withColumn("probe_band", near).join(others, ["pivot", "probe_band"])
        .select("pivot", F.col("band").alias("member_band"), "probe_band", block.alias("member_block"),
                F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("probe_block"), "id", "comp", "sketch")
    )
    own = sizes.withColumnsRenamed({"probe_blocks": "own"}).drop("blocks")
    others = sizes.select("pivot", F.col("band").alias("member_band"), F.col("blocks").alias("others"))
    probes = (
        rows.where("probe").join(own, ["pivot", "band"]).withColumn("member_band", near).join(others, ["pivot", "member_band"])
        .select("pivot", "member_band", F.col("band").alias("probe_band"),
                F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("others") - 1)).alias("member_block"), block.alias("probe_block"), "id", "comp", "sketch")
    )
    least, out_schema = _least(percent, _WIDE), "a long, b long"
    arrow = arrow_schema(out_schema)

    def work(members: pa.Table, probes: pa.Table) -> pa.Table:
        found: dict[str, list] = {"a": [], "b": []}
        if members.num_rows and probes.num_rows:
            m_id, m_comp, p_id, p_comp = (t[c].to_numpy() for t, n in ((members, "m"), (probes, "p")) for c in (f"{n}_id", f"{n}_comp"))
            m_set, p_set = _arrays(members["m_sketch"]), _arrays(probes["p_sketch"])
            over = _overlaps(p_set, m_set)
            short = np.minimum.outer([len(s) for s in p_set], [len(s) for s in m_set])
            near = (over >= least * short) & (p_comp[:, None] != m_comp[None, :])
            for i, j in zip(*np.nonzero(near)):
                if may_link(p_set[i], m_set[j], _WIDE, percent):
                    found["a"].append(min(p_id[i], m_id[j]))
                    found["b"].append(max(p_id[i], m_id[j]))
        return pa.Table.from_batches([record_batch(found, arrow)])

    keys = ["pivot", "member_band", "probe_band", "member_block", "probe_block"]
    sides = [
        df.select(*[F.col(c).alias(f"{n}_{c}") for c in (*keys, "id", "comp", "sketch")]).groupBy(*[f"{n}_{k}" for k in keys])
        for df, n in ((members, "m"), (probes, "p"))
    ]
    return sides[0].cogroup(sides[1]).applyInArrow(work, out_schema).distinct()


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values every left and every right sketch share."""
    values, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [len(s) for s in (*left, *right)]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    common = np.bincount(inverse, minlength=len(values)) > 1
    place = np.cumsum(common) - 1
    keep = common[inverse]
    held = np.zeros((len(sizes), int(common.sum())), dtype=np.float32)
    held[rows[keep], place[inverse[keep]]] = 1
    return held[: len(left)] @ held[len(left) :].T


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = 64, short: int = 48
) -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id (smallest id reachable by links, itself
    included) and kept (the id is the component's).

    Two texts are linked when 100 * intersection >= ``percent`` * union of their shingle
    sets.  Null texts and texts without words have an empty set and link with nothing.  Rows
    without an id take no part: their component is null and they are kept.  Rows of one id
    and different texts are judged by their texts.  Repeated rows give repeated results, an
    empty table none.  Ids are integers.
    """

    def read(it: Iterator[pa.RecordBatch]):
        for batch in it:
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            yield {
                "id": batch.column(0), "n_shingles": [len(s) for s in sets],
                "class": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [s[:k].tobytes() for s in sets],
            }

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(batches(source, "id long, n_shingles long, class binary, sketch binary", read), "sketches")
    classes = written(
        rows.where("id IS NOT NULL AND class IS NOT NULL").groupBy("class")
        .agg(F.min("id").alias("rep"), F.min_by("sketch", "id").alias("sketch")), "classes",
    )
    sketches = classes.select("rep", "sketch")

    def keys(it: Iterator[pa.RecordBatch]):
        for batch in it:
            runs = [run_keys(s) for s in _arrays(batch.column(1))]
            reps = np.repeat(batch.column(0).to_numpy(), [len(r) for r in runs])
            yield {"key": pa.array(np.concatenate([*runs, np.zeros(0, np.uint64)]).view(np.int64)), "rep": pa.array(reps)}

    lists = batches(sketches, "key long, rep long", keys).withColumn("n", F.count("*").over(Window.partitionBy("key")))
    lists = written(lists.where("n > 1"), "lists")
    few, many = lists.where(F.col("n") <= short), lists.where(F.col("n") > short)
    other = few.select("key", F.col("rep").alias("b"))
    pairs = few.join(other, "key").where("rep < b").select(F.col("rep").alias("a"), "b").distinct()
    popular = lists.groupBy("rep").agg(F.sum("n").alias("popular"))
    pivots = many.join(popular, "rep").groupBy("key").agg(F.max(F.struct("popular", "rep"))["rep"].alias("pivot"))
    star = many.join(pivots, "key").where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    near = _estimated(pairs, sketches, percent, k)
    pairs = star.withColumn("star", F.lit(True)).unionByName(near.withColumn("star", F.lit(False)))
    pairs = written(pairs.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def full(it: Iterator[pa.RecordBatch]):
        for batch in it:
            yield {"id": batch.column(0), "values": [shingle_set(t, shingle).tobytes() for t in batch.column(1).to_pylist()]}

    sets = written(batches(source.join(wanted.hint("merge"), "id", "left_semi"), "id long, values binary", full), "sets")
    compared = written(_compared(pairs, sets, percent), "compared")
    links = compared.where("linked").select("a", "b")
    star = compared.where("star").groupBy("a", "b").agg(F.min("distance").alias("distance"))
    if not compared.where("star").isEmpty():
        labels = written(_labels(links), "labels")
        rest = written(_within_pivots(star, sets, labels, percent).withColumn("star", F.lit(False)), "rest")
        more = _compared(rest, sets, percent).where("linked").select("a", "b")
        # the labels are short cuts: they leave fewer rounds
        links = links.unionByName(more).unionByName(labels.toDF("a", "b"))
    linked = components(links)

    named = classes.select("class", "rep").join(linked, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("class").alias("its"), F.coalesce("component", "rep").alias("shared"))
    found = rows.drop("sketch").join(named, F.col("class") == F.col("its"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("shared", "id"))
    return found.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
