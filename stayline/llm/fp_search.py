"""Ranked lexical search through document trees.

The documents' terms are restricted to those of the searched items and counted once
(``term_vectors``).  A task reads vectors in blocks.  The vectors of a block, their terms in
order of falling document frequency, form a trie: documents with the same frequent terms
share a path.  Every node knows, for each term, the largest count of any document below it,
and the smallest length measure; both together bound the score of all documents below.  An
item walks the trie depth first, the child of the highest bound first, and leaves a subtree
alone when its bound cannot reach the item's best list so far.  The lists of all tasks are
then merged.

The items are a stated query set.  They are taken in blocks with a bounded number of distinct
terms; each block is one scan of the documents, and what is sent to the tasks stays bounded.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stayline.llm.common import batches, written

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_NO_ID = (1 << 63) - 1
#: Cells of the count matrix of one block of documents.
_CELLS = 1 << 23
#: Documents of the buckets reached that are scored together.
_AT_ONCE = 128
_PAIR = np.dtype([("term", "<i4"), ("tf", "<i4")])


def terms_of(text: str | None) -> list[str]:
    """The terms of a text: letters, digits and everything beyond ASCII; only A-Z lower-cased."""
    return _TERM.findall(text.encode().lower().decode()) if text else []


def term_vectors(docs: DataFrame, vocabulary: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, vector) of every document with a term: all its terms with repeats, and the
    counts of those in ``vocabulary`` as pairs of term number and count (4 bytes each)."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # bounded by the block of items

    def work(it: Iterator[pa.RecordBatch]):
        number = shared.value
        for batch in it:
            out: dict[str, list] = {"id": [], "n": [], "vector": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := terms_of(text):
                    held = Counter(filter(number.__contains__, found))
                    pairs = np.empty(len(held), dtype=_PAIR)
                    pairs["term"], pairs["tf"] = [number[t] for t in held], list(held.values())
                    out["id"].append(doc)
                    out["n"].append(len(found))
                    out["vector"].append(pairs.tobytes())
            yield out

    return batches(docs.select(F.col(id_col).cast("long"), text_col), "id long, n long, vector binary", work)


def document_frequencies(vectors: DataFrame) -> DataFrame:
    """(term, df): counted in the tasks first."""

    def work(it: Iterator[pa.RecordBatch]):
        counts = np.zeros(0, dtype=np.int64)
        for batch in it:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=_PAIR)["term"])
            if len(found) > len(counts):
                counts, found = found, counts
            counts[: len(found)] += found
        held = np.flatnonzero(counts)
        yield {"term": pa.array(held.astype(np.int64)), "df": pa.array(counts[held].astype(np.int64))}

    return batches(vectors.select("vector"), "term long, df long", work).groupBy("term").agg(F.sum("df").alias("df"))


class DocumentTree:
    """A block of documents as a trie of frequency-ordered term vectors.

    Nodes are paths that more than ``leaf`` documents share, cut short where a path does not
    branch; smaller neighbours under one node stand together in buckets of at most ``leaf``.
    ``parts`` holds, for each term, every document's part of a score before its weight (in
    trie order); ``caps`` the same for the nodes, from largest counts and smallest measures.
    """

    def __init__(self, vectors: list[np.ndarray], measures: list[int], ids: list[int], rank: np.ndarray, leaf: int = 8):
        ranked = [np.sort(rank[v["term"]]) for v in vectors]
        keys = [r.astype(">u4").tobytes() for r in ranked]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        n = len(order)
        tf = np.zeros((n, len(rank)), dtype=np.int32)
        for row, i in enumerate(order):
            tf[row, rank[vectors[i]["term"]]] = vectors[i]["tf"]
        m = np.array([measures[i] for i in order], dtype=np.int64)
        self.ids = np.array([ids[i] for i in order], dtype=np.int64)
        shared = np.zeros(n, dtype=np.int64)  # terms at the front that a document shares with the one before
        for row in range(1, n):
            a, b = ranked[order[row - 1]], ranked[order[row]]
            size = min(len(a), len(b))
            apart = np.flatnonzero(a[:size] != b[:size])
            shared[row] = apart[0] if len(apart) else size
        self.spans, self.children = [(0, n)], []
        for low, high in self.spans:  # grows meanwhile: the children of a node stand together
            first = len(self.spans)
            if high - low > leaf:
                inside = shared[low + 1 : high]
                cuts = (np.flatnonzero(inside == inside.min()) + low + 1).tolist()
                self.spans.extend(_buckets([low, *cuts, high], leaf))
            self.children.append((first, len(self.spans)))
        most = np.zeros((len(self.spans), len(rank)), dtype=np.int32)
        least_m = np.zeros(len(self.spans), dtype=np.int64)
        self.least_id = np.zeros(len(self.spans), dtype=np.int64)
        for node in reversed(range(len(self.spans))):
            (low, high), (a, b) = self.spans[node], self.children[node]
            inner = a < b
            most[node] = most[a:b].max(axis=0) if inner else tf[low:high].max(axis=0)
            least_m[node] = least_m[a:b].min() if inner else m[low:high].min()
            self.least_id[node] = self.least_id[a:b].min() if inner else self.ids[low:high].min()
        self.parts, self.caps = score_parts(tf, m), score_parts(most, least_m)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Bring ``best``, a heap of (score, -id) of at most ``k``, up to date with this block;
        tells how many documents were scored."""
        held = np.flatnonzero(self.caps[terms, 0])
        terms, weights = terms[held], weights[held]
        if not len(terms):
            return 0
        caps = weights @ self.caps[terms].astype(np.int64)
        cap, least_id, scored = caps.tolist(), self.least_id, 0
        todo, spans, waiting = [0], [], 0
        while todo:
            node = todo.pop()
            if cap[node] and (len(best) < k or (cap[node], -int(least_id[node])) > best[0]):
                a, b = self.children[node]
                if a < b:
                    todo.extend((a + np.argsort(caps[a:b], kind="stable")).tolist())
                else:
                    spans.append(self.spans[node])
                    waiting += spans[-1][1] - spans[-1][0]
            if spans and (waiting >= _AT_ONCE or not todo):
                self._score(spans, terms, weights, best, k)
                scored, spans, waiting = scored + waiting, [], 0
        return scored

    def _score(self, spans: list[tuple[int, int]], terms: np.ndarray, weights: np.ndarray, best: list, k: int) -> None:
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        found = weights @ self.parts[terms[:, None], rows].astype(np.int64)
        floor = best[0][0] if len(best) == k else 1
        for i in np.flatnonzero(found >= floor).tolist():
            entry = (int(found[i]), -int(self.ids[rows[i]]))
            if len(best) < k:
                heappush(best, entry)
            elif entry > best[0]:
                heapreplace(best, entry)


def score_parts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10^9 * tf) div (1000 * tf + 8 * m) for rows of counts, a row per term (at most 10^6).

    It grows with tf and falls with m, so largest counts and a smallest measure give a bound.
    """
    out = np.zeros(tf.shape[::-1], dtype=np.int32)
    row, term = tf.nonzero()
    counts = tf[row, term].astype(np.int64)
    out[term, row] = 1_000_000_000 * counts // (1000 * counts + 8 * m[row])
    return out


def _buckets(cuts: list[int], leaf: int) -> Iterator[tuple[int, int]]:
    """The spans between ``cuts``, small neighbours joined while they hold at most ``leaf``."""
    open_from = cuts[0]
    for low, high in zip(cuts, cuts[1:]):
        if high - open_from > leaf:
            if open_from < low:
                yield open_from, low
            open_from = low
        if high - low > leaf:
            yield low, high
            open_from = high
    if open_from < cuts[-1]:
        yield open_from, cuts[-1]


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_blocks(items: DataFrame, id_col: str, text_col: str, most_terms: int, most_items: int) -> Iterator[list[tuple]]:
    """(item id, distinct terms) in blocks, read one by one."""
    block, held = [], set()
    for item, text in items.select(id_col, text_col).toLocalIterator():
        if own := set(terms_of(text)):
            if block and (len(held | own) > most_terms or len(block) == most_items):
                yield block
                block, held = [], set()
            block.append((item, sorted(own)))
            held |= own
    if block:
        yield block


def ranked(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", k: int = 10, most_terms: int = 8192, most_items: int = 1000,
) -> DataFrame:
    """For every row of ``items`` its ``k`` best documents: ``item_col``, rank (from 1),
    ``id_col`` (long), score.

    Scores are those of the module's weights: N counts the documents with a term, L their
    terms; a document's measure m is 10 + (90 * n * N) div L.  Only scores above 0 are listed;
    equal scores go by ascending id, rows without an id last.  Null and empty texts have no
    terms, so they are neither counted nor listed, and such items get no rows.  Repeated
    documents are documents of their own, repeated items each get their list.  Empty tables
    give an empty result.  Other columns are not read.

    Items are searched in blocks of at most ``most_items`` with at most ``most_terms`` distinct
    terms (one item alone may have more), one scan of the documents each.
    """
    kind = dict(items.dtypes)[item_col]
    parts = [
        _block_best(docs, block, id_col, text_col, kind, k)
        for block in _item_blocks(items, item_col, item_text_col, most_terms, most_items)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    return reduce(DataFrame.unionByName, parts).select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _block_best(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, kind: str, k: int) -> DataFrame:
    vocabulary = sorted({t for _, own in block for t in own})
    vectors = written(term_vectors(docs, vocabulary, id_col=id_col, text_col=text_col), "term-vectors")
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.term: r.df for r in document_frequencies(vectors).collect()}  # at most the block's terms
    by_frequency = sorted(range(len(vocabulary)), key=lambda t: (-df.get(t, 0), vocabulary[t]))
    rank = np.empty(len(vocabulary), dtype=np.int64)
    rank[by_frequency] = np.arange(len(vocabulary))
    place = {t: int(rank[i]) for i, t in enumerate(vocabulary)}
    weights = np.array([weight(df.get(t, 0), n_docs) for t in by_frequency], dtype=np.int64)
    asked = [(item, np.array([place[t] for t in own], dtype=np.int64)) for item, own in block]
    shared = docs.sparkSession.sparkContext.broadcast((asked, rank, weights))
    block_docs = max(1, _CELLS // len(vocabulary))

    def work(it: Iterator[pa.RecordBatch]):
        asked, rank, weights = shared.value
        best: list[list] = [[] for _ in asked]
        vectors, measures, ids = [], [], []

        def close():
            if vectors:
                tree = DocumentTree(vectors, measures, ids, rank)
                for heap, (_, terms) in zip(best, asked):
                    tree.search(terms, weights[terms], heap, k)
                for column in (vectors, measures, ids):
                    column.clear()

        for batch in it:
            for doc, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if raw:
                    vectors.append(np.frombuffer(raw, dtype=_PAIR))
                    measures.append(10 + 90 * n * n_docs // n_terms)
                    ids.append(_NO_ID if doc is None else doc)
                    if len(vectors) >= block_docs:
                        close()
        close()
        rows = [(at, item, s, -i) for at, (heap, (item, _)) in enumerate(zip(best, asked)) for s, i in heap]
        yield {
            "at": [r[0] for r in rows], "item": [r[1] for r in rows], "score": [r[2] for r in rows],
            "id": [None if r[3] == _NO_ID else r[3] for r in rows],
        }

    found = batches(vectors.select("id", "n", "vector"), f"at int, item {kind}, score long, id long", work)
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
