"""Spelling variants: words of a corpus that differ by one edit, grouped under frequent ones.

The vocabulary is scanned as sorted lists.  A word is compared with a sorted list by one
edit-distance matrix of which only the three diagonals around the main one are kept: the next
list word takes over the rows of the prefix it shares with the word before, and where a row
has no value within one edit, all list words with that prefix are skipped.

Which words stand in one list: an edit between two words lies at the end of their common
prefix, so it lies in one of the two halves of the shorter word, and the words agree on
everything before and behind that half.  A list holds the words of one length (and of one
more) that agree outside one half.  Lists of more than ``most`` words are dealt anew with the
half cut in two, and so on down to one code point, where a list holds no more words than two
letters of the alphabet can tell apart.  Every pair is found in exactly one list.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import batches, written

_RUNS = "a-zÀ-ÿ"
_FLUSH = 200_000
_FAR = 2
_END = "\U0010ffff"


def _rows_of_band() -> list[tuple[int, ...]]:
    """The next row of the band, for each row (three values of 0 to 2, in base 3) and each
    pattern of which of the three letters are equal: 27 rows, 8 patterns."""

    def step(left: int, main: int, right: int, equal: int) -> int:
        a = min(main + 1, left + (not equal & 1), _FAR)
        b = min(main + (not equal & 2), right + 1, a + 1, _FAR)
        c = min(right + (not equal & 4), b + 1, _FAR)
        return a * 9 + b * 3 + c

    return [tuple(step(row // 9, row // 3 % 3, row % 3, equal) for equal in range(8)) for row in range(27)]


_STEP = _rows_of_band()
_DEAD = _FAR * 9 + _FAR * 3 + _FAR
_FIRST, _INNER = _FAR * 9 + 1, 9 + 1  # rows after a prefix without a difference: at 0, further on


def near_in_list(words: list[str], length: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(i, j): word i has ``length`` code points, word j that many or one more, they are one
    edit apart and part at ``start`` or later, and before ``end`` unless that is the length.

    ``words`` are distinct, sorted, agree up to ``start`` and from ``end`` on (counted from
    the back), and have ``length`` or one more code points.
    """
    n = len(words)
    shared = [start] * (n + 1)  # prefix shared with the word before
    for j in range(1, n):
        a, b, d = words[j - 1], words[j], start
        stop = min(len(a), len(b))
        while d < stop and a[d] == b[d]:
            d += 1
        shared[j] = d
    rows = [0] * (length + 2)
    rows[start] = _INNER if start else _FIRST
    for i, word in enumerate(words):
        if len(word) != length:
            continue
        if end < length:  # words that part later belong to another list
            skip, resume = bisect_left(words, word[:end]), bisect_left(words, word[:end] + _END)
        else:
            skip = resume = n
        letters = word + "\0\0"  # no word holds this
        j, held = 0, start
        while j < n:
            if j == skip:
                held = min([held, *shared[j:resume]])
                j = resume
                continue
            other = words[j]
            d = held if held < shared[j] else shared[j]
            row = rows[d]
            while d < len(other):
                c = other[d]
                row = _STEP[row][(d > 0 and letters[d - 1] == c) | (letters[d] == c) << 1 | (letters[d + 1] == c) << 2]
                d += 1
                if row == _DEAD:
                    break
                rows[d] = row
            else:
                if (row // 3 % 3 if len(other) == length else row // 9) == 1:
                    yield i, j
                held = d
                j += 1
                continue
            held = d - 1
            j += 1
            if j < n and shared[j] >= d:
                j = bisect_left(words, other[:d] + _END, j)
                # what was passed shares the dead prefix; the next one shares less than d


def _list_rows(key: tuple, words: list[str], counts: list[int]):
    """(word, n, near, best n, best word) of every word of a list that has a near one."""
    length, start, end = key
    found: dict[int, list] = {}
    for i, j in near_in_list(words, length, start, end):
        for a, b in ((i, j), (j, i)) if len(words[j]) > length else ((i, j),):
            mine, other = found.setdefault(a, [0, None]), (-counts[b], words[b])
            mine[0] += 1
            if mine[1] is None or other < mine[1]:
                mine[1] = other
    for i, (near, (n, best)) in found.items():
        yield words[i], counts[i], near, -n, best


def corpus_words(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
    noise: int | None = 31,
) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, with at least
    ``least_length`` code points and ``least_count`` occurrences.

    With ``noise``, a run whose hash (CRC-32 of ``<id>:<run>``) it divides first loses the
    code point at (hash modulo length); a null id is an empty one there.  A null text has no
    words.  Counts are summed in the tasks before they are shuffled.
    """
    # a run of at least so many letters, taken whole: it begins where the one before ended
    runs = re.compile(f"[{_RUNS}]{{{least_length},}}")

    def work(it: Iterator[pa.RecordBatch]):
        counts: Counter = Counter()
        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = runs.findall(text.encode().lower().decode()) if text else ()
                if noise is None:
                    counts.update(found)
                else:
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(found).items():
                        if (h := zlib.crc32(run.encode(), head)) % noise == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        if len(run) >= least_length:
                            counts[run] += n
                if len(counts) >= _FLUSH:
                    yield {"word": list(counts), "n": list(counts.values())}
                    counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    counted = batches(docs.select(id_col, text_col), "word string, n long", work)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _listed(words: DataFrame) -> DataFrame:
    """``words`` with the list they stand in: ``key``, from length, start, end and both ends."""
    kept = F.concat_ws(
        "\0", "length", "start", "end", F.expr("substring(word, 1, start)"),
        F.expr("substring(word, char_length(word) - (length - end) + 1, length - end)"),
    )
    return words.withColumn("key", kept)


def near_words(words: DataFrame, *, most: int = 256) -> DataFrame:
    """(word, n, n_near, best_n, best): of every row of ``words`` (distinct word, n) how many
    others are one edit away, and the most frequent of them (ties: smallest by code points).

    ``most`` only decides how finely lists are cut, never the result.
    """
    size = F.char_length("word")
    ends = F.array(
        F.struct(F.lit(0).alias("start"), F.expr("length div 2").alias("end")),
        F.struct(F.expr("length div 2").alias("start"), F.col("length").alias("end")),
    )
    # a word meets longer ones in the lists of its length, shorter ones in those of one less
    left = _listed(
        words.where("word != ''").withColumn("length", F.explode(F.array(size - 1, size)))
        .select("word", "n", "length", F.inline(ends)).where("start < end")
    )
    ready = []
    while True:
        # in a list of one word, or of words of the greater length only, nothing can be near
        counts = (
            left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(size - F.col("length")).alias("least"))
            .where("rows > 1 AND least = 0").drop("least")
        )
        crowded = (F.col("rows") > most) & (F.col("end") - F.col("start") > 1)
        sized = left.join(counts, "key").withColumn("again", crowded)
        sized = written(sized.drop("rows"), "word-lists")
        ready.append(sized.where("NOT again").drop("again"))
        more = sized.where("again")
        if more.isEmpty():
            break
        middle = F.expr("(start + end) div 2")
        cuts = F.array(
            F.struct(F.col("start").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("end").alias("e"))
        )
        parts = more.select("word", "n", "length", F.inline(cuts)).withColumnsRenamed({"s": "start", "e": "end"})
        left = written(_listed(parts), "word-lists")

    lists = reduce(DataFrame.unionByName, ready).select("key", "word", "n", "length", "start", "end")

    def work(it: Iterator[pa.RecordBatch]):
        key, place, held, counts = None, None, [], []
        out: dict[str, list] = {k: [] for k in ("word", "n", "near", "best_n", "best")}

        def close():
            for row in _list_rows(place, held, counts) if len(held) > 1 else ():
                for column, value in zip(out.values(), row):
                    column.append(value)

        for batch in it:
            for k, word, n, *where in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    close()
                    key, place, held, counts = k, tuple(where), [], []
                held.append(word)
                counts.append(n)
            if len(out["word"]) >= 10_000:
                yield out
                out = {k: [] for k in out}
        close()
        yield out

    dealt = lists.repartition("key").sortWithinPartitions("key", "word")
    found = batches(dealt, "word string, n long, near long, best_n long, best string", work)
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    return (
        found.unionByName(none).groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("top"))
        .select("word", "n", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.w").alias("best"))
    )


def with_roots(forms: DataFrame, hops: int) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form, both known): the end of the chain of
    forms, which has at most ``hops`` links.  Each round doubles the links that are passed."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(hops, 1)))):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return at


def grouped(words: DataFrame, *, ratio: int = 10, most: int = 256) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (distinct word, n).

    A word's form is its near word with the largest n (ties: smallest by code points) if that
    is at least ``ratio`` times its own, else null; its root is the end of the chain of forms.
    As n grows by the ratio with every link, the longest chain follows from the largest n.
    An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2, or forms could run in circles")
    near = near_words(words, most=most)
    known = F.col("best_n") >= ratio * F.col("n")
    named = written(
        near.select("word", "n", "n_near", F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")),
        "forms",
    )
    low, high = named.agg(F.min("n"), F.max("n")).first()
    hops, reach = 0, low or 1
    while reach * ratio <= (high or 0):
        hops, reach = hops + 1, reach * ratio
    roots = with_roots(named.where("form IS NOT NULL"), hops)
    return named.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2,
    noise: int | None = 31, ratio: int = 10, most: int = 256,
) -> DataFrame:
    """``grouped`` over ``corpus_words``: word, form, root, n, n_near, form_n.

    Repeated rows count each time; null texts, empty texts and empty tables have no words;
    other columns are not read.  Equal ids are no matter, ids only seed the noise.
    """
    words = written(
        corpus_words(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, noise=noise),
        "words",
    )
    return grouped(words, ratio=ratio, most=most).select("word", "form", "root", "n", "n_near", "form_n")
