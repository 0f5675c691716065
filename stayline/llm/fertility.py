"""Quality rules on whole texts: counts of words, symbols and repeats, and tokeniser fertility.

A public sentence-piece vocabulary reads every word of a text.  Three measures follow:
characters per token, the share of byte-fallback tokens, and the entropy of the tokens in
bits.  A text is rejected when a measure leaves the band of its group.  Groups are the
languages given, or the script of most letters where none is given; the middle and the
spread of a band come from the shortest half of the group's texts that pass the base rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stayline.llm.common import BLANKS, Memo, batches, once, written

SYMBOLS = b"#*$%&|<>"
_WINDOW = 8
_MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: Cells a unit for the percentiles of a measure.
_GRID = {"chars_per_token": 4096, "byte_share": 65_536, "token_entropy": 4096}
_SCRIPTS = (
    "LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "THAI", "CJK",
    "HIRAGANA", "KATAKANA", "HANGUL", "ARMENIAN", "GEORGIAN", "ETHIOPIC",
)
_SUBTAG = re.compile(r"[a-z]{2,3}(?![^\W_])")
#: Subtags for undetermined, several, uncoded and no languages.
_NO_LANGUAGE = frozenset(("und", "mul", "mis", "zxx"))


@dataclass(frozen=True)
class Bands:
    """How far a measure may lie from the middle of its group's shortest half (the narrowest
    range with half of the reference rows, which a third of junk cannot move).

    Language groups: ``ranges`` widths of that half for characters per token and
    ``entropy_ranges`` for the entropy, at least a ``least`` share of the middle; short texts
    and small groups scatter more, so both grow for them.  Script groups mix languages, where
    a text far from the middle may be one of a rarer language: at least the given shares (for
    the byte share, a difference) of the middle.
    """

    ranges: float = 4.0
    entropy_ranges: float = 3.0
    least: float = 0.05
    more_bytes: float = 0.1
    few_rows: float = 20.0
    mixed_fewer_chars: float = 0.25
    mixed_more_chars: float = 0.6
    mixed_more_bytes: float = 0.2
    mixed_less_entropy: float = 0.5

    def rejected(self) -> Column:
        scatter = F.sqrt(F.greatest(F.lit(1.0), F.col("words_") / F.greatest(F.lit(1), F.col("n_words")))) * (1 + self.few_rows / F.col("rows_"))
        mixed = ~F.col("band").rlike("^[a-z]")

        def middle(name: str) -> Column:
            return F.col(f"{name}_half")["middle"]

        def beyond(name: str, ranges: float, least: Column, least_mixed: Column) -> Column:
            spread = F.greatest(ranges * F.col(f"{name}_half")["width"], least) * scatter
            return F.when(mixed, F.greatest(spread, least_mixed)).otherwise(spread)

        def share(name: str, ranges: float, least_mixed: float) -> Column:
            return beyond(name, ranges, self.least * middle(name), least_mixed * middle(name))

        cpt, bytes_, entropy = _MEASURES
        return (
            (F.col(cpt) < middle(cpt) - share(cpt, self.ranges, self.mixed_fewer_chars))
            | (F.col(cpt) > middle(cpt) + share(cpt, self.ranges, self.mixed_more_chars))
            | (F.col(bytes_) > middle(bytes_) + beyond(bytes_, self.ranges, F.lit(self.more_bytes), F.lit(self.mixed_more_bytes)))
            | (F.col(entropy) < middle(entropy) - share(entropy, self.entropy_ranges, self.mixed_less_entropy))
        )


def shortest_half(percentiles: Column) -> Column:
    """width and middle of the narrowest range between two of 101 percentiles, 50 apart."""
    def half(i: Column) -> Column:
        low, high = F.get(percentiles, i), F.get(percentiles, i + 50)
        return F.struct((high - low).alias("width"), ((low + high) / 2).alias("middle"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(50)), half))


def percentiles(rows: DataFrame, group: str, grid: dict[str, int | None]) -> DataFrame:
    """Per group: 101 percentiles of each column of ``grid`` (an array under the column's name)
    and rows_, the number of rows.

    Values are counted in cells of 1/grid (None: 1/256 of a doubling) and a percentile is the
    least value of the cell that holds its rank.  Counts and least values don't depend on the
    order of rows or of partial results, so a repeated task gives the same bands.  A window
    holds the cells of one column and group, whose number the measures' ranges bound.
    """
    cells = [
        F.floor(F.col(c).cast("double") * n) if n else F.floor(F.log2(F.greatest(F.col(c), F.lit(1)).cast("double")) * 256)
        for c, n in grid.items()
    ]
    columns = [F.struct(F.lit(c).alias("column"), cell.alias("cell"), F.col(c).cast("double").alias("value")) for c, cell in zip(grid, cells)]
    counted = (
        rows.select(group, F.inline(F.array(*columns))).where("value IS NOT NULL")
        .groupBy(group, "column", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value"))
    )
    whole = Window.partitionBy(group, "column")
    summed = counted.withColumns({"upto": F.sum("n").over(whole.orderBy("cell")), "all": F.sum("n").over(whole)})
    first, last = F.expr("(upto - n) * 100 div all + int(upto > n)"), F.expr("upto * 100 div all")
    ranked = summed.where(first <= last).withColumn("at", F.explode(F.sequence(first, last)))
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("at", "value")))), lambda x: x["value"]).alias(c)
        for c in grid
    ]
    return ranked.groupBy(group).agg(*lists, F.max("all").alias("rows_"))


def reference(passed: DataFrame) -> DataFrame:
    """One row per band of ``passed``: the shortest half of each measure, the median number
    of words and the number of rows.  Rows equal in all of these (copies) count once."""
    found = percentiles(passed.select("band", "n_words", *_MEASURES).distinct(), "band", {"n_words": None} | _GRID)
    return found.select(
        "band", F.get("n_words", F.lit(50)).cast("long").alias("words_"), "rows_",
        *[shortest_half(F.col(m)).alias(f"{m}_half") for m in _MEASURES],
    )


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in ``words``."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    found = np.flatnonzero(twice)
    # equal hashes are only candidates; the words decide
    windows = [tuple(words[i : i + window]) for i in found]
    counts = Counter(windows)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = found[[counts[w] > 1 for w in windows]]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


@lru_cache(maxsize=20_000)
def _script(letter: str) -> str:
    name = unicodedata.name(letter, "")
    return next((s for s in _SCRIPTS if name.startswith(s)), "OTHER")


def script_of(text: str) -> str:
    """The script of most letters of the text; ties go to the first name."""
    names: Counter[str] = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            names[_script(c)] += n
    return max(sorted(names), key=names.get) if names else "NONE"


def language_of(lang: str | None) -> str | None:
    """The primary subtag of a language tag, none if it names no language."""
    subtag = _SUBTAG.match((lang or "").strip().lower())
    return subtag[0] if subtag and subtag[0] not in _NO_LANGUAGE else None


class _Reader:
    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.words = Memo(self._ids, 400_000)

    def _ids(self, word: bytes) -> bytes:
        return np.array(self.model.encode(word.decode()), dtype=np.int32).tobytes()

    def measures(self, words: list[bytes], chars: int) -> tuple[float | None, float | None, float | None]:
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype=np.int32)
        if not len(ids):
            return None, None, None
        counts = np.bincount(ids)
        share = counts[counts > 0] / len(ids)
        return chars / len(ids), float(self.is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def measured(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
    passing: Sequence[str] = (), vocabulary: str = "piece_bpe_32k.model",
) -> DataFrame:
    """Per row: ``id_col``, the five base counts, the three measures (null without words)
    and their group, then the ``passing`` columns as pass_0, pass_1 and so on.

    Groups are the primary language subtag (two or three letters), else the script.
    """
    passed = [f"pass_{i}" for i in range(len(passing))]

    def work(it: Iterator[pa.RecordBatch]):
        reader = once(("fertility", vocabulary), lambda: _Reader(public_tokenizers.path(vocabulary)))
        for batch in it:
            out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *_MEASURES, "band")}
            langs = batch.column(2).to_pylist()
            for text, lang in zip(batch.column(1).to_pylist(), langs):
                raw = (text or "").encode()
                words = raw.split()
                solid = raw.translate(None, BLANKS)
                chars = len(text or "") - (len(raw) - len(solid))
                lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
                out["n_words"].append(len(words))
                out["word_chars"].append(chars)
                out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                out["n_repeat_words"].append(repeated_words(words))
                for name, value in zip(_MEASURES, reader.measures(words, chars)):
                    out[name].append(value)
                out["band"].append(language_of(lang) or script_of(text or ""))
            yield {id_col: batch.column(0)} | out | {c: batch.column(c) for c in passed}

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    kinds = dict(docs.dtypes)
    schema = (
        f"{id_col} {kinds[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, chars_per_token double, byte_share double, token_entropy double, band string"
        + "".join(f", {p} {kinds[c]}" for p, c in zip(passed, passing))
    )
    source = docs.select(F.col(id_col), F.col(text_col), lang.alias("lang_"), *[F.col(c).alias(p) for p, c in zip(passed, passing)])
    return batches(source, schema, work)


def judged(
    docs: DataFrame, *, id_col: str = "doc_id", least_words: int = 20, most_repeats: int = 30, bands: Bands = Bands(), **kinds
) -> DataFrame:
    """``measured`` with base_failed and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeats`` percent of
    them repeated in windows.  kept: not base_failed and every measure in its band.  Null
    and empty texts have no words, so they fail; null ids stay null; repeated rows give
    repeated results, an empty table none.
    """
    found = written(measured(docs, id_col=id_col, **kinds), "fertility")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    # two or three letters or one of the scripts: under 20,000 rows whatever lang holds
    joined = found.join(F.broadcast(reference(found.where(~failed))), "band", "left")
    return joined.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(bands.rejected(), F.lit(False))
    ).select(*found.columns, "base_failed", "kept")


def accepted(docs: DataFrame, **kinds) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, as they are."""
    passing = docs.columns
    good = judged(docs, passing=passing, **kinds).where("kept")
    return good.select(*[F.col(f"pass_{i}").alias(c) for i, c in enumerate(passing)])
